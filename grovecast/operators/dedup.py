"""Keep-first merge of new weather rows into a store.

The service concatenates the stored rows and the new rows, drops duplicate
dates keeping the *first* (stored before new, then payload order), sorts and
rewrites the whole file.  Here:

* duplicates inside a batch are removed with a ``min_by`` (``max_by`` for
  keep-last) aggregate per (site, obs_date) ordered by (time, payload
  position): deterministic, unlike ``dropDuplicates``, and a partial
  aggregate, so a day re-sent thousands of times collapses map-side instead
  of being sorted in one task;
* rows for days the store already has are removed with a ``left_anti`` join
  on (site, year, obs_date): stored days are never replaced; the writer reads
  only the store partitions (``year``) the batch touches;
* the remaining rows are appended (``mode("append")``), which also creates
  the store on the first write.  Re-running the same batch appends nothing.

Note (service quirk Q4): every hourly row of a day carries the day's date, so
keep-first keeps the first *hour* of each new day.  ``keep="last"`` and
:func:`daily_rollup` (a true daily aggregate) are offered as options.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grovecast import schemas
from grovecast.functions import expressions as X
from grovecast.session import ensure_checkpoint_dir
from grovecast.sources.folders import drop_folder, read_or_empty

KEYS = ("site", "obs_date")
STORE_COLUMNS = ["site", "obs_date"] + schemas.WEATHER_MEASURES


def dedup_batch(batch: DataFrame, keep: str = "first", order: tuple[str, ...] = ("obs_ts", "pos")) -> DataFrame:
    """One row per (site, obs_date) of a batch: the first (or last) by ``order``."""
    rest = [c for c in batch.columns if c not in KEYS]
    # time and payload position first; the values break any remaining tie, so
    # the pick never depends on the partitioning
    lead = [c for c in order if c in batch.columns]
    ordering = F.struct(*[F.col(c) for c in lead + [c for c in rest if c not in lead]])
    pick = (F.max_by if keep == "last" else F.min_by)(F.struct(*rest), ordering).alias("_r")
    return batch.groupBy(*KEYS).agg(pick).select(*KEYS, *[F.col(f"_r.{c}").alias(c) for c in rest])


def new_rows(store: DataFrame, batch: DataFrame, keep: str = "first") -> DataFrame:
    """Deduplicated batch rows for days the store does not have (J9).  Rows
    whose time did not parse (no day) have no key and are not stored."""
    b = (dedup_batch(batch.filter(F.col("obs_date").isNotNull()), keep)
         .select(*STORE_COLUMNS).withColumn("year", F.year("obs_date").cast("int")))
    # join on the store's own ``year`` partition column when it has one
    if "year" in store.columns:
        s = store.select("site", "obs_date", F.col("year").cast("int").alias("year"))
    else:
        s = store.select("site", "obs_date", F.year("obs_date").cast("int").alias("year"))
    return b.join(s, ["site", "year", "obs_date"], "left_anti").drop("year")


def merge_keep_first(store: DataFrame, batch: DataFrame, keep: str = "first") -> DataFrame:
    """Store rows plus the new days of the batch."""
    return store.select(*STORE_COLUMNS).unionByName(new_rows(store, batch, keep))


def append_new_days(spark: SparkSession, store_path: str, batch: DataFrame, keep: str = "first") -> int:
    """Append the batch's new days to the parquet store at ``store_path``
    (partitioned by year); create it when missing (S8, S9).  Returns the
    number of rows appended (counted by the write itself).

    The batch is evaluated once: it is written to the shared folder, from where its years
    and its rows are read."""
    held = f"{ensure_checkpoint_dir(spark).rstrip('/')}/grovecast-batch-{uuid.uuid4().hex[:12]}"
    batch.write.parquet(held)
    try:
        return _append(spark, store_path, spark.read.schema(batch.schema).parquet(held), keep)
    finally:
        drop_folder(spark, held)


def _append(spark: SparkSession, store_path: str, batch: DataFrame, keep: str) -> int:
    schema = T.StructType([*schemas.WEATHER_DAILY.fields, T.StructField("year", T.IntegerType())])
    # only a missing path means "no store yet": any other failure must not be taken for an empty
    # store, or every stored day would be stored again
    store = read_or_empty(spark, store_path, schema)
    # read without a partition column, every year is null, and partitions written
    # beside such files would hide them
    if not store.filter(F.col("year").isNull()).isEmpty():
        raise ValueError(f"the store at {store_path} is not partitioned by year")
    # prune the store to the batch's years (partition filter on `year`): one row
    years = batch.agg(F.min(F.year("obs_date")).alias("a"), F.max(F.year("obs_date")).alias("b")).first()
    if years["a"] is None:
        return 0
    store = store.filter(F.col("year").between(F.lit(years["a"]).cast("int"), F.lit(years["b"]).cast("int")))
    written = Observation()
    fresh = new_rows(store, batch, keep).withColumn("year", F.year("obs_date"))
    fresh.observe(written, F.count(F.lit(1)).alias("n")).write.mode("append").partitionBy("year").parquet(store_path)
    return int(written.get["n"])


def daily_rollup(hourly: DataFrame) -> DataFrame:
    """True daily aggregate of hourly rows."""
    return hourly.groupBy("site", "obs_date").agg(
        X.stable(X.exact_avg("avg_temp")).alias("avg_temp"),
        F.max("max_temp").alias("max_temp"), F.min("min_temp").alias("min_temp"),
        X.stable(X.exact_sum0("rain")).alias("rain"),
        F.max("max_wind").alias("max_wind"),
        X.stable(X.exact_avg("avg_wind")).alias("avg_wind"),
        F.max("avg_gust").alias("avg_gust"),
        X.stable(X.exact_sum0("sun_hours")).alias("sun_hours"),
        X.stable(X.exact_avg("clouds")).alias("clouds"),
        X.stable(X.exact_sum0("snow")).alias("snow"),
        F.max("pressure").alias("pressure"),
        F.count(F.lit(1)).alias("n_readings"))


def ingest_report(batch: DataFrame, added: DataFrame) -> DataFrame:
    """Per site of the batch: rows in, rows added, last date and the last
    row's temperature and clouds to one digit (D24)."""
    last = F.max_by(F.struct("obs_date", "avg_temp", "clouds"), F.struct("obs_ts", "pos"))
    b = batch.groupBy("site").agg(F.count(F.lit(1)).alias("rows_in"), last.alias("_last"))
    a = added.groupBy("site").agg(F.count(F.lit(1)).alias("rows_added"))
    return b.join(a, "site", "left").select(
        "site", "rows_in", F.coalesce("rows_added", F.lit(0).cast("bigint")).alias("rows_added"),
        F.date_format("_last.obs_date", "yyyy-MM-dd").alias("last_update"),
        X.round_half_even("_last.avg_temp", 1).alias("last_temp"),
        X.round_half_even("_last.clouds", 1).alias("last_clouds"))
