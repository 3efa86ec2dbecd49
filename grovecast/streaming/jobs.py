"""Structured Streaming jobs.

* :func:`start_ingest` (R1): payload files -> parse -> keep-first merge into
  the parquet store, inside ``foreachBatch``.  Each micro-batch removes
  duplicates inside itself and days the store already has, then appends; a
  micro-batch replayed after a failure therefore appends nothing twice, and
  the file commit protocol never leaves half-written output.
* :func:`start_window_risk` (R2): sliding time windows of ``days`` days
  (slide 1 day) per site with a watermark, in update mode.  Row-count windows
  do not exist in streaming; a time window equals the 30-row window only
  when the site has no gaps.  Window edges follow UTC days.
* :func:`start_latest` (R3): newest observation per site in update mode
  (state: one row per site).

Update-mode results are written as a versioned log (``batch_id`` column,
append only); :func:`latest_versions` reads the newest version per key.
All folders live under the session's checkpoint directory (a shared folder
on a cluster), never on a machine-local path.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from grovecast import schemas
from grovecast.functions import expressions as X
from grovecast.functions.rules import RAINY_DAY_MM
from grovecast.operators import dedup
from grovecast.session import ensure_checkpoint_dir
from grovecast.sources import payloads
from grovecast.sources.fixtures import remove_at_exit

DAILY_WITH_HUMIDITY = T.StructType(list(schemas.WEATHER_DAILY.fields)
                                   + [T.StructField("humidity", T.DoubleType())])


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory, removed when the application ends."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/grovecast-{name}-{uuid.uuid4().hex[:12]}"
    remove_at_exit(spark, path)
    return path


# -- R1 ------------------------------------------------------------------------

def start_ingest(spark: SparkSession, source_dir: str, store_path: str, checkpoint: str,
                 keep: str = "first", available_now: bool = True,
                 max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Stream hourly payload files (JSON lines) into the weather store."""
    reader = spark.readStream.schema(schemas.PAYLOAD_HOURLY)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    raw = reader.json(source_dir)

    def merge(batch: DataFrame, batch_id: int) -> None:
        rows = payloads.parse_hourly(batch)
        dedup.append_new_days(batch.sparkSession, store_path, rows, keep)

    w = raw.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


# -- R2 ------------------------------------------------------------------------

def window_stats(daily: DataFrame, days: int = 30, watermark_days: int | None = None) -> DataFrame:
    """Per (site, window of ``days`` days ending on ``obs_date``): the window
    statistics of the disease rules.  Works on streaming and static frames."""
    ts = F.to_timestamp(F.col("obs_date").cast("string"))
    d = daily.withColumn("obs_ts", ts)
    if daily.isStreaming:
        d = d.withWatermark("obs_ts", f"{watermark_days or days + 1} days")
    win = F.window("obs_ts", f"{days} days", "1 day")
    g = d.groupBy("site", win.alias("w")).agg(
        F.count(F.lit(1)).alias("n_rows"),
        X.exact_avg("avg_temp").alias("avg_temp"),
        X.exact_sum0("rain").alias("total_rain"),
        X.exact_avg("humidity").alias("avg_humidity"),
        F.count(F.when(F.col("rain") > RAINY_DAY_MM, 1)).alias("rainy_days"),
        F.max("obs_date").alias("last_row_date"))
    obs = F.date_sub(F.to_date(F.col("w.end")), 1)
    return g.select("site", obs.alias("obs_date"), F.month(obs).alias("month"), "n_rows", "avg_temp",
                    "total_rain", "avg_humidity", "rainy_days", "last_row_date")


def start_versioned(df: DataFrame, out_path: str, checkpoint: str, mode: str = "update",
                    available_now: bool = True) -> StreamingQuery:
    """Write every micro-batch's rows into its own ``batch_id=N`` folder
    (overwrite): a micro-batch replayed after a failure replaces its own
    output, so the log holds each batch exactly once."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_path}/batch_id={batch_id}")

    w = df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def latest_versions(log: DataFrame, keys: list[str]) -> DataFrame:
    """Newest version per key of a versioned log (``max_by`` on batch_id)."""
    cols = [c for c in log.columns if c not in keys and c != "batch_id"]
    r = F.max_by(F.struct(*cols), "batch_id").alias("_r")
    return log.groupBy(*keys).agg(r).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in cols])


def start_window_risk(spark: SparkSession, source_dir: str, out_path: str, checkpoint: str,
                      days: int = 30, available_now: bool = True,
                      max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Sliding-window statistics of daily rows (parquet files) per site.

    Watermark = newest day seen minus ``days`` + 1 days.  Windows ending
    before it are evicted from state; a row older than the watermark of the
    *previous* micro-batch is dropped as late (Spark's rule), so once a
    window has been evicted and one more micro-batch has run, it is final."""
    reader = spark.readStream.schema(DAILY_WITH_HUMIDITY)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    src = reader.parquet(source_dir)
    return start_versioned(window_stats(src, days), out_path, checkpoint, "update", available_now)


def window_results(log: DataFrame) -> DataFrame:
    """Final window rows: newest version per (site, day), without the windows
    that end after the site's newest day (they are still open)."""
    cur = latest_versions(log, ["site", "obs_date"])
    newest = cur.groupBy("site").agg(F.max("last_row_date").alias("_newest"))
    return cur.join(newest, "site").filter(F.col("obs_date") <= F.col("_newest")).drop("_newest")


# -- R3 ------------------------------------------------------------------------

READING_SCHEMA = "site string, event_id long, obs_ts timestamp_ntz, reading double, k int"


def newest_per_site(readings: DataFrame) -> DataFrame:
    """Newest reading per site; ties on time broken by the values."""
    m = F.max(F.struct("obs_ts", "event_id", "reading", "k")).alias("_r")
    return readings.groupBy("site").agg(m).select("site", "_r.*")


def start_latest(spark: SparkSession, source_dir: str, out_path: str, checkpoint: str,
                 available_now: bool = True) -> StreamingQuery:
    src = spark.readStream.schema(READING_SCHEMA).parquet(source_dir)
    return start_versioned(newest_per_site(src), out_path, checkpoint, "update", available_now)
