"""Stores that change: replaced days, growing roll-ups, as-of statistics kept up to date.

Stored tables are Parquet partitioned by ``year``.  A change is written twice: first the new content
of the touched partitions goes to a staged folder named after the change, then it
replaces these partitions (dynamic partition overwrite).  A run that is interrupted in between finds
the complete staged folder again and only repeats the second step, so the store never depends
on what an earlier attempt had already overwritten.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from grovecast import schemas
from grovecast.functions import expressions as X
from grovecast.operators import dedup
from grovecast.sources.folders import drop_folder, is_complete, read_or_empty

STORE = T.StructType([*schemas.WEATHER_DAILY.fields, T.StructField("year", T.IntegerType())])


def swap_partitions(spark: SparkSession, path: str, staged: str, content, by: str = "year") -> None:
    """Replace the partitions of ``path`` that ``content()`` (a DataFrame) has rows of, through ``staged``."""
    if not is_complete(spark, staged):
        content().write.mode("overwrite").partitionBy(by).parquet(staged)
    new = spark.read.parquet(staged)
    if not new.isEmpty():
        new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
    drop_folder(spark, staged)


def touched_years(rows: DataFrame) -> Column:
    """The years of ``rows`` as a condition on a store's ``year`` (a few numbers: partitions to read)."""
    years = [r["year"] for r in rows.where("obs_date is not null").select(F.year("obs_date").alias("year")).distinct().collect()]
    return F.col("year").isin(*years) if years else F.lit(False)


# -- replaced days (keep="last") ---------------------------------------------------------
def replace_days(spark: SparkSession, path: str, batch: DataFrame, change: str) -> None:
    """Store the last row of every (site, day) of ``batch``, in place of a stored one: a measured day
    replaces the forecast of an earlier pull.  Only the partitions of the batch's years are read and written.

    ``change`` names the pull (a batch id): a repeated call with the same name finishes what was begun.
    The batch should be a written table (it is read for its years and for its rows)."""
    def merged() -> DataFrame:
        new = dedup.dedup_batch(batch.where(F.col("obs_date").isNotNull()), keep="last").select(*dedup.STORE_COLUMNS)
        stored = read_or_empty(spark, path, STORE).where(touched_years(batch)).select(*dedup.STORE_COLUMNS)
        kept = stored.join(new.select("site", "obs_date"), ["site", "obs_date"], "left_anti")
        return kept.unionByName(new).withColumn("year", F.year("obs_date").cast("int"))

    swap_partitions(spark, path, f"{path.rstrip('/')}-staged/{change}", merged)


# -- growing roll-ups ---------------------------------------------------------------------
_SUMS = ("avg_temp", "rain", "avg_wind", "sun_hours", "clouds", "snow")
_MOST = ("max_temp", "max_wind", "avg_gust", "pressure")
_LEAST = ("min_temp",)
PARTIAL = T.StructType(
    [T.StructField("site", T.StringType()), T.StructField("obs_date", T.DateType())]
    + [f for m in _SUMS for f in (T.StructField(f"{m}_sum", T.DecimalType(38, 9)), T.StructField(f"{m}_n", T.LongType()))]
    + [T.StructField(m, T.DoubleType()) for m in (*_MOST, *_LEAST)] + [T.StructField("n_readings", T.LongType())])


def partials(hourly: DataFrame) -> DataFrame:
    """Mergeable partial aggregates per (site, day): exact sums, counts, extremes."""
    value = lambda m: F.col(m).cast(X.EXACT_SQL)
    return hourly.where(F.col("obs_date").isNotNull()).groupBy("site", "obs_date").agg(
        *[a for m in _SUMS for a in (F.sum(value(m)).cast("decimal(38,9)").alias(f"{m}_sum"), F.count(value(m)).alias(f"{m}_n"))],
        *[F.max(m).alias(m) for m in _MOST], *[F.min(m).alias(m) for m in _LEAST], F.count(F.lit(1)).alias("n_readings"))


def merged(parts: DataFrame) -> DataFrame:
    """Partial aggregates of several pulls as one per (site, day)."""
    return parts.groupBy("site", "obs_date").agg(
        *[a for m in _SUMS for a in (F.sum(f"{m}_sum").cast("decimal(38,9)").alias(f"{m}_sum"), F.sum(f"{m}_n").alias(f"{m}_n"))],
        *[F.max(m).alias(m) for m in _MOST], *[F.min(m).alias(m) for m in _LEAST], F.sum("n_readings").alias("n_readings"))


class RollupStore:
    """Daily roll-ups that grow with every pull of hours.

    ``path/gen=G/pull=P`` holds the partial aggregates of pull ``P``; reading merges them.  :meth:`compact`
    writes all of a generation, merged, as the first pull of the next one, with the names of the pulls
    in it; a generation counts from the moment that folder is complete.  A pull that is
    added again replaces its own folder, or is left out if it has been merged already.  One writer at a time."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def generation(self) -> int:
        g = 0
        while is_complete(self.spark, f"{self.path}/gen={g + 1}/merged"):
            g += 1
        return g

    def _folder(self) -> str:
        return f"{self.path}/gen={self.generation()}"

    def pulls(self) -> set[str]:
        """Names of the pulls that the last compaction has merged."""
        if not self.generation():
            return set()
        return {r["pull"] for r in self.spark.read.parquet(f"{self._folder()}/merged").collect()}

    def add(self, pull: str, hourly: DataFrame) -> None:
        if pull not in self.pulls():
            partials(hourly).write.mode("overwrite").parquet(f"{self._folder()}/pulls/pull={pull}")

    def parts(self) -> DataFrame:
        schema = T.StructType([*PARTIAL.fields, T.StructField("pull", T.StringType())])
        return read_or_empty(self.spark, f"{self._folder()}/pulls", schema)

    def read(self) -> DataFrame:
        """The roll-up (the columns of ``dedup.daily_rollup``)."""
        total = lambda m: F.col(f"{m}_sum").cast("double")
        mean = lambda m: X.stable(total(m) / F.when(F.col(f"{m}_n") > 0, F.col(f"{m}_n"))).alias(m)
        zero = lambda m: X.stable(F.coalesce(total(m), F.lit(0.0))).alias(m)
        return merged(self.parts()).select(
            "site", "obs_date", mean("avg_temp"), "max_temp", "min_temp", zero("rain"), "max_wind", mean("avg_wind"), "avg_gust",
            zero("sun_hours"), mean("clouds"), zero("snow"), "pressure", "n_readings")

    def compact(self) -> None:
        parts, folder = self.parts(), f"{self.path}/gen={self.generation() + 1}"
        done = [*self.pulls(), *[r["pull"] for r in parts.select("pull").distinct().collect()]]
        merged(parts).write.mode("overwrite").parquet(f"{folder}/pulls/pull=merged")
        # written last: from here on the new generation counts
        self.spark.createDataFrame([(p,) for p in done if p != "merged"], "pull string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/merged")


# -- as-of statistics kept up to date --------------------------------------------------------
def last_affected(store: DataFrame, changed: DataFrame, n: int) -> DataFrame:
    """site, first, last: the days from the first changed one to the ``n - 1``-th row after the last changed one."""
    span = changed.groupBy("site").agg(F.min("obs_date").alias("first"), F.max("obs_date").alias("_to"))
    after = store.select("site", "obs_date").join(span, "site").where(F.col("obs_date") > F.col("_to"))
    near = after.withColumn("_k", F.row_number().over(Window.partitionBy("site").orderBy("obs_date"))).where(F.col("_k") <= n - 1)
    end = near.groupBy("site").agg(F.max("obs_date").alias("_end"))
    return span.join(end, "site", "left").select("site", "first", F.greatest("_to", F.coalesce("_end", "_to")).alias("last"))


def refresh_asof(spark: SparkSession, weather_path: str, stats_path: str, changed: DataFrame, n: int, stats, change: str) -> None:
    """Bring stored as-of statistics (partitioned by ``year``) up to date after the days ``changed`` (site,
    obs_date) of the stored weather have been added, replaced or removed.

    ``stats(weather)`` computes the statistics of trailing ``n`` rows as of every row.  Only the years from
    the first changed day to ``n - 1`` rows after the last one are recomputed and swapped; they are computed
    from the weather of these years and of as many before them as hold ``n - 1`` rows of every site."""
    changed = changed.where("obs_date is not null").select("site", "obs_date").distinct()
    first = changed.agg(F.min(F.year("obs_date")).alias("y")).first()["y"]
    staged = f"{stats_path.rstrip('/')}-staged/{change}"
    if first is None and not is_complete(spark, staged):
        return

    def content() -> DataFrame:
        weather = spark.read.schema(STORE).parquet(weather_path)
        later = weather.where(F.col("year") >= first)
        last = last_affected(later, changed, n).agg(F.max(F.year("last")).alias("y")).first()["y"]
        start = context_from(weather, later.select("site").distinct(), first, n)
        read = weather.where(F.col("year").between(start, last))
        fresh = stats(read.drop("year")).withColumn("year", F.year("obs_date").cast("int"))
        return fresh.where(F.col("year").between(first, last))

    swap_partitions(spark, stats_path, staged, content)


def context_from(weather: DataFrame, sites: DataFrame, first: int, n: int) -> int:
    """The latest year from which on every one of ``sites`` has ``n - 1`` rows before ``first`` (or all that it
    has).  Counts per (site, year) decide, one row each."""
    before = weather.where(F.col("year") < first).groupBy("site", "year").agg(F.count(F.lit(1)).alias("k")).join(sites, "site", "left_semi")
    upto = F.sum("k").over(Window.partitionBy("site").orderBy(F.col("year").desc()))
    # the first year, going back, with which the rows are enough; a site that never has enough needs all of its years
    per = before.withColumn("_sum", upto).groupBy("site").agg(
        F.max(F.when(F.col("_sum") >= n - 1, F.col("year"))).alias("enough"), F.min("year").alias("oldest"))
    y = per.agg(F.min(F.coalesce("enough", "oldest")).alias("y")).first()["y"]
    return first if y is None else y
