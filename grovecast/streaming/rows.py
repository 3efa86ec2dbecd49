"""Row-count windows on a stream (R2, W1), and compacted result logs.

Streaming time windows of 30 days equal the service's last 30 rows only for sites without gaps.
Here the state of a site is its own last rows: ``n - 1`` rows and those of the last ``horizon`` days, a
bounded list.  A micro-batch's rows, late ones too, are put in their places, and the
windows that change are emitted again: those of the new rows and of up to ``n - 1`` rows after them.  A row
older than what the state still holds is dropped (the watermark drops those that are more than
``horizon`` days behind the newest row of the stream).  A site without rows for ``expire``
days of stream time gives its state up and starts anew.

The statistics are sums over whole numbers (billionths), the exact decimals of the batch operators.
"""

from __future__ import annotations

import datetime as dt
from bisect import bisect_left

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from grovecast.functions.rules import RAINY_DAY_MM
from grovecast.sources.folders import is_complete, subfolders
from grovecast.streaming import jobs

ROWS, HORIZON_DAYS, EXPIRE_DAYS = 30, 60, 800
STATE = "cut boolean, days array<date>, temps array<double>, rains array<double>, humidities array<double>"
STATS = ("site string, obs_date date, month int, n_rows bigint, avg_temp double, total_rain double, "
         "avg_humidity double, rainy_days bigint")
_UNIT = 10 ** 9


def place(held: list[tuple], cut: bool, new: list[tuple], n: int, horizon: int) -> tuple[list[tuple], bool, list[tuple]]:
    """The rows of a site after ``new`` ones (day, temperature, rain, humidity) have come, whether older ones have
    been cut off, and the statistics of the windows that changed.  Of equal days the last one counts.

    ``held`` is sorted; where it has been cut, its first ``n - 1`` rows are context only, and
    no row goes among them."""
    rows = {r[0]: r for r in held}
    fresh = [r for r in new if not cut or r[0] > held[n - 2][0]]
    rows |= {r[0]: r for r in fresh}
    order = sorted(rows)
    items = [rows[d] for d in order]
    out = []
    todo: set[int] = set()
    for d in {r[0] for r in fresh}:
        at = bisect_left(order, d)
        todo.update(range(at, min(at + n, len(order))))
    for k in sorted(todo):
        window = items[max(0, k - n + 1):k + 1]
        out.append((order[k], len(window), mean(r[1] for r in window), total(r[2] for r in window), mean(r[3] for r in window),
                    sum(r[2] is not None and r[2] > RAINY_DAY_MM for r in window)))
    floor = order[-1] - dt.timedelta(days=horizon) if order else None
    keep = max(0, bisect_left(order, floor) - (n - 1)) if order else 0
    return items[keep:], cut or keep > 0, out


def total(values) -> float:
    return sum(round(v * _UNIT) for v in values if v is not None) / _UNIT


def mean(values) -> float | None:
    v = [round(x * _UNIT) for x in values if x is not None]
    return sum(v) / _UNIT / len(v) if v else None


def window_rows(daily: DataFrame, n: int = ROWS, horizon: int = HORIZON_DAYS, expire: int = EXPIRE_DAYS) -> DataFrame:
    """Statistics of the trailing ``n`` rows of a stream of daily rows (``STATS``), in update mode."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def value(x):
        return None if x is None or x != x else float(x)

    def update(key, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        cut, *columns = state.get if state.exists else (False, [], [], [], [])
        held = list(zip(*columns))
        new = [(r.obs_date, value(r.avg_temp), value(r.rain), value(r.humidity)) for f in frames for r in f.itertuples(index=False)]
        held, cut, out = place(held, cut, sorted(new, key=lambda r: r[0]), n, horizon)
        if not held:
            return
        state.update((cut, *[list(c) for c in zip(*held)]))
        end = dt.datetime.combine(held[-1][0], dt.time(), dt.timezone.utc) + dt.timedelta(days=expire)
        state.setTimeoutTimestamp(max(int(end.timestamp() * 1000), state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame([(key[0], d, d.month, k, t, r, h, w) for d, k, t, r, h, w in out],
                               columns=["site", "obs_date", "month", "n_rows", "avg_temp", "total_rain", "avg_humidity", "rainy_days"])

    rows = (daily.where(F.col("obs_date").isNotNull()).select("site", "obs_date", "avg_temp", "rain", "humidity", F.to_timestamp(F.col("obs_date").cast("string")).alias("obs_ts"))
            .withWatermark("obs_ts", f"{horizon} days"))
    return rows.groupBy("site").applyInPandasWithState(update, STATS, STATE, "update", GroupStateTimeout.EventTimeTimeout)


def start_window_rows(spark: SparkSession, source_dir: str, out_path: str, checkpoint: str, n: int = ROWS, horizon: int = HORIZON_DAYS,
                      available_now: bool = True, max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Row-count windows of daily rows (parquet files), as a versioned log."""
    reader = spark.readStream.schema(jobs.DAILY_WITH_HUMIDITY)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return jobs.start_versioned(window_rows(reader.parquet(source_dir), n, horizon), out_path, checkpoint, "update", available_now)


# -- logs ---------------------------------------------------------------------------------
def _compacted(spark: SparkSession, log_path: str) -> int:
    """The last batch that is part of a complete compaction (-1: none)."""
    base = f"{log_path.rstrip('/')}-compacted"
    return max((int(f.partition("=")[2]) for f in subfolders(spark, base) if is_complete(spark, f"{base}/{f}")), default=-1)


def read_log(spark: SparkSession, log_path: str, keys: list[str], last: int | None = None) -> DataFrame:
    """The newest version per key of a versioned log: the last compaction and the batches after it (up
    to ``last``)."""
    upto = _compacted(spark, log_path)
    log = spark.read.parquet(log_path).where(F.col("batch_id") > upto)
    if last is not None:
        log = log.where(F.col("batch_id") <= last)
    if upto >= 0:
        log = log.unionByName(spark.read.parquet(f"{log_path.rstrip('/')}-compacted/upto={upto}").withColumn("batch_id", F.lit(upto).cast("int")))
    return jobs.latest_versions(log, keys)


def compact_log(spark: SparkSession, log_path: str, keys: list[str]) -> int:
    """Write the newest versions of all complete batches as one table; reading then starts from it.  Safe to
    repeat, and while the stream goes on: later batches are not touched.  Returns the last batch in it."""
    done = [int(f.partition("=")[2]) for f in subfolders(spark, log_path) if f.startswith("batch_id=") and is_complete(spark, f"{log_path}/{f}")]
    upto = max(done, default=-1)
    if upto > _compacted(spark, log_path):
        read_log(spark, log_path, keys, upto).write.mode("overwrite").parquet(f"{log_path.rstrip('/')}-compacted/upto={upto}")
    return upto
