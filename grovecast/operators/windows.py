"""Trailing-row windows (W1, W2, R4), newest row (W3, W4), last n.

``tail(n)`` in the service counts *rows*, not days: with gaps a window spans
more than n days, with fewer rows it is shorter.  Two forms are built:

* **as-of**: for every row, the statistics of that row and the n-1 rows
  before it in date order (per site).
* **latest**: the statistics of the last n rows of each site only.

Scale: a plain ``Window.partitionBy("site")`` puts a whole site in one task,
and one site may hold a third of all rows.  The as-of form therefore gives
every row its position ``i`` within its site (per-(site, year) counts +
row_number inside (site, year); no task sees more than one site-year), cuts
the positions into blocks of ``block_rows`` and copies the last n-1 rows of
each block into the next block as context.  The window then runs per
(site, block): exact, bounded per task, overhead (n-1)/block_rows rows.
The latest form uses ``row_number() <= n`` directly above the window so that
Spark's window group limit keeps only n rows per site and partition before
the shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grovecast.functions import expressions as X

DEFAULT_BLOCK_ROWS = 4096

# aggregation kinds understood by the window operators
_KINDS = ("avg", "sum0", "count_if", "count")


def _agg(kind: str, c: Column, w=None) -> Column:
    over = (lambda a: a.over(w)) if w is not None else (lambda a: a)
    if kind == "avg":           # exact (decimal) sum / count: order-independent
        return X.exact_avg(c, w)
    if kind == "sum0":          # pandas sum: NULLs skipped, nothing -> 0
        return X.exact_sum0(c, w)
    if kind == "count_if":
        return over(F.count(F.when(c, F.lit(1))))
    if kind == "count":
        return over(F.count(c))
    raise ValueError(f"unknown aggregation {kind!r}; one of {_KINDS}")


def row_positions(df: DataFrame, key: str = "site", order: str = "obs_date",
                  bucket: Column | None = None) -> DataFrame:
    """Add ``_pos`` (0-based position of the row within its key, by ``order``).

    One window per (key, bucket) numbers the rows of each bucket; the
    per-(key, bucket) row counts, turned into running offsets on that small
    table, are joined back.  ``bucket`` must be monotonic in ``order``; the
    default is the year, which bounds a group at 366 rows for daily data
    whatever the size of the site (pass e.g. ``date_trunc('day', ts)`` for
    denser data).
    """
    b = F.year(order) if bucket is None else bucket
    w_in = Window.partitionBy(key, "_yr").orderBy(order)
    x = df.withColumn("_yr", b).withColumn("_rn", F.row_number().over(w_in))
    # counted from the input, not from the numbered rows: no second sort
    counts = df.groupBy(key, b.alias("_yr")).agg(F.count(F.lit(1)).alias("_n"))
    w_prev = Window.partitionBy(key).orderBy("_yr").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col(key).alias("_key"), F.col("_yr").alias("_year"),
                            F.coalesce(F.sum("_n").over(w_prev), F.lit(0)).alias("_off"))
    # null-safe: rows without a day stand first, as in the plain window
    return (x.join(offsets, F.col(key).eqNullSafe(F.col("_key")) & F.col("_yr").eqNullSafe(F.col("_year")))
             .withColumn("_pos", F.col("_off") + F.col("_rn") - 1)
             .drop("_key", "_year", "_off", "_yr", "_rn"))


def trailing_asof(df: DataFrame, n: int, aggs: Mapping[str, tuple[str, Column | str]],
                  key: str = "site", order: str = "obs_date",
                  block_rows: int = DEFAULT_BLOCK_ROWS, keep: list[str] | None = None) -> DataFrame:
    """Statistics of the trailing ``n`` rows as of every row.

    ``aggs`` maps output name -> (kind, column), kind one of ``avg``,
    ``sum0``, ``count_if``, ``count``.  The output has ``key``, ``order``,
    ``n_rows`` (rows in the window), the ``keep`` columns of the current row
    and one column per aggregate.
    """
    if block_rows < n:
        raise ValueError("block_rows must be at least the window length")
    keep = list(keep or [])
    pos = row_positions(df, key, order)
    blk = F.floor(F.col("_pos") / block_rows)
    is_tail = (F.col("_pos") % block_rows) >= (block_rows - (n - 1))
    # every row lives in its block; the last n-1 rows of a block also serve
    # as context rows of the next block
    spread = pos.select(
        "*",
        F.explode(F.when(is_tail & F.lit(n > 1), F.array(blk, blk + 1)).otherwise(F.array(blk)))
         .alias("_blk"))
    spread = spread.withColumn("_ctx", F.col("_blk") != blk)
    w = Window.partitionBy(key, "_blk").orderBy("_pos").rowsBetween(-(n - 1), 0)
    cols = [F.col(key), F.col(order)] + [F.col(c) for c in keep]
    cols.append(F.count(F.lit(1)).over(w).alias("n_rows"))
    for name, (kind, c) in aggs.items():
        c = F.col(c) if isinstance(c, str) else c
        cols.append(_agg(kind, c, w).alias(name))
    return spread.select(*cols, "_ctx").filter(~F.col("_ctx")).drop("_ctx")


def trailing_asof_unblocked(df: DataFrame, n: int, aggs: Mapping[str, tuple[str, Column | str]],
                            key: str = "site", order: str = "obs_date",
                            keep: list[str] | None = None) -> DataFrame:
    """Reference form of :func:`trailing_asof`: one window per key.

    Exact and simple, but a hot key lands in one task.  Used by the tests
    to check the blocked form.
    """
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-(n - 1), 0)
    cols = [F.col(key), F.col(order)] + [F.col(c) for c in (keep or [])]
    cols.append(F.count(F.lit(1)).over(w).alias("n_rows"))
    for name, (kind, c) in aggs.items():
        c = F.col(c) if isinstance(c, str) else c
        cols.append(_agg(kind, c, w).alias(name))
    return df.select(*cols)


def last_rows(df: DataFrame, n: int, key: str = "site", order: str = "obs_date") -> DataFrame:
    """The last ``n`` rows of every key (``tail(n)``), with ``_rank`` 1 = newest.

    ``row_number() <= n`` right above the window lets Spark insert a window
    group limit: each map task ships at most n rows per key to the shuffle,
    so a hot key costs n x partitions rows, not its size.
    """
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    return df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= n)


def trailing_latest(df: DataFrame, n: int, aggs: Mapping[str, tuple[str, Column | str]],
                    key: str = "site", order: str = "obs_date",
                    keep: list[str] | None = None) -> DataFrame:
    """Statistics of the last ``n`` rows of every key (one row per key).

    ``keep`` columns are taken from the newest row; ``order`` is the date of
    the newest row.
    """
    tail = last_rows(df, n, key, order)
    cols = [F.max(order).alias(order), F.count(F.lit(1)).alias("n_rows")]
    for c in keep or []:
        cols.append(F.max_by(c, order).alias(c))
    for name, (kind, c) in aggs.items():
        c = F.col(c) if isinstance(c, str) else c
        cols.append(_agg(kind, c).alias(name))
    return tail.groupBy(key).agg(*cols)


def newest(df: DataFrame, cols: list[str], key: str = "site", order: str = "obs_date") -> DataFrame:
    """Newest row per key (``iloc[-1]`` after a sort): ``max_by`` aggregate.

    A partial aggregate: each task keeps one row per key before the shuffle.
    """
    s = F.max_by(F.struct(*[F.col(c) for c in cols]), order).alias("_r")
    return df.groupBy(key).agg(F.max(order).alias(order), s) \
             .select(key, order, *[F.col(f"_r.{c}").alias(c) for c in cols])


def last_n_ascending(df: DataFrame, n: int, key: str, order: str) -> DataFrame:
    """``sort_values(order).tail(n)`` per key, ascending."""
    return last_rows(df, n, key, order).drop("_rank")
