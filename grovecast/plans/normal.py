"""Least squares from mergeable sufficient statistics.

The sums that a least-squares fit needs (rows, sums, products) are one aggregate over the
data, kept per slice of it (a fold, a year).  They are exact decimals, so slices add up to
the same figures in any order, and any fit over a set of slices is solved from their
sum alone: k folds, or every year from the years before it, need one pass over the
data and no refit.  A slice's sums are one row of (p + 1)(p + 4) / 2 numbers for p features; the
p x p systems are solved by the executors, one row each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grovecast.functions import expressions as X

SOLVED = "n bigint, mean array<double>, scale array<double>, coef array<double>, intercept double, r2 double"


def _terms(names: list[str], label: str) -> dict[str, Column]:
    """What is summed: 1, y, y*y, then x, x*y and x*x' for every feature (pair)."""
    x = [F.col(n) for n in names]
    y = F.col(label)
    out = {"n": F.lit(1.0), "y": y, "yy": y * y}
    out |= {f"x{i}": a for i, a in enumerate(x)} | {f"xy{i}": a * y for i, a in enumerate(x)}
    return out | {f"xx{i}_{j}": x[i] * x[j] for i in range(len(x)) for j in range(i, len(x))}


def statistics(rows: DataFrame, names: list[str], label: str, by: str) -> DataFrame:
    """The sums of every slice ``by``: one row each.  Rows without a label don't count; a missing
    feature is 0 (as in scoring)."""
    filled = rows.where(F.col(label).isNotNull()).na.fill(0.0, subset=names)
    return filled.groupBy(by).agg(*[X.decimal_sum(c).alias(k) for k, c in _terms(names, label).items()])


def sums(stats: DataFrame, by: str, names: list[str], label: str = "label") -> DataFrame:
    """The sums of several slices added up per ``by``."""
    return stats.groupBy(by).agg(*[F.sum(k).alias(k) for k in _terms(names, label)])


def sums_before(stats: DataFrame, by: str, names: list[str], label: str = "label", group: Column | None = None) -> DataFrame:
    """For every slice the sums of all slices before it (in the order of ``by``); a window over the
    slices' rows alone, per ``group``."""
    from pyspark.sql.window import Window
    w = Window.partitionBy(F.lit(0) if group is None else group).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    return stats.select(by, *[F.sum(k).over(w).alias(k) for k in _terms(names, label)]).where(F.col("n").isNotNull())


def solve(stats: DataFrame, names: list[str], keep: str, label: str = "label") -> DataFrame:
    """Per row of ``stats`` its least-squares fit on standardised features: ``keep`` and ``SOLVED``.

    ``scale`` is the population deviation (1 where a feature does not vary); a singular
    system gets the solution of least norm."""
    keys = list(_terms(names, label))
    p = len(names)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]

    def fit(v: np.ndarray) -> tuple:
        n, y, yy = v[:3]
        x, xy = v[3:3 + p], v[3 + p:3 + 2 * p]
        xx = np.zeros((p, p))
        for (i, j), s in zip(pairs, v[3 + 2 * p:]):
            xx[i, j] = xx[j, i] = s
        mean, my = x / n, y / n
        cov, cy = xx / n - np.outer(mean, mean), xy / n - mean * my
        scale = np.sqrt(np.maximum(np.diag(cov), 0.0))
        flat = scale < 1e-6 * np.maximum(1.0, np.abs(mean))  # what is left is the rounding of the sums
        scale[flat] = 1.0
        gram, g = cov / np.outer(scale, scale), cy / scale
        gram[flat], gram[:, flat], g[flat] = 0.0, 0.0, 0.0
        coef = np.linalg.lstsq(gram, g, rcond=1e-10)[0] if p else np.zeros(0)
        var = yy / n - my * my
        return int(n), mean.tolist(), scale.tolist(), coef.tolist(), float(my), float(coef @ g / var) if var > 0 else None

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                got = [fit(np.array(row)) for row in zip(*[batch.column(k).to_pylist() for k in keys])]
                many = pa.list_(pa.float64())
                kinds = (pa.int64(), many, many, many, pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([batch.column(keep), *[pa.array(c, t) for c, t in zip(zip(*got), kinds)]],
                                                 names=[keep, "n", "mean", "scale", "coef", "intercept", "r2"])

    return (stats.select(keep, *[F.col(k).cast("double").alias(k) for k in keys])
            .mapInArrow(run, f"{keep} {stats.schema[keep].dataType.simpleString()}, {SOLVED}"))


def predicted(names: list[str]) -> Column:
    """The prediction of a row joined with its fit."""
    terms = [F.get("coef", F.lit(i)) * (F.coalesce(F.col(n), F.lit(0.0)) - F.get("mean", F.lit(i))) / F.get("scale", F.lit(i)) for i, n in enumerate(names)]
    out = F.col("intercept")
    for t in terms:
        out = out + t
    return out


def fold_of(columns: list[str], folds: int) -> Column:
    """The fold of a row from the values of its key: the same for any partitioning (and engine)."""
    text = F.concat_ws("|", *[F.col(c).cast("string") for c in columns])
    return F.pmod(F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint"), F.lit(max(folds, 1))).cast("int")
