"""Column expressions shared by all operators.

Everything here returns a ``Column`` built from ``pyspark.sql.functions``:
no Python runs per row, so every use stays inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Digits kept before a threshold test or a final rounding: float sums taken
# in a different order (partitions, engines) differ in the last bits, which
# must not flip a `>=` or a half-even tie.
STABLE_DIGITS = 9


# Sums are accumulated as DECIMAL(28, 9): exact, so a sum (and a mean built
# from it) is the same whatever the partitioning, the order in which partial
# aggregates are merged, or the engine.  Converted to double once at the end.
EXACT = T.DecimalType(28, 9)
EXACT_SQL = "DECIMAL(28, 9)"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def exact_sum(x: str | Column, w=None) -> Column:
    """Order-independent sum of a double column (NULL when nothing to sum)."""
    s = F.sum(col(x).cast(EXACT))
    return (s.over(w) if w is not None else s).cast("double")


def decimal_sum(x: str | Column) -> Column:
    """Exact partial sum kept as DECIMAL (to be summed again exactly)."""
    return F.sum(col(x).cast(EXACT))


def exact_sum0(x: str | Column, w=None) -> Column:
    """pandas ``sum``: NULLs skipped, nothing -> 0."""
    return F.coalesce(exact_sum(x, w), F.lit(0.0))


def exact_avg(x: str | Column, w=None) -> Column:
    """Order-independent mean: exact sum / count of non-NULL values."""
    c = col(x)
    n = F.count(c.cast(EXACT))  # what the sum counts: NaN is no value
    return exact_sum(c, w) / (n.over(w) if w is not None else n)


def stable(x: str | Column) -> Column:
    """``x`` rounded to 9 digits (half-even): order-independent float value."""
    return F.bround(col(x), STABLE_DIGITS)


def round_half_even(x: str | Column, digits: int = 0) -> Column:
    """numpy-style ``round(x, digits)``: half to even, after `stable`."""
    return F.bround(stable(x), digits)


def nan_to_null(x: str | Column) -> Column:
    """pandas treats NaN as missing; Spark does not.  NULL is the only gap."""
    c = col(x)
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)


def season_of(month: str | Column) -> Column:
    """Season of a month; winter is Dec, Jan, Feb of the *same* year."""
    m = col(month)
    return (F.when(m.isin(12, 1, 2), F.lit("winter"))
             .when(m.isin(3, 4, 5), F.lit("spring"))
             .when(m.isin(6, 7, 8), F.lit("summer"))
             .otherwise(F.lit("autumn")))


def humidity_proxy(clouds: str | Column) -> Column:
    """Humidity estimate ``100 - (clouds or 50)``: NULL *and* 0 clouds give 50."""
    c = col(clouds)
    return F.lit(100.0) - F.coalesce(F.nullif(c, F.lit(0.0)), F.lit(50.0))


def zero_if_null(x: str | Column) -> Column:
    """``x or 0``."""
    return F.coalesce(col(x), F.lit(0.0))


def clamp_low(x: str | Column, low: float = 0.0) -> Column:
    """``max(low, x)``; NULL stays NULL."""
    c = col(x)
    return F.when(c.isNull(), c).otherwise(F.greatest(F.lit(low), c))


def clip_high(x: str | Column, high: float = 100.0) -> Column:
    c = col(x)
    return F.when(c.isNull(), c).otherwise(F.least(F.lit(high), c))


def risk_label(score: str | Column) -> Column:
    """HIGH from 70, MODERATE from 40, else LOW (on the unclipped score)."""
    s = col(score)
    return (F.when(s >= 70, F.lit("HIGH"))
             .when(s >= 40, F.lit("MODERATE"))
             .otherwise(F.lit("LOW")))


def title_key(key: str | Column) -> Column:
    """``key.replace('_', ' ').title()`` for lower-case snake keys."""
    return F.initcap(F.regexp_replace(col(key), "_", " "))


def oil_share_pct(harvest_kg: str | Column, oil: str | Column, ratio: str | Column) -> Column:
    """Oil as % of harvest_kg to one digit; else stored ratio x 100; else ratio."""
    o, l, r = col(harvest_kg), col(oil), col(ratio)
    nonzero = lambda c: c.isNotNull() & (c != 0)  # noqa: E731  (Python truthiness)
    return (F.when(nonzero(o) & nonzero(l), round_half_even(l / o * 100.0, 1))
             .when(nonzero(r), round_half_even(r * 100.0, 1))
             .otherwise(r))
