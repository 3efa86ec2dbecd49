"""Yearly, seasonal and monthly weather features.

The service builds its feature table with sixteen filter + group-by + merge
rounds; Catalyst would not fold those into one pass.  Here every feature is
a conditional aggregate of ONE ``groupBy(site, year)``: one scan, one
shuffle (with map-side partial aggregation, so a hot site costs nothing
extra), no self-join and no fan-out.

Null rules (pandas parity):

* a sum over a group that exists but has only NULLs is 0; a seasonal or
  monthly group without any row is NULL (absent after the left merge);
* a mean skips NULLs and is NULL when nothing is left;
* NaN must be turned into NULL at the scan (``sources.weather``).

Every feature is rounded to 9 digits (half-even), so the values do not
depend on the order in which partial sums were combined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grovecast.functions import expressions as X

# Month abbreviations and season names used in feature names.
MONTH_NAMES = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
SEASONS = ["winter", "spring", "summer", "autumn"]
# Key months of the legacy feature set (month, measure column, name stem).
LEGACY_KEY_MONTHS = [(3, "max_wind", "Max_Wind"), (4, "avg_temp", "Avg_Temp"),
                     (6, "max_temp", "Max_Temp"), (8, "clouds", "Clouds"),
                     (9, "avg_temp", "Avg_Temp")]



def with_parts(weather: DataFrame) -> DataFrame:
    """Add year, month and season of ``obs_date``."""
    return weather.select("*", F.year("obs_date").alias("year"), F.month("obs_date").alias("month"),
                          X.season_of(F.month("obs_date")).alias("season"))


# The aggregates are written as SQL text: one expression per feature is one
# call into the JVM (building them from Column objects costs dozens), which
# keeps the definition of wide plans fast.  Same arithmetic as
# ``expressions.exact_sum0`` / ``exact_avg``.

def _sum0(x: str) -> str:
    return f"coalesce(CAST(sum(CAST({x} AS {X.EXACT_SQL})) AS DOUBLE), 0D)"


def _avg(x: str) -> str:
    return f"(CAST(sum(CAST({x} AS {X.EXACT_SQL})) AS DOUBLE) / count(CAST({x} AS {X.EXACT_SQL})))"


def _present_sum(cond: str, x: str) -> str:
    """Sum over the rows matching ``cond``: 0 if they are all NULL, NULL if
    there are none."""
    return f"CASE WHEN count(CASE WHEN {cond} THEN 1 END) > 0 THEN {_sum0(f'CASE WHEN {cond} THEN {x} END')} END"


def _mean_if(cond: str, x: str) -> str:
    return _avg(f"CASE WHEN {cond} THEN {x} END")


def yearly_aggs() -> dict[str, str]:
    return {"Avg_Temp": _avg("avg_temp"), "Max_Temp": _avg("max_temp"),
            "Min_Temp": _avg("min_temp"), "Rain": _sum0("rain"),
            "Clouds": _avg("clouds"), "Sun_Hours": _sum0("sun_hours")}


def seasonal_aggs() -> dict[str, str]:
    out = {}
    for s in SEASONS:
        c = f"season = '{s}'"
        out[f"Rain_{s}"] = _present_sum(c, "rain")
        out[f"Temp_{s}"] = _mean_if(c, "avg_temp")
        out[f"Clouds_{s}"] = _mean_if(c, "clouds")
    return out


def monthly_aggs() -> dict[str, str]:
    out = {}
    for m, name in enumerate(MONTH_NAMES, 1):
        c = f"month = {m}"
        out[f"Rain_{name}"] = _present_sum(c, "rain")
        out[f"Temp_{name}"] = _mean_if(c, "avg_temp")
        out[f"Clouds_{name}"] = _mean_if(c, "clouds")
    return out


def _stable_all(aggs: dict[str, str]) -> list[Column]:
    return [F.expr(f"bround({a}, {X.STABLE_DIGITS}) AS `{name}`") for name, a in aggs.items()]


def feature_aggs(parts: tuple[str, ...] = ("yearly", "seasonal", "monthly"),
                 names: list[str] | None = None) -> dict[str, str]:
    """The D1 aggregates (SQL text), optionally only those in ``names``."""
    aggs: dict[str, str] = {}
    if "yearly" in parts:
        aggs.update(yearly_aggs())
    if "seasonal" in parts:
        aggs.update(seasonal_aggs())
    if "monthly" in parts:
        aggs.update(monthly_aggs())
    if names is not None:
        aggs = {k: v for k, v in aggs.items() if k in set(names)}
    return aggs


def catalog_names() -> list[str]:
    """Names of the 54 D1 features (plus ``year`` they make 55 columns)."""
    return ["Avg_Temp", "Max_Temp", "Min_Temp", "Rain", "Clouds", "Sun_Hours"] + \
        [f"{m}_{s}" for s in SEASONS for m in ("Rain", "Temp", "Clouds")] + \
        [f"{m}_{n}" for n in MONTH_NAMES for m in ("Rain", "Temp", "Clouds")]


def weather_features(weather: DataFrame, parts: tuple[str, ...] = ("yearly", "seasonal", "monthly"),
                     ids: tuple[str, ...] = ("site",), names: list[str] | None = None) -> DataFrame:
    """Feature table, one row per (site, year) (D1: 55 columns with all
    parts); ``names`` restricts it to the features a caller needs."""
    w = with_parts(weather)
    return w.groupBy(*ids, "year").agg(*_stable_all(feature_aggs(parts, names)))


def legacy_features(weather: DataFrame, ids: tuple[str, ...] = ("site",)) -> DataFrame:
    """Legacy feature table, 26 columns per (site, year).

    Key-month columns take the value of the *first row* of that month (the
    service joins raw rows and reads row 0); ``min_by`` keeps a NULL
    value of that first row instead of skipping to the next one.
    """
    w = with_parts(weather)
    aggs = {"Avg_Temp_yearly": _avg("avg_temp"), "Max_Temp_yearly": _avg("max_temp"),
            "Min_Temp_yearly": _avg("min_temp"), "Rain_yearly": _sum0("rain"),
            "Pressure_yearly": _avg("pressure"), "Snow_yearly": _sum0("snow"),
            "Sun_Hours_yearly": _sum0("sun_hours"), "Max_Wind_yearly": _avg("max_wind"),
            "Avg_Wind_yearly": _avg("avg_wind"), "Avg_Gust_yearly": _avg("avg_gust"),
            "Clouds_yearly": _avg("clouds")}
    for s in SEASONS:
        c = f"season = '{s}'"
        aggs[f"Rain_{s}"] = _present_sum(c, "rain")
        aggs[f"Avg_Temp_{s}"] = _mean_if(c, "avg_temp")
    key = []
    for m, src, stem in LEGACY_KEY_MONTHS:
        in_m = F.col("month") == m
        key.append(F.min_by(src, F.when(in_m, F.col("obs_date"))).alias(f"{stem}_M{m}"))
    agg = w.groupBy(*ids, "year").agg(*_stable_all(aggs), *key)
    return agg.withColumn("Temp_Spread_yearly",
                          X.stable(F.col("Max_Temp_yearly") - F.col("Min_Temp_yearly")))
