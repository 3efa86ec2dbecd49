"""Disease risk over trailing 30-row windows.

Scores are plain column expressions generated from the rule table in
``grovecast.functions.rules``: all five diseases are computed in one
projection over the window statistics (no join, no cross product).  The long
form (one row per disease) is a ``Generate`` (``inline``) followed by an
equi-join with the fixed 5-row text table, broadcast because its size is a
constant.

Behaviour notes (service defects and the choice made):

* The month used by the month rule is the month of the window's last row.
* Humidity is the column ``humidity`` when present, else 50 for every row;
  payload data brings the proxy ``100 - (clouds or 50)``.
* A NULL statistic scores no points (pandas compares NaN as false).
* ``risk_level`` is clipped at 100, the label uses the unclipped score.
* Every mean / sum is rounded to 9 digits before a threshold test.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grovecast.functions import expressions as X
from grovecast.functions.rules import DISEASES, RAINY_DAY_MM, disease_rule_table
from grovecast.operators import windows
from grovecast.operators.dedup import dedup_batch

WINDOW_ROWS = 30


def with_humidity(df: DataFrame, default: float = 50.0) -> DataFrame:
    """Column-present-else-default for humidity."""
    if "humidity" in df.columns:
        return df
    return df.withColumn("humidity", F.lit(default))


def with_humidity_proxy(df: DataFrame) -> DataFrame:
    """Humidity estimated from clouds (P9), as the daily payload does."""
    return df.withColumn("humidity", X.humidity_proxy("clouds"))


def window_aggs() -> dict:
    return {
        "avg_temp": ("avg", F.col("avg_temp")),
        "total_rain": ("sum0", F.col("rain")),
        "avg_humidity": ("avg", F.col("humidity")),
        "rainy_days": ("count_if", F.col("rain") > RAINY_DAY_MM),
    }


def window30_asof(weather: DataFrame, n: int = WINDOW_ROWS,
                  block_rows: int = windows.DEFAULT_BLOCK_ROWS) -> DataFrame:
    """30-row statistics as of every day of every site (W1 as-of, R4)."""
    w = with_humidity(weather)
    out = windows.trailing_asof(w, n, window_aggs(), block_rows=block_rows)
    return out.withColumn("month", F.month("obs_date"))


def window30_latest(weather: DataFrame, n: int = WINDOW_ROWS) -> DataFrame:
    """30-row statistics of the newest rows of every site (W1 latest)."""
    w = with_humidity(weather)
    out = windows.trailing_latest(w, n, window_aggs())
    return out.withColumn("month", F.month("obs_date"))


def _score_sql(rule: dict) -> str:
    """The rule's points as one SQL expression over the window statistics
    (one call into the JVM per disease).  A NULL statistic makes its CASE
    fall through to 0, as a NaN comparison does in pandas."""
    t = f"bround(avg_temp, {X.STABLE_DIGITS})"
    band = f"{t} BETWEEN {rule['temp_lo']} AND {rule['temp_hi']}"
    pts = [f"CASE WHEN {band} THEN {rule['band_pts']} ELSE 0 END",
           f"CASE WHEN {band} AND {t} BETWEEN {rule['opt_lo']} AND {rule['opt_hi']} "
           f"THEN {rule['opt_pts']} ELSE 0 END"]
    if rule["hum_min"] is not None:
        pts.append(f"CASE WHEN bround(avg_humidity, {X.STABLE_DIGITS}) >= {rule['hum_min']} "
                   f"THEN {rule['hum_pts']} ELSE 0 END")
    if rule["rainy_min"] is not None:
        pts.append(f"CASE WHEN rainy_days >= {rule['rainy_min']} THEN {rule['rainy_pts']} ELSE 0 END")
    if rule["rain_over"] is not None:
        pts.append(f"CASE WHEN bround(total_rain, {X.STABLE_DIGITS}) > {rule['rain_over']} "
                   f"THEN {rule['rain_pts']} ELSE 0 END")
    if rule["warm_over"] is not None:
        pts.append(f"CASE WHEN {t} > {rule['warm_over']} THEN {rule['warm_pts']} ELSE 0 END")
    if rule["months"]:
        months = ", ".join(str(m) for m in rule["months"])
        pts.append(f"CASE WHEN month IN ({months}) THEN {rule['month_pts']} ELSE 0 END")
    return " + ".join(pts)


def disease_scores_wide(stats: DataFrame) -> DataFrame:
    """Add ``<disease>_score`` (raw, unclipped) for the five diseases."""
    return stats.selectExpr("*", *[f"{_score_sql(r)} AS {r['disease']}_score" for r in DISEASES])


def disease_scores(stats: DataFrame, ids: tuple[str, ...] = ("site", "obs_date")) -> DataFrame:
    """One row per (site, day, disease) with level, label and texts."""
    wide = disease_scores_wide(stats)
    pairs = F.array(*[F.struct(F.lit(r["disease"]).alias("disease"),
                               F.col(f"{r['disease']}_score").alias("score"))
                      for r in DISEASES])
    long = wide.select(*ids, F.inline(pairs))
    rules = F.broadcast(disease_rule_table(wide.sparkSession))  # 5 rows, fixed
    return (long.join(rules, "disease")
                .select(*ids, "disease", "name",
                        X.clip_high("score", 100).cast("int").alias("risk_level"),
                        X.risk_label("score").alias("risk_label"),
                        "description",
                        F.when(F.col("score") >= 50, F.col("rec1_hi")).otherwise(F.col("rec1_lo"))
                         .alias("recommendation_1"),
                        F.col("rec2").alias("recommendation_2"),
                        F.col("rec3").alias("recommendation_3"),
                        "best_treatment_time"))


def overall_label(n_high: Column, n_moderate: Column) -> Column:
    """HIGH with >= 3 HIGH; MODERATE with >= 1 HIGH or >= 3 MODERATE; else LOW."""
    return (F.when(n_high >= 3, F.lit("HIGH"))
             .when((n_high >= 1) | (n_moderate >= 3), F.lit("MODERATE"))
             .otherwise(F.lit("LOW")))


def disease_overall(stats: DataFrame, ids: tuple[str, ...] = ("site", "obs_date")) -> DataFrame:
    """Label counts and overall risk per window (D19, A13-A15), plus the
    rounded window statistics as the headline conditions."""
    wide = stats if f"{DISEASES[0]['disease']}_score" in stats.columns else disease_scores_wide(stats)
    labels = [X.risk_label(f"{r['disease']}_score") for r in DISEASES]

    def count(lbl: str) -> Column:
        total = F.lit(0)
        for c in labels:
            total = total + F.when(c == lbl, 1).otherwise(0)
        return total

    n_high, n_mod, n_low = count("HIGH"), count("MODERATE"), count("LOW")
    return wide.select(
        *ids,
        X.round_half_even("avg_temp", 1).alias("avg_temperature"),
        X.round_half_even("total_rain", 1).alias("total_rain_30d"),
        X.round_half_even("avg_humidity", 1).alias("avg_humidity_estimate"),
        F.col("rainy_days").cast("int").alias("rainy_days_30d"),
        n_high.alias("n_high"), n_mod.alias("n_moderate"), n_low.alias("n_low"),
        overall_label(n_high, n_mod).alias("overall_risk"))


def headline(daily: DataFrame, key: str = "site") -> DataFrame:
    """Whole-input headline per site (A14): mean temp, total rain, mean
    humidity, rainy days, each over *all* input rows (the service names them
    ``_30d`` but takes every row of the payload)."""
    d = with_humidity(daily)
    return d.groupBy(key).agg(
        X.round_half_even(X.exact_avg("avg_temp"), 1).alias("avg_temperature"),
        X.round_half_even(X.exact_sum0("rain"), 1).alias("total_rain_30d"),
        X.round_half_even(X.exact_avg("humidity"), 1).alias("avg_humidity_estimate"),
        F.count(F.when(F.col("rain") > RAINY_DAY_MM, 1)).cast("int").alias("rainy_days_30d"))


def one_row_a_day(daily: DataFrame) -> DataFrame:
    """The first row of each (site, day) of overlapping pulls; rows whose time
    did not parse belong to no day and are left out."""
    return dedup_batch(daily.filter(F.col("obs_date").isNotNull()))


def _disease_struct(rule: dict) -> Column:
    score = F.col(f"{rule['disease']}_score")
    first = F.when(score >= 50, F.lit(rule["rec1_hi"])).otherwise(F.lit(rule["rec1_lo"]))
    return F.struct(
        F.lit(rule["disease"]).alias("disease"), F.lit(rule["name"]).alias("name"),
        X.clip_high(score, 100).cast("int").alias("risk_level"), X.risk_label(score).alias("risk_label"),
        F.lit(rule["description"]).alias("description"),
        F.array(first, F.lit(rule["rec2"]), F.lit(rule["rec3"])).alias("recommendations"),
        F.lit(rule["best_treatment_time"]).alias("best_treatment_time"))


def disease_report(daily: DataFrame, sites: DataFrame | None = None) -> DataFrame:
    """Latest-state report per site: headline over all days, scores over the
    last 30, label counts, overall risk and ``diseases``, the five diseases in
    rule order with level, label and texts.  Overlapping pulls count a day once.
    Sites of ``sites`` without rows get ``error`` = 'No weather data available' (D20)."""
    daily = one_row_a_day(daily)
    stats = window30_latest(daily)
    wide = disease_scores_wide(stats).withColumn("diseases", F.array(*[_disease_struct(r) for r in DISEASES]))
    over = disease_overall(wide, ids=("site", "obs_date", "diseases")).drop(
        "avg_temperature", "total_rain_30d", "avg_humidity_estimate", "rainy_days_30d")
    rep = headline(daily).join(over, "site")
    if sites is not None:
        rep = sites.select("site").distinct().join(rep, "site", "left").withColumn(
            "error", F.when(F.col("obs_date").isNull(), F.lit("No weather data available")))
    return rep
