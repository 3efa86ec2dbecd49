"""Foliar-feeding advice over trailing 7-row windows.

For every window the five rules are generated as rows (``inline`` of a
constant 5-element array, one row per rule), off-season rules are dropped
right there, and the remaining rows join the fixed 5-row rule table on
``type`` (broadcast, constant size) for thresholds and texts.

Behaviour notes:

* Only in-season types are emitted; ``NOT_YET`` / "Not in optimal season"
  cannot occur in the service (it is tested inside the in-season branch), so
  they appear only with ``include_off_season=True``.
* The humidity text says ``>min%`` while the test is ``>=``; the test wins.
* Humidity is the ``humidity`` column when present, else 50.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovecast.functions import expressions as X
from grovecast.functions.rules import AVOID, BEST_TIME_OF_DAY, DRY_WEEK_MM, FOLIAR, NO_RAIN, foliar_rule_table
from grovecast.operators import windows
from grovecast.operators.risk import one_row_a_day, with_humidity

WINDOW_ROWS = 7


def window_aggs() -> dict:
    return {
        "avg_temp": ("avg", F.col("avg_temp")),
        "avg_humidity": ("avg", F.col("humidity")),
        "total_rain": ("sum0", F.col("rain")),
    }


def window7_asof(weather: DataFrame, n: int = WINDOW_ROWS,
                 block_rows: int = windows.DEFAULT_BLOCK_ROWS) -> DataFrame:
    out = windows.trailing_asof(with_humidity(weather), n, window_aggs(), block_rows=block_rows)
    return out.withColumn("month", F.month("obs_date"))


def window7_latest(weather: DataFrame, n: int = WINDOW_ROWS) -> DataFrame:
    out = windows.trailing_latest(with_humidity(weather), n, window_aggs())
    return out.withColumn("month", F.month("obs_date"))


def foliar_advice(stats: DataFrame, ids: tuple[str, ...] = ("site", "obs_date"),
                  include_off_season: bool = False) -> DataFrame:
    """One row per window and in-season foliar type with status and texts."""
    month = F.col("month")
    gen = F.array(*[F.struct(F.lit(f["type"]).alias("type"),
                             month.isin(*f["best_months"]).alias("in_season"))
                    for f in FOLIAR])
    rows = stats.select(*ids, "month", "avg_temp", "avg_humidity", "total_rain", F.inline(gen))
    if not include_off_season:
        rows = rows.filter(F.col("in_season"))
    rules = F.broadcast(foliar_rule_table(stats.sparkSession))  # 5 rows, fixed
    j = rows.join(rules, "type")
    t, h, r = X.stable("avg_temp"), X.stable("avg_humidity"), X.stable("total_rain")
    temp_ok = F.coalesce(t.between(F.col("temp_lo"), F.col("temp_hi")), F.lit(False))
    hum_ok = F.coalesce(h >= F.col("humidity_min"), F.lit(False))
    no_rain = F.coalesce(r < DRY_WEEK_MM, F.lit(False))
    suitable = temp_ok & hum_ok & no_rain
    status = (F.when(~F.col("in_season"), F.lit("NOT_YET"))
               .when(suitable, F.lit("OPTIMAL")).otherwise(F.lit("SUBOPTIMAL")))
    as_int_text = lambda c: F.col(c).cast("int").cast("string")
    return j.select(
        *ids, "type", "type_order",
        X.title_key("type").alias("name"),
        "description",
        F.array_join(F.transform("best_months", lambda m: m.cast("string")), ",").alias("months"),
        F.col("month").alias("current_month"),
        "in_season",
        suitable.alias("weather_suitable"),
        X.round_half_even("avg_temp", 1).alias("temperature_current"),
        F.concat(as_int_text("temp_lo"), F.lit("-"), as_int_text("temp_hi"), F.lit("°C"))
         .alias("temperature_required"),
        temp_ok.alias("temperature_ok"),
        X.round_half_even("avg_humidity", 1).alias("humidity_current"),
        F.concat(F.lit(">"), as_int_text("humidity_min"), F.lit("%")).alias("humidity_required"),
        hum_ok.alias("humidity_ok"),
        no_rain.alias("no_rain_ok"),
        status.alias("status"),
        F.when(status == "OPTIMAL", F.lit("Apply now"))
         .when(status == "SUBOPTIMAL", F.lit("Wait for better conditions"))
         .otherwise(F.lit("Not in optimal season")).alias("recommendation"))


def timing_advice(stats: DataFrame, ids: tuple[str, ...] = ("site", "obs_date")) -> DataFrame:
    """General timing advice with the current 7-row conditions."""
    return stats.select(
        *ids,
        X.season_of("month").alias("season"),
        F.lit(BEST_TIME_OF_DAY).alias("best_time_of_day"),
        F.lit(AVOID).alias("avoid"),
        X.round_half_even("avg_temp", 1).alias("temperature"),
        X.round_half_even("avg_humidity", 1).alias("humidity"),
        X.round_half_even("total_rain", 1).alias("recent_rain"))


def foliar_report(daily: DataFrame) -> DataFrame:
    """Latest-state report per site (D23): timing advice over the last 7 days
    plus the in-season recommendations with their conditions as an ordered array
    of structs (built per site from at most five rows, so the group is bounded).
    Overlapping pulls count a day once."""
    stats = window7_latest(one_row_a_day(daily))
    adv = foliar_advice(stats, ids=("site",))
    part = lambda k: F.struct(*[F.col(f"{k}_{c}").alias(c) for c in ("current", "required", "ok")]).alias(k)
    conditions = F.struct(part("temperature"), part("humidity"),
                          F.struct(F.lit(NO_RAIN).alias("required"), F.col("no_rain_ok").alias("ok"))
                          .alias("no_rain_expected")).alias("conditions")
    recs = adv.groupBy("site").agg(
        F.sort_array(F.collect_list(F.struct(
            "type_order", "type", "name", "description", "months", "current_month", "in_season",
            "weather_suitable", conditions, "status", "recommendation"))).alias("recommendations"))
    base = timing_advice(stats).join(recs, "site", "left")
    return base.withColumn(
        "recommendations",
        F.coalesce(F.col("recommendations"), F.array().cast(recs.schema["recommendations"].dataType)))
