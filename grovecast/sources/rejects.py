"""Hourly payloads of any shape, with an account of what is rejected.

``payloads.parse_hourly`` reads payloads into a fixed schema: what does not fit becomes null or
is gone.  Here a payload is parsed as VARIANT, so nothing has to be known about it, and every
payload or hour that cannot be used is kept with the reason:

* the text is no JSON, it names no site, it has no times (one row for the payload);
* an hour's time is not a time, or a variable that the service reads holds something that is neither
  a number nor null (one row for the hour, named after the first such variable).

A missing variable, a null and a number written as text are no reasons.  One pass gives both the rows
and the rejects: filter on ``reason``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grovecast import schemas
from grovecast.functions import expressions as X
from grovecast.sources.payloads import PRESSURE_HPA, _day

NOT_JSON, NO_SITE, NO_TIMES, BAD_TIME = "not JSON", "no site", "no times", "bad time"
VARIABLES = schemas.HOURLY_VARS[1:]


def checked_hourly(payloads: DataFrame) -> DataFrame:
    """Every hour of ``payloads`` (json): site, pos, the columns of ``parse_hourly`` and reason (null: usable)."""
    of = lambda path, kind: F.try_variant_get("v", path, kind)
    arrays = [of(f"$.hourly.{x}", "array<variant>").alias(f"a_{x}") for x in VARIABLES]
    p = payloads.select(F.try_parse_json("json").alias("v")).select(
        F.col("v").isNull().alias("no_json"), of("$.site", "string").alias("site"), of("$.hourly.time", "array<string>").alias("times"), *arrays)
    whole = (F.when(F.col("no_json"), NOT_JSON).when(F.col("site").isNull(), NO_SITE)
             .when(F.coalesce(F.size("times"), F.lit(0)) < 1, NO_TIMES))
    # a payload without times keeps one row
    hours = p.select("site", whole.alias("whole"), *[f"a_{x}" for x in VARIABLES],
                     F.posexplode_outer(F.when(whole.isNull(), F.col("times"))).alias("pos", "t"))
    items = hours.select("site", "whole", "pos", "t", *[F.get(f"a_{x}", F.col("pos")).alias(f"i_{x}") for x in VARIABLES])
    number = lambda x: F.nullif(F.try_variant_get(f"i_{x}", "$", "double"), F.lit(float("nan")))
    rows = items.select("site", "whole", "pos", "t", F.try_to_timestamp("t", F.lit("yyyy-MM-dd'T'HH:mm")).alias("ts"),
                        *[number(x).alias(f"n_{x}") for x in VARIABLES], *[_bad(x).alias(f"b_{x}") for x in VARIABLES])
    bad = F.coalesce(*[F.when(F.col(f"b_{x}"), F.lit(f"bad value: {x}")) for x in VARIABLES])
    reason = F.coalesce("whole", F.when(F.col("ts").isNull(), BAD_TIME), bad)
    n = lambda x: F.col(f"n_{x}")
    return rows.select(
        "site", "pos", _day(F.col("t")).alias("obs_date"), F.col("ts").cast("timestamp_ntz").alias("obs_ts"),
        n("temperature_2m").alias("avg_temp"), n("temperature_2m_max").alias("max_temp"), n("temperature_2m_min").alias("min_temp"),
        X.zero_if_null(n("precipitation")).alias("rain"), n("wind_speed_10m_max").alias("max_wind"), n("wind_speed_10m_mean").alias("avg_wind"),
        n("wind_gusts_10m_max").alias("avg_gust"), (X.zero_if_null(n("sunshine_duration")) / 3600.0).alias("sun_hours"),
        n("cloud_cover").alias("clouds"), X.zero_if_null(n("snowfall_sum")).alias("snow"), F.lit(PRESSURE_HPA).alias("pressure"), reason.alias("reason"))


def _bad(x: str) -> Column:
    """Whether a variable holds something that is neither a number nor null."""
    item = F.col(f"i_{x}")
    return item.isNotNull() & ~F.is_variant_null(item) & F.try_variant_get(item, "$", "double").isNull()


def account(checked: DataFrame) -> DataFrame:
    """site, reason (``accepted`` for usable hours), n_rows."""
    return checked.groupBy("site", F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count(F.lit(1)).alias("n_rows"))


def damaged_payloads(payloads: DataFrame) -> DataFrame:
    """A fixture: payloads damaged by the month of their first hour (February: cut off, April: no site, June: no
    times, August: the first time is none, October: the first temperature is none)."""
    month = F.substring(F.get_json_object("json", "$.hourly.time[0]"), 6, 2)
    json = F.col("json")
    return payloads.select(
        F.when(month == "02", F.expr("left(json, length(json) - 7)"))
        .when(month == "04", F.regexp_replace(json, r'^\{"site":"[^"]*",', "{"))
        .when(month == "06", F.replace(json, F.lit('"time":'), F.lit('"times":')))
        .when(month == "08", F.regexp_replace(json, r'"time":\["[^"]*"', '"time":["no time"'))
        .when(month == "10", F.regexp_replace(json, r'"temperature_2m":\[[^,\]]*', '"temperature_2m":["n/a"'))
        .otherwise(json).alias("json"))
