"""JSON weather payloads.

Payloads carry parallel arrays keyed by position (``hourly.time[i]`` goes
with ``hourly.temperature_2m[i]``...).  They are parsed with ``from_json``
into an explicit schema, exploded by position (``posexplode`` of the time
array) and every other variable is read with ``get(array, pos)``:

* ``arrays_zip`` is not used: one missing array would make the zip NULL and
  drop every row of the payload;
* a missing variable therefore gives NULL (or the variable's default), and
  an empty payload gives no rows (the service fails on both).

Date parts are taken from the text of the time stamp, as the service does
(``t[:10]``, ``t[:4]``, ``t[5:7]``); the time is kept as a wall-clock
``timestamp_ntz`` (payload times are local times of the site).  Parsing uses
the ``try_`` forms: a malformed time gives NULLs in its row instead of
failing the job (or the stream) under ANSI mode.

The ``*_from_weather`` builders make payload fixtures from daily weather
rows, one payload per (site, month) so that no group grows with the history.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grovecast import schemas
from grovecast.functions import expressions as X

PRESSURE_HPA = 1013.0           # fixed value: constant pressure of ingested rows
HOURS = (0, 6, 12, 18)          # hours of the hourly payload fixture


def _day(text: Column) -> Column:
    return F.to_date(F.try_to_timestamp(F.substring(text, 1, 10), F.lit("yyyy-MM-dd")))


def _g(struct_col: str, var: str) -> Column:
    """The variable at the row's position; JSON ``NaN`` is no value."""
    return F.nullif(F.get(F.col(f"{struct_col}.{var}"), F.col("pos")), F.lit(float("nan")))


def _explode(payloads: DataFrame, schema, block: str) -> DataFrame:
    if "json" in payloads.columns:
        payloads = payloads.select(F.from_json("json", schema).alias("p")).select("p.*")
    return payloads.select("site", block, F.posexplode(F.col(f"{block}.time")).alias("pos", "t"))


def parse_hourly(payloads: DataFrame) -> DataFrame:
    """Hourly payload -> one row per hour in ``weather_daily`` columns plus
    ``obs_ts`` and ``pos`` (S4).  Defaults: rain, snow, sunshine 0; pressure
    1013; sunshine seconds -> hours."""
    r = _explode(payloads, schemas.PAYLOAD_HOURLY, "hourly")
    h = lambda v: _g("hourly", v)
    return r.select(
        "site", "pos",
        _day(F.col("t")).alias("obs_date"),
        F.try_to_timestamp(F.col("t"), F.lit("yyyy-MM-dd'T'HH:mm")).cast("timestamp_ntz").alias("obs_ts"),
        F.substring("t", 1, 4).try_cast("int").alias("year"),
        F.substring("t", 6, 2).try_cast("int").alias("month"),
        h("temperature_2m").alias("avg_temp"),
        h("temperature_2m_max").alias("max_temp"),
        h("temperature_2m_min").alias("min_temp"),
        X.zero_if_null(h("precipitation")).alias("rain"),
        h("wind_speed_10m_max").alias("max_wind"),
        h("wind_speed_10m_mean").alias("avg_wind"),
        h("wind_gusts_10m_max").alias("avg_gust"),
        (X.zero_if_null(h("sunshine_duration")) / 3600.0).alias("sun_hours"),
        h("cloud_cover").alias("clouds"),
        X.zero_if_null(h("snowfall_sum")).alias("snow"),
        F.lit(PRESSURE_HPA).alias("pressure"))


def parse_daily(payloads: DataFrame, with_extremes: bool = True) -> DataFrame:
    """Daily payload -> one row per day with the humidity estimate and the
    month from the text (S5; ``with_extremes=False`` is the 7-day form S6)."""
    r = _explode(payloads, schemas.PAYLOAD_DAILY, "daily")
    d = lambda v: _g("daily", v)
    cols = ["site",
            _day(F.col("t")).alias("obs_date"),
            d("temperature_2m_mean").alias("avg_temp")]
    if with_extremes:
        cols += [d("temperature_2m_max").alias("max_temp"), d("temperature_2m_min").alias("min_temp")]
    cols += [X.zero_if_null(d("precipitation_sum")).alias("rain"),
             d("cloud_cover_mean").alias("clouds"),
             X.humidity_proxy(d("cloud_cover_mean")).alias("humidity"),
             F.substring("t", 6, 2).try_cast("int").alias("month")]
    return r.select(*cols)


def parse_current(payloads: DataFrame) -> DataFrame:
    """Current-conditions objects -> flat rows (S7, P13, P14).  Payloads with
    ``cod`` other than 200 are kept with ``ok = false`` (the service rejects
    them and falls back)."""
    if "json" in payloads.columns:
        payloads = payloads.select(F.from_json("json", schemas.PAYLOAD_CURRENT).alias("p")).select("p.*")
    return payloads.select(
        "site", F.coalesce(F.col("dt"), F.lit(0).cast("long")).alias("dt"),
        (F.col("cod") == 200).alias("ok"), "message",
        X.round_half_even(X.zero_if_null(F.col("main.temp")), 1).alias("temperature"),
        X.zero_if_null(F.col("main.humidity")).cast("int").alias("humidity"),
        X.zero_if_null(F.col("clouds.all")).cast("int").cast("double").alias("clouds"),
        X.round_half_even(F.coalesce(F.col("rain.1h"), F.col("rain.3h"), F.lit(0.0)), 1).alias("rain"),
        X.round_half_even(X.zero_if_null(F.col("wind.speed")), 1).alias("wind"))


# ---------------------------------------------------------------------------
# fixture builders (payloads made from weather rows by Spark, per site-month)
# ---------------------------------------------------------------------------

def hourly_rows_from_weather(weather: DataFrame) -> DataFrame:
    """Four hourly readings per daily row (hours 0, 6, 12, 18)."""
    hours = F.array(*[F.lit(h) for h in HOURS])
    w = weather.select("*", F.explode(hours).alias("hour"))
    hh = F.col("hour")
    return w.select(
        "site", "obs_date", "hour",
        F.concat(F.date_format("obs_date", "yyyy-MM-dd"), F.lit("T"),
                 F.lpad(hh.cast("string"), 2, "0"), F.lit(":00")).alias("time"),
        (F.col("avg_temp") + (hh - 9) / 3.0).alias("temperature_2m"),
        F.col("max_temp").alias("temperature_2m_max"),
        F.col("min_temp").alias("temperature_2m_min"),
        (F.col("rain") / 4.0).alias("precipitation"),
        F.col("max_wind").alias("wind_speed_10m_max"),
        F.col("avg_wind").alias("wind_speed_10m_mean"),
        F.col("avg_gust").alias("wind_gusts_10m_max"),
        (F.col("sun_hours") * 900.0).alias("sunshine_duration"),
        F.col("clouds").alias("cloud_cover"),
        (F.col("snow") / 4.0).alias("snowfall_sum"))


def _payload_per_month(rows: DataFrame, block: str, variables: list[str],
                       drop_in_december: str | None = None) -> DataFrame:
    """Group rows per (site, month of the year) into one JSON payload of
    parallel arrays, in time order.  A group is at most 31 days x 4 hours."""
    ym = F.date_format(F.to_date(F.substring("time", 1, 10)), "yyyy-MM")
    items = F.sort_array(F.collect_list(F.struct("time", *variables))).alias("_items")
    g = rows.groupBy("site", ym.alias("_ym")).agg(items)
    def field(name: str):
        return lambda it: it[name]

    arrays = []
    for v in ["time"] + variables:
        arr = F.transform("_items", field(v))
        if v == drop_in_december:
            arr = F.when(F.substring("_ym", 6, 2) != "12", arr)   # missing array
        arrays.append(arr.alias(v))
    return g.select(F.to_json(F.struct(F.col("site"), F.struct(*arrays).alias(block))).alias("json"))


def hourly_payloads_from_weather(weather: DataFrame) -> DataFrame:
    """One hourly payload per (site, month); December payloads lack the gust
    array (a missing variable)."""
    rows = hourly_rows_from_weather(weather)
    return _payload_per_month(rows, "hourly", schemas.HOURLY_VARS[1:], drop_in_december="wind_gusts_10m_max")


def daily_payloads_from_weather(weather: DataFrame) -> DataFrame:
    rows = weather.select(
        "site", F.date_format("obs_date", "yyyy-MM-dd").alias("time"),
        F.col("avg_temp").alias("temperature_2m_mean"), F.col("max_temp").alias("temperature_2m_max"),
        F.col("min_temp").alias("temperature_2m_min"), F.col("rain").alias("precipitation_sum"),
        F.col("clouds").alias("cloud_cover_mean"))
    return _payload_per_month(rows, "daily", schemas.DAILY_VARS[1:])


def current_payloads_from_events(events: DataFrame, region: DataFrame) -> DataFrame:
    """Current-conditions responses made from the ``events`` table: one
    response per event, site = region of ``user_id % 5``; an ``error`` event
    is a rejected call (cod 401)."""
    reg = F.broadcast(region.select("r_regionkey", F.col("r_name").alias("site")))  # 5 rows
    ev = events.join(reg, (events.user_id % 5) == reg.r_regionkey)
    k = F.get_json_object("props", "$.k").cast("double")
    ok = F.col("event_type") != "error"
    rain = F.struct(F.when(F.col("event_type") == "click", F.col("value") / 10.0).alias("1h"),
                    F.when(F.col("event_type") == "view", F.col("value") / 5.0).alias("3h"))
    return ev.select(F.to_json(F.struct(
        "site",
        F.when(ok, F.lit(200)).otherwise(F.lit(401)).alias("cod"),
        F.when(~ok, F.lit("Invalid API key")).alias("message"),
        F.unix_timestamp(F.col("ts").cast("timestamp")).alias("dt"),
        F.struct(F.col("value").alias("temp"), k.alias("humidity")).alias("main"),
        F.struct((F.col("value") / 2.0).alias("speed")).alias("wind"),
        F.struct(k.alias("all")).alias("clouds"),
        rain.alias("rain"))).alias("json"))
