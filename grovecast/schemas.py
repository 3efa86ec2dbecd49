"""Explicit schemas at every boundary (no inference)."""

from __future__ import annotations

from pyspark.sql import types as T

D = T.DoubleType()
S = T.StringType()
I = T.IntegerType()  # noqa: E741

WEATHER_MEASURES = ["avg_temp", "max_temp", "min_temp", "rain", "clouds", "sun_hours",
                    "max_wind", "avg_wind", "avg_gust", "snow", "pressure"]

WEATHER_DAILY = T.StructType(
    [T.StructField("site", S), T.StructField("obs_date", T.DateType())]
    + [T.StructField(c, D) for c in WEATHER_MEASURES])

# Harvest as stored: trees written as `200.0`, read as double then truncated.
HARVEST_RAW = T.StructType([
    T.StructField("site", S), T.StructField("year", I), T.StructField("trees", D),
    T.StructField("harvest_kg", D), T.StructField("oil", D), T.StructField("ratio", D)])

HARVEST = T.StructType([
    T.StructField("site", S), T.StructField("year", I), T.StructField("trees", I),
    T.StructField("harvest_kg", D), T.StructField("oil", D), T.StructField("ratio", D)])

# Columns of the harvest files (fixed values): header of the current layout -> column here, and the
# names by position of the older, seven-column layout.
HARVEST_FILE = {"year": "year", "trees": "trees", "olives": "harvest_kg", "oil": "oil", "ratio": "ratio"}
LEGACY_HARVEST_FILE = ["index", "year", "trees", "harvest_kg", "oil", "ratio", "price"]

# Weather CSV header as the service writes it (capitalised names).
WEATHER_CSV = T.StructType(
    [T.StructField("Date", S), T.StructField("Year", I), T.StructField("Month", I)]
    + [T.StructField(n, D) for n in ("Avg_Temp", "Max_Temp", "Min_Temp", "Rain", "Max_Wind",
                                     "Avg_Wind", "Avg_Gust", "Sun_Hours", "Clouds", "Snow",
                                     "Pressure")])

WEATHER_CSV_TO_DAILY = {
    "Avg_Temp": "avg_temp", "Max_Temp": "max_temp", "Min_Temp": "min_temp", "Rain": "rain",
    "Clouds": "clouds", "Sun_Hours": "sun_hours", "Max_Wind": "max_wind",
    "Avg_Wind": "avg_wind", "Avg_Gust": "avg_gust", "Snow": "snow", "Pressure": "pressure"}

MODEL_FEATURE = T.StructType([
    T.StructField("model", S, False), T.StructField("member", S, False),
    T.StructField("feature", S, False), T.StructField("mean", D),
    T.StructField("scale", D), T.StructField("coef", D)])

MODEL_META = T.StructType([
    T.StructField("model", S, False), T.StructField("member", S, False),
    T.StructField("name", S), T.StructField("description", S),
    T.StructField("intercept", D), T.StructField("oil_factor", D),
    T.StructField("cv_mae", D), T.StructField("adj_r2", D)])

FEATURE_IMPORTANCE = T.StructType([
    T.StructField("model", S, False), T.StructField("rank", I, False),
    T.StructField("feature", S, False), T.StructField("importance", D)])


def _arr(t):
    return T.ArrayType(t, True)


# Open-Meteo style payloads: parallel arrays keyed by position.
HOURLY_VARS = ["time", "temperature_2m", "temperature_2m_max", "temperature_2m_min",
               "precipitation", "wind_speed_10m_max", "wind_speed_10m_mean",
               "wind_gusts_10m_max", "sunshine_duration", "cloud_cover", "snowfall_sum"]
PAYLOAD_HOURLY = T.StructType([
    T.StructField("site", S),
    T.StructField("hourly", T.StructType(
        [T.StructField("time", _arr(S))] + [T.StructField(v, _arr(D)) for v in HOURLY_VARS[1:]]))])

DAILY_VARS = ["time", "temperature_2m_mean", "temperature_2m_max", "temperature_2m_min",
              "precipitation_sum", "cloud_cover_mean"]
PAYLOAD_DAILY = T.StructType([
    T.StructField("site", S),
    T.StructField("daily", T.StructType(
        [T.StructField("time", _arr(S))] + [T.StructField(v, _arr(D)) for v in DAILY_VARS[1:]]))])

PAYLOAD_CURRENT = T.StructType([
    T.StructField("site", S), T.StructField("cod", I), T.StructField("message", S),
    T.StructField("dt", T.LongType()),
    T.StructField("main", T.StructType([T.StructField("temp", D), T.StructField("humidity", D)])),
    T.StructField("wind", T.StructType([T.StructField("speed", D)])),
    T.StructField("clouds", T.StructType([T.StructField("all", D)])),
    T.StructField("rain", T.StructType([T.StructField("1h", D), T.StructField("3h", D)]))])
