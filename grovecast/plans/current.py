"""Current conditions per site.

The service asks a weather API for the current conditions; when the call
fails it answers from the newest row of the stored weather file (humidity 0,
no time of day).  The batch form: the newest response per site (``max`` of
a struct led by ``dt``, a partial aggregate) and the newest stored row per
site (``max_by`` on the date), full outer joined on ``site``; a ``source``
column says which one answered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovecast.functions import expressions as X
from grovecast.operators import windows

FIELDS = ["ok", "temperature", "humidity", "clouds", "rain", "wind", "message"]


def newest_response(responses: DataFrame) -> DataFrame:
    """Newest good response per site (the newest of all where none is good); ties on ``dt`` are broken by the
    values, so the choice does not depend on the partitioning."""
    row = F.struct("dt", *FIELDS)
    got = responses.groupBy("site").agg(F.max(F.when(F.col("ok"), row)).alias("_good"), F.max(row).alias("_any"))
    # a rejected newest response does not hide an older good one
    return got.select("site", F.coalesce("_good", "_any").alias("_r")).select("site", "_r.*")


def current_weather(responses: DataFrame, weather: DataFrame) -> DataFrame:
    api = newest_response(responses)
    stored = windows.newest(weather, ["avg_temp", "clouds", "rain", "avg_wind"]).select(
        "site", "obs_date", *[F.col(c).alias(f"f_{c}") for c in ("avg_temp", "clouds", "rain", "avg_wind")])
    j = api.join(stored, "site", "full_outer")
    use_api = F.coalesce(F.col("ok"), F.lit(False))
    has_file = F.col("obs_date").isNotNull()
    day = F.date_format("obs_date", "yyyy-MM-dd")
    pick = lambda a, f: F.when(use_api, a).when(has_file, f)
    return j.select(
        "site",
        F.when(use_api, F.lit("api")).when(has_file, F.lit("file")).alias("source"),
        pick(F.col("dt").cast("string"), day).alias("date"),
        pick(F.col("temperature"), X.round_half_even("f_avg_temp", 1)).alias("temperature"),
        pick(F.col("humidity"), F.lit(0)).alias("humidity"),
        pick(F.col("clouds"), X.round_half_even("f_clouds", 1)).alias("clouds"),
        pick(F.col("rain"), X.round_half_even("f_rain", 1)).alias("rain"),
        pick(F.col("wind"), X.round_half_even(X.zero_if_null("f_avg_wind"), 1)).alias("wind"),
        pick(F.col("dt").cast("string"), F.concat(day, F.lit(" (file)"))).alias("updated"),
        F.when(~use_api & ~has_file, F.coalesce(F.col("message"), F.lit("no data")))
         .alias("error"))
