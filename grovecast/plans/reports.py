"""History, weather summary, dashboards and model catalogue (D8-D12,
D25, D26, A6, A7, A10-A12, A16-A18, A21, W5, W6, P19, P21).

Every report is per site: aggregates are ``groupBy(site, ...)`` with partial
aggregation, "last n" selections are ``row_number() <= n`` per site (window
group limit), and report rows are assembled with equi-joins on ``site``.
Rows stay rows: nothing is collected to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grovecast.functions import expressions as X
from grovecast.operators import windows
from grovecast.plans import prediction as P


def _year_range(df: DataFrame, key: str = "site") -> DataFrame:
    return df.groupBy(key).agg(F.min("year").cast("int").alias("start_year"),
                               F.max("year").cast("int").alias("end_year"),
                               F.count(F.lit(1)).alias("count"))


def history(harvest: DataFrame) -> DataFrame:
    """Harvest rows with the oil share in % (D8, P19) and the year range,
    sorted by site and year (W7; one row per site-year, a small result)."""
    rows = harvest.select("site", F.col("year").cast("int").alias("year"),
                          F.col("trees").cast("int").alias("trees"), "harvest_kg", "oil",
                          X.oil_share_pct("harvest_kg", "oil", "ratio").alias("ratio"))
    return rows.join(_year_range(harvest).drop("count"), "site").orderBy("site", "year")


def history_legacy(harvest: DataFrame) -> DataFrame:
    """Harvest rows with the stored ratio, count and year range (D9), sorted."""
    rows = harvest.select("site", F.col("year").cast("int").alias("year"), "trees", "harvest_kg", "oil", "ratio")
    return rows.join(_year_range(harvest), "site").orderBy("site", "year")


def available_years(weather: DataFrame) -> DataFrame:
    """Distinct weather years per site, ascending."""
    return (weather.select("site", F.year("obs_date").cast("int").alias("year")).distinct()
                   .orderBy("site", "year"))


def weather_by_year(weather: DataFrame) -> DataFrame:
    """Yearly summary: mean temperatures, rain total, mean clouds."""
    return weather.groupBy("site", F.year("obs_date").alias("year")).agg(
        X.stable(X.exact_avg("avg_temp")).alias("Avg_Temp"), X.stable(X.exact_avg("max_temp")).alias("Max_Temp"),
        X.stable(X.exact_avg("min_temp")).alias("Min_Temp"),
        X.stable(X.exact_sum0("rain")).alias("Rain"),
        X.stable(X.exact_avg("clouds")).alias("Clouds"))


def weather_summary(weather: DataFrame, years: int = 10) -> DataFrame:
    """The last ``years`` yearly summaries per site, with count and range
    of the rows returned (D10, W5)."""
    yearly = windows.last_n_ascending(weather_by_year(weather), years, "site", "year")
    return yearly.join(_year_range(yearly), "site").orderBy("site", "year")


def latest_year_weather(weather: DataFrame) -> DataFrame:
    """Weather of the latest year of every site (A7, A17): rain total, mean
    temperature and clouds, each to one digit."""
    yr = F.year("obs_date")
    # one aggregate by (site, year), then the newest of these small rows: no join
    years = weather.where(yr.isNotNull()).groupBy("site", yr.cast("int").alias("year")).agg(
        X.round_half_even(X.exact_sum0("rain"), 1).alias("total_rain_mm"),
        X.round_half_even(X.exact_avg("avg_temp"), 1).alias("avg_temp_c"),
        X.round_half_even(X.exact_avg("clouds"), 1).alias("avg_clouds_pct"))
    rest = ["total_rain_mm", "avg_temp_c", "avg_clouds_pct"]
    return (years.groupBy("site").agg(F.max_by(F.struct("year", *rest), "year").alias("_r"))
            .select("site", "_r.year", *[f"_r.{c}" for c in rest]))


def history_average(harvest: DataFrame) -> DataFrame:
    """Mean harvest_kg and oil over the history, year range and count."""
    return harvest.groupBy("site").agg(
        X.stable(X.exact_avg("harvest_kg")).alias("mean_harvest"), X.stable(X.exact_avg("oil")).alias("mean_oil"),
        X.round_half_even(X.exact_avg("harvest_kg"), 0).alias("harvest_kg"),
        X.round_half_even(X.exact_avg("oil"), 0).alias("oil_kg"),
        F.min("year").cast("int").alias("start_year"), F.max("year").cast("int").alias("end_year"),
        F.count(F.lit(1)).alias("count"),
        X.stable(X.exact_avg("ratio")).alias("mean_ratio"))


def dashboard(weather: DataFrame, harvest: DataFrame, model_feature: DataFrame,
              model_meta: DataFrame, model: str = "simple",
              target_year: int = P.DEFAULT_TARGET_YEAR, registry: dict[str, dict] = P.MODEL_REGISTRY) -> DataFrame:
    """Dashboard per site (D11): prediction, kilos per tree at the fixed 130
    trees, last harvest, history average; zeros without year and last harvest
    when the model is unknown."""
    rep = P.prediction_report(weather, harvest, model_feature, model_meta, [model], target_year, registry)
    avg = history_average(harvest).select("site", F.col("harvest_kg").alias("hist_kg"),
                                          F.col("oil_kg").alias("hist_oil_kg"))
    ci = F.coalesce(F.col("ci_kg"), F.lit(0).cast("bigint"))
    return rep.join(avg, "site", "left").select(
        "site", F.col("model").alias("model_used"), F.col("harvest_year").alias("year"),
        F.col("harvest_kg").alias("ensemble_kg"), F.col("oil_kg").alias("estimated_oil_kg"),
        ci.alias("ci_kg"),
        X.round_half_even(F.col("harvest_kg") / P.DASHBOARD_TREES, 1).alias("harvest_per_tree_kg"),
        F.lit(P.DASHBOARD_TREES).alias("trees"),
        "last_year", "last_harvest", "last_oil", "last_trees", "hist_kg", "hist_oil_kg", "error")


def dashboard_legacy(weather: DataFrame, harvest: DataFrame, model_feature: DataFrame,
                     model_meta: DataFrame, model: str = "legacy",
                     with_timestamp: bool = True) -> DataFrame:
    """Legacy dashboard per site (D12): legacy prediction, weather of the
    latest year, last harvest, history average (rounded to 0 digits) and the
    wall-clock stamp of the report."""
    pred = P.predict_legacy(weather, harvest, model_feature, model_meta, model)
    lw = latest_year_weather(weather).withColumnRenamed("year", "latest_weather_year")
    avg = history_average(harvest).select("site", F.col("harvest_kg").alias("hist_kg"),
                                          F.col("oil_kg").alias("hist_oil_kg"))
    out = (lw.join(pred.withColumnRenamed("year", "prediction_year"), "site", "left")
             .join(P.last_harvest(harvest), "site", "left")
             .join(avg, "site", "left"))
    if with_timestamp:
        out = out.withColumn("last_updated", F.current_timestamp())
    return out


def model_catalogue(model_meta: DataFrame, model_feature: DataFrame) -> DataFrame:
    """One row per model: name, description, sorted feature and member lists."""
    feats = model_feature.groupBy("model").agg(
        F.sort_array(F.collect_set("feature")).alias("features"))
    meta = model_meta.groupBy("model").agg(
        F.min("name").alias("name"),
        F.min("description").alias("description"),
        F.sort_array(F.collect_set("member")).alias("members"))
    return meta.join(feats, "model", "left")


def model_info(model_meta: DataFrame, model_feature: DataFrame, importance: DataFrame,
               top: int = 10) -> DataFrame:
    """Feature count, features, members and the first ``top`` features of the
    stored importance order per model (D26, A21, W6)."""
    cat = model_catalogue(model_meta, model_feature)
    w = Window.partitionBy("model").orderBy("rank")
    top_rows = importance.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= top)
    tops = top_rows.groupBy("model").agg(F.sort_array(F.collect_list(
        F.struct("rank", "feature", "importance"))).alias("top_features"))
    return cat.join(tops, "model", "left").select(
        "model", "name", F.size(F.coalesce("features", F.array())).alias("feature_count"),
        "features", "members", "top_features")


def as_json_records(df: DataFrame, key: str | None = "site") -> DataFrame:
    """Report rows as JSON text, one object per row (S12): ``to_json`` of a
    struct of all columns, computed per row by the executors; with ``key``
    the key column is kept next to the JSON for joins and partitioning."""
    body = F.to_json(F.struct(*[F.col(c) for c in df.columns])).alias("json")
    return df.select(F.col(key), body) if key else df.select(body)
