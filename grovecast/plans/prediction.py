"""Harvest predictions per site.

All functions take DataFrames and return DataFrames; model coefficients
are tables (``model_feature``, ``model_meta``), not code.  Per-site work is
one aggregate per site (partial aggregation before the shuffle) followed by
joins on ``site`` or (``site``, ``year``).

Behaviour notes:

* Year choice (D6): the weather year is ``target_year - 1`` when the site
  has weather for it, else its last weather year; the harvest year is the
  weather year + 1.
* Simple model (D3): January rain of the weather year (0 without rows),
  September / October mean clouds of the weather year, else the mean over
  all September / October rows of the site (row mean, not mean of means);
  remaining NULLs count as 0.  Without the model: 950 kg, cv_mae 200, r2 0.
  A model without cv_mae / adj_r2 uses 300 / 0.94.
* Ensemble (D4): mean of the raw member values, then clamp at 0 (new
  service); the legacy form (D5) averages the clamped and rounded members.
* Rounding is numpy's half-to-even.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grovecast.functions import expressions as X
from grovecast.operators import features as feat
from grovecast.operators import scoring, windows

DEFAULT_TARGET_YEAR = 2026
# Constants of the service's prediction results.
NO_MODEL_KG = 950.0
NO_MODEL_CV_MAE = 200.0
NO_MODEL_R2 = 0.0
DEFAULT_CV_MAE = 300.0
DEFAULT_ADJ_R2 = 0.94
SIMPLE_OIL_FACTOR = 0.15
ENSEMBLE_OIL_FACTOR = 0.23
ENSEMBLE_CI_FACTOR = 0.4
ENSEMBLE_MAE_FACTOR = 0.3
ENSEMBLE_R2 = 0.85
SIMPLE_MODEL_NAME = "Statistical Model (Simple)"
ENSEMBLE_MODEL_NAME = "ML Ensemble (Complex)"
DASHBOARD_TREES = 130
SIMPLE_FEATURES = ["Rain_Jan", "Clouds_Sep", "Clouds_Oct"]
LEGACY_NO_MODEL = "Models not trained"
ENSEMBLE_NO_MODEL = "Complex model not available"
# The models a report may be asked for, trained or not (``kind``
# says how they are scored; trained members are in the model tables).
MODEL_REGISTRY = {
    "simple": dict(kind="simple", name="Statistical Model", description="Best statistical model (R²=0.69, p=0.00003)"),
    "complex": dict(kind="ensemble", name="ML Ensemble", description="Ensemble of trained regressors"),
}


def _round0(c: Column) -> Column:
    return X.round_half_even(c, 0).cast("bigint")


def choose_years(weather: DataFrame, target_year: int = DEFAULT_TARGET_YEAR) -> DataFrame:
    """(site, weather_year, harvest_year) per site."""
    yr = F.year("obs_date")
    per_site = weather.groupBy("site").agg(
        F.max(yr).alias("_max_year"),
        F.max(F.when(yr == target_year - 1, F.lit(True))).alias("_has_target"))
    wy = F.when(F.col("_has_target"), F.lit(target_year - 1)).otherwise(F.col("_max_year"))
    return per_site.select("site", wy.cast("int").alias("weather_year"),
                           (wy + 1).cast("int").alias("harvest_year"))


def _year_priority(target_year: int) -> Column:
    """The target's weather year wins, else the latest year."""
    return F.when(F.col("year") == target_year - 1, F.lit(1 << 30)).otherwise(F.col("year"))


def chosen_year_features(weather: DataFrame, target_year: int = DEFAULT_TARGET_YEAR,
                         names: list[str] | None = None) -> DataFrame:
    """One row per site: the D1 features of the chosen weather year plus the
    all-years September / October cloud means (the simple model's fallback).

    One pass over the weather rows: a ``groupBy(site, year)`` with the
    features and exact partial sums, then a per-site ``max_by`` on the
    (small) site-year table.
    """
    w = feat.with_parts(weather)
    sep, oct_ = F.col("month") == 9, F.col("month") == 10
    aggs = feat.feature_aggs(names=names)
    names = list(aggs)
    site_years = w.groupBy("site", "year").agg(
        *feat._stable_all(aggs),
        X.decimal_sum(F.when(sep, F.col("clouds"))).alias("_sep_sum"),
        F.count(F.when(sep, F.col("clouds"))).alias("_sep_n"),
        X.decimal_sum(F.when(oct_, F.col("clouds"))).alias("_oct_sum"),
        F.count(F.when(oct_, F.col("clouds"))).alias("_oct_n"))
    pick = F.max_by(F.struct("year", *names), _year_priority(target_year)).alias("_r")
    per_site = site_years.groupBy("site").agg(
        pick,
        (F.sum("_sep_sum").cast("double") / F.sum("_sep_n")).alias("_sep_all"),
        (F.sum("_oct_sum").cast("double") / F.sum("_oct_n")).alias("_oct_all"))
    return per_site.select(
        "site", F.col("_r.year").cast("int").alias("weather_year"),
        (F.col("_r.year") + 1).cast("int").alias("harvest_year"),
        *[F.col(f"_r.{n}").alias(n) for n in names],
        *[F.lit(None).cast("double").alias(n) for n in SIMPLE_FEATURES if n not in names],
        X.stable("_sep_all").alias("_sep_all"), X.stable("_oct_all").alias("_oct_all"))


def _needed(model_feature: DataFrame, models: list[str] | None, simple: bool = False) -> list[str]:
    """Catalogue features the models use (plus the simple model's three)."""
    used = scoring.model_feature_names(model_feature, feat.catalog_names(), models)
    return sorted(set(used) | (set(SIMPLE_FEATURES) if simple else set()))


def simple_features(chosen: DataFrame) -> DataFrame:
    """Rain_Jan, Clouds_Sep, Clouds_Oct of the chosen year with the simple
    model's defaults: January rain 0 without rows, cloud means from all
    years when the year has none (A8, A9)."""
    return chosen.select(
        "site",
        F.coalesce(F.col("Rain_Jan"), F.lit(0.0)).alias("Rain_Jan"),
        F.coalesce(F.col("Clouds_Sep"), F.col("_sep_all")).alias("Clouds_Sep"),
        F.coalesce(F.col("Clouds_Oct"), F.col("_oct_all")).alias("Clouds_Oct"))


def _simple_result() -> dict[str, Column]:
    """Result columns of a simple model from raw (NULL: not trained), cv_mae, adj_r2, oil_factor."""
    has = F.col("raw").isNotNull()
    pred = F.when(has, X.clamp_low("raw")).otherwise(F.lit(NO_MODEL_KG))
    cv_mae = F.when(has, F.coalesce(F.col("cv_mae"), F.lit(DEFAULT_CV_MAE))).otherwise(F.lit(NO_MODEL_CV_MAE))
    r2 = F.when(has, F.coalesce(F.col("adj_r2"), F.lit(DEFAULT_ADJ_R2))).otherwise(F.lit(NO_MODEL_R2))
    oil_factor = F.coalesce(F.col("oil_factor"), F.lit(SIMPLE_OIL_FACTOR))
    return {"harvest_kg": _round0(pred), "oil_kg": _round0(pred * oil_factor), "ci_kg": _round0(cv_mae * 2),
            "cv_mae": cv_mae, "r2": r2, "model_name": F.lit(SIMPLE_MODEL_NAME)}


def _ensemble_result(raw: str) -> dict[str, Column]:
    """Result columns of an ensemble from its mean (NULL: not trained) and oil_factor."""
    pred = X.clamp_low(raw)
    oil_factor = F.coalesce(F.col("oil_factor"), F.lit(ENSEMBLE_OIL_FACTOR))
    return {"harvest_kg": _round0(pred), "oil_kg": _round0(pred * oil_factor),
            "ci_kg": _round0(pred * ENSEMBLE_CI_FACTOR),
            "cv_mae": _round0(pred * ENSEMBLE_MAE_FACTOR).cast("double"),
            "r2": F.lit(ENSEMBLE_R2), "model_name": F.lit(ENSEMBLE_MODEL_NAME)}


def _simple_from(chosen: DataFrame, model_feature: DataFrame, model_meta: DataFrame,
                 model: str) -> DataFrame:
    fx = simple_features(chosen)
    members = scoring.member_predictions(fx, model_feature, model_meta, ["site"], [model])
    per_site = members.groupBy("site").agg(
        X.stable(X.exact_avg("raw")).alias("raw"), F.max("cv_mae").alias("cv_mae"),
        F.max("adj_r2").alias("adj_r2"), F.max("oil_factor").alias("oil_factor"))
    j = chosen.select("site", "weather_year", "harvest_year").join(fx, "site").join(per_site, "site", "left")
    return j.select(
        "site", "harvest_year", F.col("weather_year").alias("weather_year_used"),
        *[c.alias(n) for n, c in _simple_result().items()],
        F.col("Rain_Jan").alias("rain_jan"), F.col("Clouds_Sep").alias("clouds_sep"),
        F.col("Clouds_Oct").alias("clouds_oct"))


def predict_simple(weather: DataFrame, model_feature: DataFrame, model_meta: DataFrame,
                   target_year: int = DEFAULT_TARGET_YEAR, model: str = "simple") -> DataFrame:
    """Simple statistical prediction per site (D3)."""
    return _simple_from(chosen_year_features(weather, target_year, names=SIMPLE_FEATURES),
                        model_feature, model_meta, model)


def _ensemble_from(chosen: DataFrame, model_feature: DataFrame, model_meta: DataFrame,
                   model: str) -> DataFrame:
    fx = chosen.drop("harvest_year", "_sep_all", "_oct_all").withColumnRenamed("weather_year", "year")
    members = scoring.member_predictions(fx, model_feature, model_meta, ["site", "year"], [model],
                                         catalog=_needed(model_feature, [model]))
    ens = scoring.ensemble(members, ["site", "year"])
    return ens.select(
        "site", (F.col("year") + 1).cast("int").alias("harvest_year"),
        F.col("year").cast("int").alias("weather_year_used"),
        *[c.alias(n) for n, c in _ensemble_result("mean_raw").items()],
        F.col("member_kg").alias("individual_predictions"))


def predict_ensemble(weather: DataFrame, model_feature: DataFrame, model_meta: DataFrame,
                     target_year: int = DEFAULT_TARGET_YEAR, model: str = "complex") -> DataFrame:
    """Ensemble prediction per site with per-member values.

    Sites without a usable model get no row (the report turns that into an
    error row)."""
    return _ensemble_from(chosen_year_features(weather, target_year, names=_needed(model_feature, [model])),
                          model_feature, model_meta, model)


def choose_model(model_meta: DataFrame, preference: list[str]) -> DataFrame:
    """The first model of ``preference`` present in ``model_meta`` (S11):
    one row (``model``), NULL when none is present.  A global aggregate over
    the distinct model names (a table of a handful of rows)."""
    rank = F.array_position(F.array(*[F.lit(m) for m in preference]), F.col("model"))
    cands = model_meta.select("model").distinct().withColumn("_rank", rank).filter(F.col("_rank") > 0)
    return cands.agg(F.min_by("model", "_rank").alias("model"))


def predict_legacy(weather: DataFrame, harvest: DataFrame, model_feature: DataFrame,
                   model_meta: DataFrame, model: str | list[str] = "legacy") -> DataFrame:
    """Legacy prediction for the latest weather year of every site.

    ``model`` is a model name, or a preference list resolved with
    :func:`choose_model` (the old service loads the simple model when present,
    else the complex one).  Members are clamped and rounded before averaging;
    trees are those of the harvest of that year, else the truncated mean of
    the site; the oil estimate multiplies by the mean stored ratio (the
    service's own formula)."""
    models: list[str] | None = [model] if isinstance(model, str) else None
    if models is None:
        chosen = choose_model(model_meta, list(model))
        model_feature = model_feature.join(chosen, "model", "left_semi")
        model_meta = model_meta.join(chosen, "model", "left_semi")
    # one aggregate by (site, year), then the newest of these small rows: no weather row is joined
    years = feat.legacy_features(weather.where(F.col("obs_date").isNotNull()))
    rest = [c for c in years.columns if c not in ("site", "year")]
    fx = (years.groupBy("site").agg(F.max_by(F.struct("year", *rest), "year").alias("_r"))
          .select("site", F.col("_r.year").cast("int").alias("year"), *[F.col(f"_r.{c}").alias(c) for c in rest]))
    members = scoring.member_predictions(fx, model_feature, model_meta, ["site", "year"], models)
    ens = scoring.ensemble(members, ["site", "year"])
    hstats = harvest.groupBy("site").agg(
        X.exact_avg("trees").cast("int").alias("_mean_trees"), X.exact_avg("ratio").alias("_avg_ratio"))
    trees_of_year = harvest.select("site", "year", F.col("trees").cast("int").alias("_trees"))
    # every site with weather gets a row; without a model it carries the error
    j = (fx.select("site", "year")
               .join(ens, ["site", "year"], "left")
               .join(trees_of_year, ["site", "year"], "left")
               .join(hstats, "site", "left"))
    trees = F.coalesce(F.col("_trees"), F.col("_mean_trees"))
    e = F.col("mean_clamped_rounded")
    return j.select(
        "site", F.col("year").cast("int").alias("year"), trees.alias("trees"),
        F.col("member_kg_clamped").alias("predictions_kg"),
        X.round_half_even(e, 0).alias("ensemble_kg"),
        X.round_half_even(e * F.col("_avg_ratio"), 0).alias("estimated_oil_kg"),
        X.round_half_even(F.try_divide(e, trees), 1).alias("harvest_per_tree_kg"),
        X.round_half_even("_avg_ratio", 3).alias("avg_oil_ratio"),
        F.when(e.isNull(), F.lit(LEGACY_NO_MODEL)).alias("error"))


def predict_backtest(weather: DataFrame, harvest: DataFrame, model_feature: DataFrame,
                     model_meta: DataFrame, models: list[str] | None = None) -> DataFrame:
    """Every model on every (site, weather year), joined with the harvest of
    the next year (R5): prediction, actual, absolute error and the site's MAE
    per model.  The per-(site, model) MAE is a small aggregate joined back."""
    needed = _needed(model_feature, models)
    fx = feat.weather_features(weather, names=needed)
    members = scoring.member_predictions(fx, model_feature, model_meta, ["site", "year"], models,
                                         catalog=needed)
    ens = scoring.ensemble(members, ["site", "year"])
    h = harvest.select("site", (F.col("year") - 1).alias("year"), F.col("harvest_kg").alias("actual_kg"))
    pred = X.clamp_low("mean_raw")
    rows = ens.join(h, ["site", "year"], "left").select(
        "site", "model", F.col("year").cast("int").alias("weather_year"),
        (F.col("year") + 1).cast("int").alias("harvest_year"),
        pred.alias("predicted_kg"), "actual_kg",
        X.stable(F.abs(pred - F.col("actual_kg"))).alias("abs_error"))
    mae = rows.groupBy("site", "model").agg(X.stable(X.exact_avg("abs_error")).alias("mae"),
                                            F.count("abs_error").alias("n_scored"))
    return rows.join(mae, ["site", "model"])


def last_harvest(harvest: DataFrame) -> DataFrame:
    """Newest harvest row per site."""
    return windows.newest(harvest, ["harvest_kg", "oil", "trees"], key="site", order="year").select(
        "site", F.col("year").alias("last_year"), F.col("harvest_kg").alias("last_harvest"),
        F.col("oil").alias("last_oil"), F.col("trees").cast("int").alias("last_trees"))


#: Prefix of the simple models' features (with their defaults) next to the plain
#: ones, and the member that gives every requested model its row per site.
_SIMPLE, _REQUESTED = "simple:", "__requested__"


def _scored_models(weather: DataFrame, model_feature: DataFrame, model_meta: DataFrame, requested: list[str],
                   simple: list[str], target_year: int) -> DataFrame:
    """(site, weather_year, harvest_year, model, raw, cv_mae, adj_r2, oil_factor), one
    row per site and requested model, all scored in one pass over the features;
    raw is NULL for a model without trained members."""
    spark = weather.sparkSession
    names = _needed(model_feature, requested, simple=True)
    chosen = chosen_year_features(weather, target_year, names=names)
    defaults = {"Rain_Jan": F.lit(0.0), "Clouds_Sep": F.col("_sep_all"), "Clouds_Oct": F.col("_oct_all")}
    ids = ["site", "weather_year", "harvest_year"]
    fx = chosen.select(*ids, *names, *[F.coalesce(F.col(n), d).alias(_SIMPLE + n) for n, d in defaults.items()])
    mf = model_feature.withColumn("feature", F.when(F.col("model").isin(*simple), F.concat(F.lit(_SIMPLE), "feature"))
                                  .otherwise(F.col("feature")))
    asked = spark.createDataFrame([(m, _REQUESTED, None, None, 0.0, None, None, None) for m in requested], model_meta.schema)
    members = scoring.member_predictions(fx, mf, model_meta.unionByName(asked), ids, requested)
    raw = F.when(F.col("member") != _REQUESTED, F.col("raw"))
    return members.groupBy(*ids, "model").agg(
        X.stable(X.exact_avg(raw)).alias("raw"), F.max("cv_mae").alias("cv_mae"),
        F.max("adj_r2").alias("adj_r2"), F.max("oil_factor").alias("oil_factor"))


def prediction_report(weather: DataFrame, harvest: DataFrame, model_feature: DataFrame,
                      model_meta: DataFrame, requested: list[str],
                      target_year: int = DEFAULT_TARGET_YEAR, registry: dict[str, dict] = MODEL_REGISTRY) -> DataFrame:
    """One row per (site, requested model).

    ``registry`` says which models exist and how they are scored, the model tables
    which of them are trained.  A simple model without trained members gets the
    fixed prediction, an ensemble without them an error; a name that is not in
    the registry gets nothing but ``error`` = "Unknown model. Available: [...]".
    All models are scored in one pass, without a cross join.
    """
    requested = list(dict.fromkeys(requested))
    simple = [m for m, r in registry.items() if r["kind"] == "simple"]
    scored = _scored_models(weather, model_feature, model_meta, requested, simple, target_year)
    is_simple, known = F.col("model").isin(*simple), F.col("model").isin(*registry)
    error = (F.when(~known, F.lit(f"Unknown model. Available: {list(registry)}"))
              .when(~is_simple & F.col("raw").isNull(), F.lit(ENSEMBLE_NO_MODEL)))
    ens = _ensemble_result("raw")
    result = {n: F.when(error.isNull(), F.when(is_simple, c).otherwise(ens[n])) for n, c in _simple_result().items()}
    of_model = lambda k: F.coalesce(*[F.when(F.col("model") == m, F.lit(r[k])) for m, r in registry.items()])
    nothing = F.lit(0).cast("bigint")
    if_known = lambda c: F.when(known, F.col(c))
    return scored.join(last_harvest(harvest), "site", "left").select(
        "site", "model", of_model("name").alias("model_info_name"), of_model("description").alias("model_info_description"),
        if_known("harvest_year").cast("int").alias("harvest_year"),
        if_known("weather_year").cast("int").alias("weather_year_used"),
        F.coalesce(result["harvest_kg"], nothing).alias("harvest_kg"), F.coalesce(result["oil_kg"], nothing).alias("oil_kg"),
        *[result[n].alias(n) for n in ("ci_kg", "cv_mae", "r2", "model_name")],
        error.alias("error"),
        *[if_known(c).alias(c) for c in ("last_year", "last_harvest", "last_oil", "last_trees")])
