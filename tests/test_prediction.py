"""Predictions and reports on hand-built edge tables (harvest_edge, models_edge)."""
from grovecast import schemas
from grovecast.functions import expressions as X
from grovecast.plans import prediction as P
from grovecast.plans import reports as R
from grovecast.sources import fixtures as fx
from grovecast.sources.harvest import harvest_clean
from tests.helpers import days, wx


def _weather(spark):
    recs = [dict(site="S", obs_date=d, avg_temp=15.0, rain=2.0, clouds=40.0) for d in days("2024-01-01", 366)]
    recs += [dict(site="S", obs_date=d, avg_temp=12.0, rain=1.0, clouds=30.0) for d in days("2023-09-01", 30)]
    return wx(spark, recs)


def _no_models(spark):
    return (spark.createDataFrame([], schemas.MODEL_FEATURE), spark.createDataFrame([], schemas.MODEL_META))


def test_year_choice(spark):
    w = _weather(spark)
    y = P.choose_years(w, 2026).collect()[0]
    assert (y.weather_year, y.harvest_year) == (2024, 2025)      # 2025 absent: last year + 1
    y2 = P.choose_years(w, 2024).collect()[0]
    assert (y2.weather_year, y2.harvest_year) == (2023, 2024)


def test_no_model_constants_and_tie_rounding(spark):
    r = P.predict_simple(_weather(spark), *_no_models(spark)).collect()[0]
    # 950 kg, oil round(142.5) = 142 (half to even), band 2 x 200
    assert (r.harvest_kg, r.oil_kg, r.ci_kg, r.cv_mae, r.r2) == (950, 142, 400, 200.0, 0.0)
    assert r.rain_jan == 62.0 and r.clouds_sep == 40.0


def test_simple_cloud_fallback_uses_all_years(spark):
    recs = [dict(site="S", obs_date=d, clouds=20.0) for d in days("2023-09-01", 10)]
    recs += [dict(site="S", obs_date=d, clouds=50.0) for d in days("2022-09-01", 30)]
    recs += [dict(site="S", obs_date="2024-02-01", avg_temp=1.0)]
    r = P.predict_simple(wx(spark, recs), *_no_models(spark)).collect()[0]
    assert r.weather_year_used == 2024 and r.rain_jan == 0.0
    assert r.clouds_sep == round((10 * 20 + 30 * 50) / 40, 9)      # row mean, not mean of means
    assert r.clouds_oct is None


def test_model_without_features_scores_intercept(spark):
    mf = spark.createDataFrame([], schemas.MODEL_FEATURE)
    mm = spark.createDataFrame([("bare", "m", "Bare", "no features", 777.0, 0.5, None, None)], schemas.MODEL_META)
    r = P.predict_ensemble(_weather(spark), mf, mm, model="bare").collect()[0]
    assert r.harvest_kg == 777 and r.oil_kg == 388 and r.individual_predictions == {"m": 777}


def test_report_unknown_model(spark):
    h = harvest_clean(spark.createDataFrame([("S", 2023, 200.0, 1000.0, 200.0, 5.0)], schemas.HARVEST_RAW))
    registry = {m: dict(kind="simple" if m == "simple" else "ensemble", name=m, description=m)
                for m in ("complex", "legacy", "simple")}
    rep = {r.model: r for r in P.prediction_report(_weather(spark), h, fx.model_feature(spark),
                                                   fx.model_meta(spark), ["simple", "nope"], registry=registry).collect()}
    assert rep["nope"].error == "Unknown model. Available: ['complex', 'legacy', 'simple']"
    assert rep["nope"].harvest_kg == 0 and rep["nope"].oil_kg == 0 and rep["nope"].r2 is None
    assert rep["simple"].error is None and rep["simple"].last_trees == 200
    d = R.dashboard(_weather(spark), h, fx.model_feature(spark), fx.model_meta(spark), "nope").collect()[0]
    assert (d.ensemble_kg, d.estimated_oil_kg, d.ci_kg, d.harvest_per_tree_kg) == (0, 0, 0, 0.0)
    assert d.year is None and d.last_year is None and d.error == "Unknown model. Available: ['simple', 'complex']"


def test_report_known_models_without_artefact(spark):
    h = harvest_clean(spark.createDataFrame([("S", 2023, 200.0, 1000.0, 200.0, 5.0)], schemas.HARVEST_RAW))
    rep = {r.model: r for r in P.prediction_report(_weather(spark), h, *_no_models(spark), ["simple", "complex"]).collect()}
    s, c = rep["simple"], rep["complex"]
    assert (s.harvest_kg, s.oil_kg, s.ci_kg, s.cv_mae, s.r2, s.error) == (950, 142, 400, 200.0, 0.0, None)
    assert (c.harvest_kg, c.oil_kg, c.ci_kg, c.error) == (0, 0, None, "Complex model not available")
    assert c.last_year == 2023 and c.harvest_year == s.harvest_year


def test_history_oil_share_edges(spark):
    raw = spark.createDataFrame([
        ("S", 2001, 200.0, 825.0, 166.0, 4.969879518),   # oil / harvest_kg
        ("S", 2002, 180.0, 0.0, 10.0, 0.05),             # harvest_kg 0 -> ratio x 100
        ("S", 2003, 180.0, 100.0, 0.0, 0.2),             # oil 0 -> ratio x 100
        ("S", 2004, 180.0, 0.0, 0.0, 0.0),               # nothing -> stored ratio
        ("S", 2005, 185.0, 10.0, None, 1.0)], schemas.HARVEST_RAW)  # NULL -> dropped by the scan
    h = harvest_clean(raw)
    assert h.count() == 4 and dict((r.year, r.trees) for r in h.collect())[2001] == 200
    got = {r.year: r.ratio for r in R.history(h).collect()}
    assert got == {2001: 20.1, 2002: 5.0, 2003: 20.0, 2004: 0.0}


def test_half_even_rounding(spark):
    df = spark.createDataFrame([(142.5,), (143.5,), (0.25,), (0.35,), (2.675,)], "x double")
    got = [r.y for r in df.select(X.round_half_even("x", 0).alias("y")).collect()]
    assert got[:2] == [142.0, 144.0]
    got1 = [r.y for r in df.select(X.round_half_even("x", 1).alias("y")).collect()]
    assert got1[2:4] == [0.2, 0.4]


def test_choose_model_by_preference(spark):
    mm = fx.model_meta(spark)
    assert P.choose_model(mm, ["missing", "complex", "simple"]).collect()[0].model == "complex"
    assert P.choose_model(mm, ["nothing"]).collect()[0].model is None
    legacy = P.predict_legacy(_weather(spark), harvest_clean(spark.createDataFrame(
        [("S", 2024, 180.0, 900.0, 180.0, 5.0)], schemas.HARVEST_RAW)),
        fx.model_feature(spark), mm, model=["nope", "legacy"]).collect()[0]
    assert legacy.trees == 180 and legacy.year == 2024 and legacy.avg_oil_ratio == 5.0


def test_legacy_without_model_reports_error(spark):
    h = harvest_clean(spark.createDataFrame([("S", 2024, 180.0, 900.0, 180.0, 5.0)], schemas.HARVEST_RAW))
    r = P.predict_legacy(_weather(spark), h, *_no_models(spark)).collect()[0]
    assert r.error == "Models not trained" and r.ensemble_kg is None and r.trees == 180


def test_json_records(spark):
    import json
    h = harvest_clean(spark.createDataFrame([("S", 2024, 180.0, 900.0, 180.0, 5.0)], schemas.HARVEST_RAW))
    rec = R.as_json_records(R.history(h)).collect()[0]
    assert rec.site == "S" and json.loads(rec.json)["ratio"] == 20.0
