"""Model catalogue and model info (read model tables only, so not registered)."""
from grovecast import schemas
from grovecast.plans import reports as R
from grovecast.sources import fixtures as fx


def test_model_catalogue(spark):
    cat = {r.model: r for r in R.model_catalogue(fx.model_meta(spark), fx.model_feature(spark)).collect()}
    assert set(cat) == {"simple", "complex", "legacy"}
    assert cat["simple"].features == ["Clouds_Oct", "Clouds_Sep", "Rain_Jan"]
    assert cat["complex"].members == ["a", "b"]


def test_model_info_top_features(spark):
    imp = spark.createDataFrame([("m", i, f"f{i}", 1.0 / i) for i in range(1, 15)], schemas.FEATURE_IMPORTANCE)
    meta = spark.createDataFrame([("m", "x", "M", "d", 1.0, None, None, None)], schemas.MODEL_META)
    feats = spark.createDataFrame([("m", "x", f"f{i}", 0.0, 1.0, 1.0) for i in range(1, 15)], schemas.MODEL_FEATURE)
    info = R.model_info(meta, feats, imp).collect()[0]
    assert info.feature_count == 14
    assert [t.rank for t in info.top_features] == list(range(1, 11))


def test_model_info_with_fixture_tables(spark):
    info = {r.model: r for r in R.model_info(fx.model_meta(spark), fx.model_feature(spark),
                                             fx.feature_importance(spark)).collect()}
    assert info["complex"].feature_count == 5
    assert [t.feature for t in info["complex"].top_features] == ["Sun_Hours", "Clouds", "Rain_winter", "Temp_spring"]
    assert info["simple"].top_features is None
