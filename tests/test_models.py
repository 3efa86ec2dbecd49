"""Least squares from sums, rolling origin, tree members and permutation importance against plain re-computations."""
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from grovecast.operators import trees
from grovecast.plans import fit, importance

NAMES = ["a", "b"]


@pytest.fixture(scope="module")
def pairs(spark):
    rng = random.Random(4)
    rows = [(f"s{i % 4}", 2000 + i // 4, rng.uniform(0, 100), rng.uniform(-5, 5)) for i in range(40)]
    rows = [(s, y, a, None if k == 7 else b, 3 * a - 20 * (b if k != 7 else 0) + rng.gauss(0, 5)) for k, (s, y, a, b) in enumerate(rows)]
    return rows, spark.createDataFrame(rows + [("s9", 2003, 1.0, 1.0, None)], "site string, year int, a double, b double, label double")


def plain_fit(rows):
    x = np.array([[1.0, a, b or 0.0] for _, _, a, b, _ in rows])
    return np.linalg.lstsq(x, np.array([r[4] for r in rows]), rcond=None)[0]


def plain_value(beta, row):
    return beta[0] + beta[1] * row[2] + beta[2] * (row[3] or 0.0)


def test_fit_from_sums_equals_least_squares(pairs):
    rows, df = pairs
    feats, meta = fit.fit_linear(df, NAMES, "m")
    got, m = {r["feature"]: r for r in feats.collect()}, meta.first()
    beta = plain_fit(rows)
    for n, k in zip(NAMES, (1, 2)):
        assert got[n]["coef"] / got[n]["scale"] == pytest.approx(beta[k], rel=1e-7)
    assert m["intercept"] - sum(r["coef"] * r["mean"] / r["scale"] for r in got.values()) == pytest.approx(beta[0], rel=1e-6)
    fold = lambda r: int(hashlib.md5(f"{r[0]}|{r[1]}".encode()).hexdigest()[:8], 16) % 3
    maes = []
    for k in range(3):
        own = plain_fit([r for r in rows if fold(r) != k])
        errors = [abs(r[4] - plain_value(own, r)) for r in rows if fold(r) == k]
        maes.append(sum(errors) / len(errors))
    assert m["cv_mae"] == pytest.approx(sum(maes) / 3, rel=1e-7)
    sse = sum((r[4] - plain_value(beta, r)) ** 2 for r in rows)
    sst = sum((r[4] - np.mean([x[4] for x in rows])) ** 2 for r in rows)
    assert m["adj_r2"] == pytest.approx(1 - sse / sst * (len(rows) - 1) / (len(rows) - 3), abs=1e-9)


def test_fit_does_not_depend_on_partitions(pairs):
    _, df = pairs
    one, many = (fit.fit_linear(df.repartition(n), NAMES, "m")[0].orderBy("feature").collect() for n in (1, 7))
    assert one == many


def test_fit_without_rows_and_with_constant_features(spark, pairs):
    _, df = pairs
    feats, meta = fit.fit_linear(df.limit(0), NAMES, "m")
    assert feats.count() == 0 and meta.count() == 0
    feats, _ = fit.fit_linear(df.withColumn("b", F.lit(2.0)), NAMES, "m", folds=0)
    got = {r["feature"]: r for r in feats.collect()}
    assert got["b"]["coef"] == pytest.approx(0) and got["b"]["scale"] == 1.0 and got["a"]["coef"] > 0


def test_rolling_origin_uses_earlier_years_only(pairs):
    rows, df = pairs
    got = {(r["site"], r["year"]): r for r in fit.rolling_origin(df, NAMES).collect()}
    assert {y for _, y in got} == set(range(2002, 2010))  # the first 6 earlier pairs are there from 2002 on
    for r in rows:
        if r[1] >= 2002:
            before = [x for x in rows if x[1] < r[1]]
            g = got[r[0], r[1]]
            assert g["n_train"] == len(before)
            assert g["predicted"] == pytest.approx(max(0.0, plain_value(plain_fit(before), r)), rel=1e-6, abs=1e-6)


# -- trees -------------------------------------------------------------------------------
@pytest.mark.parametrize("kind", ["forest", "boosted"])
def test_native_walk_equals_the_fitted_model(spark, pairs, kind):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
    _, df = pairs
    nodes, combine = trees.fit_trees(df, NAMES, "m", kind, kind, trees=5, depth=3)
    got = trees.member_predictions(df.drop("label"), nodes, combine, ["site", "year"], ["m"])
    data = VectorAssembler(inputCols=NAMES, outputCol="_z").transform(df.na.fill(0.0, subset=NAMES))
    common = dict(featuresCol="_z", labelCol="label", maxDepth=3, seed=1)
    est = RandomForestRegressor(numTrees=5, **common) if kind == "forest" else GBTRegressor(maxIter=5, **common)
    want = est.fit(data.where("label is not null")).transform(data)
    both = got.join(want.select("site", "year", "prediction"), ["site", "year"]).collect()
    assert len(both) == 41
    for r in both:
        assert r["raw"] == pytest.approx(r["prediction"], abs=1e-6)


def test_walk_edges(spark):
    """A tree that is one leaf, a chain, a value on the threshold, a missing feature and a missing value."""
    leaf = [("m", "leaf", 0, 0, None, None, None, None, 7.0, 1.0)]
    chain = [("m", "chain", 0, 2 * k, "a", float(k), 2 * k + 1, 2 * k + 2, None, 1.0) for k in range(6)]
    chain += [("m", "chain", 0, 2 * k + 1, None, None, None, None, float(k), 1.0) for k in range(6)] + [("m", "chain", 0, 12, None, None, None, None, 99.0, 1.0)]
    gone = [("m", "gone", 0, 0, "absent", -1.0, 1, 2, None, 1.0), ("m", "gone", 0, 1, None, None, None, None, 1.0, 1.0), ("m", "gone", 0, 2, None, None, None, None, 2.0, 1.0)]
    nodes = spark.createDataFrame(leaf + chain + gone, trees.NODE)
    combine = spark.createDataFrame([("m", n, "mean", 0.5) for n in ("leaf", "chain", "gone")], trees.COMBINE)
    rows = spark.createDataFrame([(1, 0.0), (2, 3.0), (3, 3.5), (4, 50.0), (5, None)], "id int, a double")
    got = {(r["id"], r["member"]): r["raw"] for r in trees.member_predictions(rows, nodes, combine, ["id"], ["m", "other"]).collect()}
    assert [got[k, "leaf"] for k in range(1, 6)] == [7.5] * 5
    assert [got[k, "chain"] for k in range(1, 6)] == [0.5, 3.5, 4.5, 99.5, 0.5]
    assert [got[k, "gone"] for k in range(1, 6)] == [2.5] * 5
    assert trees.member_predictions(rows.limit(0), nodes, combine, ["id"], ["m"]).count() == 0


# -- importance -------------------------------------------------------------------------------
def test_permutation_importance_by_hand(spark, pairs):
    rows, df = pairs
    mf = spark.createDataFrame([("m", "x", "a", 10.0, 2.0, 6.0), ("m", "y", "a", 0.0, 1.0, 1.0), ("m", "x", "b", 0.0, 1.0, -20.0)],
                               "model string, member string, feature string, mean double, scale double, coef double")
    meta = spark.createDataFrame([("m", k, "n", "d", 1.0, None, None, None) for k in "xy"],
                                 "model string, member string, name string, description string, intercept double, oil_factor double, cv_mae double, adj_r2 double")
    got = {r["feature"]: r for r in importance.permutation_importance(df, mf, meta, ["site", "year"]).collect()}
    predict = lambda a, b: ((1 + 3 * (a - 10) - 20 * b) + (1 + a)) / 2
    value = [(r[2], r[3] or 0.0) for r in rows]
    own = [abs(r[4] - predict(*v)) for r, v in zip(rows, value)]
    for k, feature in enumerate(NAMES):
        order = sorted(range(len(rows)), key=lambda i: hashlib.md5(f"1|{feature}|{rows[i][0]}|{rows[i][1]}".encode()).hexdigest())
        after = {i: j for i, j in zip(order, order[1:] + order[:1])}
        dealt = [abs(rows[i][4] - predict(*[value[after[i]][c] if c == k else value[i][c] for c in (0, 1)])) for i in range(len(rows))]
        assert got[feature]["importance"] == pytest.approx(np.mean(dealt) - np.mean(own), abs=1e-3)
        assert got[feature]["n_rows"] == len(rows) and got[feature]["base_mae"] == pytest.approx(np.mean(own), abs=1e-3)
    assert sorted(r["rank"] for r in got.values()) == [1, 2]


def test_importance_in_blocks_deals_every_value_once(spark, pairs):
    """Whatever the blocks, a feature that decides nothing is worth nothing, and every row counts."""
    _, df = pairs
    mf = spark.createDataFrame([("m", "x", "a", 0.0, 1.0, 0.0)], "model string, member string, feature string, mean double, scale double, coef double")
    meta = spark.createDataFrame([("m", "x", "n", "d", 1.0, None, None, None)],
                                 "model string, member string, name string, description string, intercept double, oil_factor double, cv_mae double, adj_r2 double")
    r = importance.permutation_importance(df, mf, meta, ["site", "year"], block_rows=7).collect()
    assert len(r) == 1 and r[0]["importance"] == 0 and r[0]["n_rows"] == 40
