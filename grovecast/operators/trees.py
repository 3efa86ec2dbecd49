"""Tree ensembles as ensemble members (D4, R6): node tables, scored natively.

A fitted forest or boosted ensemble is rows of a node table (model, member, tree, node, feature,
threshold, left_node, right_node, value): nodes are numbered from 0 in each tree, children after their parent,
a leaf has no feature.  How a member's trees are combined is a row of a second table (model, member,
combine, base): ``mean`` of the trees, or ``sum`` of ``weight * value`` over them, plus ``base``.

Scoring: the nodes of a tree are collected into an array (bounded by the model, not by the
data), a feature row carries the values of the used features as an array, and ``aggregate`` walks
from the root as many steps as the deepest tree has, inside the JVM.  A value up to the threshold
goes left; a missing value counts as 0, as in linear scoring.  Feature rows meet the models by an
equi-join on the model's name, which every row lists for itself.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grovecast.functions import expressions as X
from grovecast.session import ensure_checkpoint_dir

NODE = ("model string, member string, tree int, node int, feature string, threshold double, "
        "left_node int, right_node int, value double, weight double")
COMBINE = "model string, member string, combine string, base double"


def feature_names(nodes: DataFrame, catalog: list[str] | None = None) -> list[str]:
    """The features that the trees read (model metadata, bounded by the catalogue)."""
    used = nodes.where(F.col("feature").isNotNull())
    if catalog is not None:
        used = used.where(F.col("feature").isin(*catalog))
    return sorted(r["feature"] for r in used.select("feature").distinct().collect())


def _depth(nodes: Column) -> Column:
    """Steps from the root to the deepest leaf: children come after their parent."""
    def below(depth: Column, n: Column) -> Column:
        down = F.get(depth, n["node"]) + 1
        return F.when(n["left_node"].isNull(), depth).otherwise(
            F.transform(depth, lambda d, i: F.when((i == n["left_node"]) | (i == n["right_node"]), down).otherwise(d)))
    return F.array_max(F.aggregate(nodes, F.array_repeat(F.lit(0), F.size(nodes)), below))


def tree_sets(nodes: DataFrame, names: list[str]) -> DataFrame:
    """model, member, trees: array of (nodes, depth, weight)."""
    at = F.array_position(F.array(*[F.lit(n) for n in names]).cast("array<string>"), F.col("feature")).cast("int") - 1
    items = F.sort_array(F.collect_list(F.struct("node", at.alias("x"), "threshold", "left_node", "right_node", "value"))).alias("nodes")
    per = nodes.groupBy("model", "member", "tree").agg(items, F.max("weight").alias("weight"))
    tree = F.struct("tree", "nodes", _depth(F.col("nodes")).alias("depth"), "weight")
    return per.groupBy("model", "member").agg(F.sort_array(F.collect_list(tree)).alias("trees"))


def walk(nodes: Column, depth: Column, values: Column) -> Column:
    """The value of the leaf that ``values`` (by position) leads to."""
    def step(n: Column, _: Column) -> Column:
        left = F.coalesce(F.get(values, n["x"]), F.lit(0.0)) <= n["threshold"]
        return F.when(n["left_node"].isNull(), n).otherwise(F.get(nodes, F.when(left, n["left_node"]).otherwise(n["right_node"])))
    return F.aggregate(F.sequence(F.lit(1), F.greatest(depth, F.lit(1))), F.get(nodes, F.lit(0)), step, lambda n: n["value"])


def member_predictions(features: DataFrame, nodes: DataFrame, combine: DataFrame, ids: list[str],
                       models: list[str]) -> DataFrame:
    """ids, model, member, raw (9-digit stable) for every feature row and tree member."""
    names = feature_names(nodes, [c for c in features.columns if c not in ids])
    sets = tree_sets(nodes.where(F.col("model").isin(*models)), names).join(combine, ["model", "member"])
    values = F.array(*[F.col(n).cast("double") for n in names]).cast("array<double>")
    rows = features.select(*ids, values.alias("_x"), F.explode(F.array(*[F.lit(m) for m in models])).alias("model"))
    got = rows.join(sets, "model")
    each = F.transform("trees", lambda t: walk(t["nodes"], t["depth"], F.col("_x")) * F.when(F.col("combine") == "sum", t["weight"]).otherwise(F.lit(1.0)))
    total = F.aggregate(each, F.lit(0.0).cast(X.EXACT_SQL), lambda a, v: (a + v.cast(X.EXACT_SQL)).cast(X.EXACT_SQL)).cast("double")
    raw = F.coalesce("base", F.lit(0.0)) + F.when(F.col("combine") == "mean", total / F.size("trees")).otherwise(total)
    return got.select(*ids, "model", "member", X.stable(raw).alias("raw"))


def fit_trees(train: DataFrame, names: list[str], model: str, member: str, kind: str = "forest", seed: int = 1,
              trees: int = 20, depth: int = 4) -> tuple[DataFrame, DataFrame]:
    """Fit a ``forest`` or ``boosted`` member with ``pyspark.ml`` on the named features and ``label``; return its
    node rows and its combine row.  The fitted model goes through the shared folder as
    written tables, nothing is collected."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
    spark = train.sparkSession
    data = VectorAssembler(inputCols=names, outputCol="_z").transform(train.where("label is not null").na.fill(0.0, subset=names))
    common = dict(featuresCol="_z", labelCol="label", maxDepth=depth, seed=seed)
    estimator = RandomForestRegressor(numTrees=trees, **common) if kind == "forest" else GBTRegressor(maxIter=trees, **common)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/grovecast-trees-{uuid.uuid4().hex[:12]}"
    fitted = estimator.fit(data.select("_z", "label"))
    fitted.write().save(path)
    n = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*")
    feature = F.get(F.array(*[F.lit(x) for x in names]), F.col("split.featureIndex"))
    inner = F.col("leftChild") >= 0
    weight = F.get(F.array(*[F.lit(float(w)) for w in fitted.treeWeights]), F.col("treeID"))
    nodes = n.select(
        F.lit(model).alias("model"), F.lit(member).alias("member"), F.col("treeID").alias("tree"), F.col("id").alias("node"),
        F.when(inner, feature).alias("feature"), F.when(inner, F.get("split.leftCategoriesOrThreshold", F.lit(0))).alias("threshold"),
        F.when(inner, F.col("leftChild")).alias("left_node"), F.when(inner, F.col("rightChild")).alias("right_node"),
        F.col("prediction").alias("value"), weight.alias("weight"))
    how = "mean" if kind == "forest" else "sum"
    return nodes, spark.createDataFrame([(model, member, how, 0.0)], COMBINE)
