"""Permutation importance of linear models, from the data.

How much worse does a model predict when one feature's values are dealt to other rows?  For
every feature the rows are put into an order that a seeded hash of their key decides, and each
row takes the value of the next one (the last that of the first): a rank-shifted
self-join, so nothing is shuffled by a random generator and every engine and partitioning gives
the same figure.  A linear model's prediction moves by ``slope * (other value - own value)``, so the
rows are scored once.  The importance is the mean absolute error with the dealt values less that with
the own ones.

Rows are ordered within blocks of about ``block_rows`` (by a hash of their key), so no task
orders all rows of a feature.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from grovecast.functions import expressions as X
from grovecast.operators import scoring

BLOCK_ROWS = 1 << 16


def shuffle_key(seed: int, ids: list[str]) -> Column:
    """The place of a row in its feature's order: a hash of seed, feature and key, as text."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("feature"), *[F.col(c).cast("string") for c in ids]).cast("binary"))


def slopes(model_feature: DataFrame, model_meta: DataFrame) -> DataFrame:
    """model, feature, slope: what a model's prediction (mean of its members) gains per unit of a feature."""
    members = model_meta.groupBy("model").agg(F.countDistinct("member").alias("n_members"))
    own = model_feature.groupBy("model", "feature").agg(X.exact_sum(F.col("coef") / F.col("scale")).alias("s"))
    return own.join(members, "model").select("model", "feature", (F.col("s") / F.col("n_members")).alias("slope"))


def permutation_importance(rows: DataFrame, model_feature: DataFrame, model_meta: DataFrame, ids: list[str], label: str = "label",
                           seed: int = 1, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """model, feature, rank (1: the most important), importance, base_mae, n_rows for the features of ``rows``
    that the models use.  Rows without a label are left out; a missing value is 0."""
    names = [c for c in rows.columns if c not in ids and c != label]
    scored = rows.where(F.col(label).isNotNull())
    blocks = max(1, math.ceil(scored.count() / block_rows))
    raw = scoring.member_predictions(scored.drop(label), model_feature, model_meta, ids, catalog=names)
    base = raw.groupBy(*ids, "model").agg(X.stable(X.exact_avg("raw")).alias("base"))
    long = scoring.to_long(scored, [*ids, label], names).where(F.col("feature") != scoring.BIAS)
    long = long.select(*ids, label, "feature", F.coalesce("value", F.lit(0.0)).alias("value"),
                       F.pmod(F.xxhash64(*ids), F.lit(blocks)).alias("block"))
    # only features that a model uses are ordered
    used = slopes(model_feature, model_meta)
    long = long.join(used.select("feature").distinct(), "feature", "left_semi")
    part = Window.partitionBy("feature", "block")
    placed = long.withColumns({"place": F.row_number().over(part.orderBy(shuffle_key(seed, ids), *ids)), "size": F.count(F.lit(1)).over(part)})
    other = placed.select("feature", "block", F.col("place").alias("next"), F.col("value").alias("other"))
    dealt = placed.withColumn("next", F.col("place") % F.col("size") + 1).join(other, ["feature", "block", "next"])
    moved = dealt.join(used, "feature").join(base, [*ids, "model"])
    changed = F.col("base") + F.col("slope") * (F.col("other") - F.col("value"))
    out = moved.groupBy("model", "feature").agg(
        X.exact_avg(F.abs(F.col(label) - changed)).alias("with_dealt"), X.exact_avg(F.abs(F.col(label) - F.col("base"))).alias("own"),
        F.count(F.lit(1)).alias("n_rows"))
    gain = F.bround(F.col("with_dealt") - F.col("own"), 4)
    rank = F.row_number().over(Window.partitionBy("model").orderBy(F.col("importance").desc(), "feature"))
    return (out.select("model", "feature", gain.alias("importance"), F.bround("own", 4).alias("base_mae"), "n_rows")
            .withColumn("rank", rank.cast("int")))
