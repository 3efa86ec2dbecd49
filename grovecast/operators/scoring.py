"""Scoring of linear model members held as tables.

A member is ``intercept + sum(coef * (x - mean) / scale)`` over its
features (standard scaling followed by a linear model).  Models are rows of
``model_feature`` (model, member, feature, mean, scale, coef) and
``model_meta`` (model, member, intercept, oil_factor, cv_mae, adj_r2, ...).

Plan: the wide feature rows are turned into (ids, feature, value) rows by a
``Generate`` (never materialised: it streams into the join), joined on
``feature`` with the small coefficient table, and summed per
(ids, model, member) with map-side partial aggregation.  To give every
member exactly one row per feature row *without a cross join*, each
feature row also emits a synthetic bias feature (value 1) and each member
gets one bias term whose coefficient is its intercept plus the constant
contribution of the features it names that the feature table does not have
(those are 0 after ``fillna(0)``).  A member without any feature therefore
scores its intercept.

Broadcasting is left to the planner's size check: Spark broadcasts a side
only when its size statistics are under ``autoBroadcastJoinThreshold``
(exact for literal tables, file sizes for stored ones) and AQE re-checks the
measured size at run time; beyond that the join stays a sort-merge join.
Model tables are small by nature, but nothing here forces a broadcast on an
unchecked table.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grovecast.functions import expressions as X

BIAS = "__bias__"


def to_long(features: DataFrame, ids: Iterable[str], names: list[str]) -> DataFrame:
    """(ids..., feature, value) rows, plus one bias row per feature row."""
    ids = list(ids)
    items = [F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("value")) for n in names]
    items.append(F.struct(F.lit(BIAS).alias("feature"), F.lit(1.0).alias("value")))
    return features.select(*ids, F.inline(F.array(*items)))


def model_terms(model_feature: DataFrame, model_meta: DataFrame, names: list[str],
                models: list[str] | None = None) -> DataFrame:
    """Coefficient rows for the join: present features + one bias row per member."""
    mf, meta = model_feature, model_meta
    if models is not None:
        mf = mf.filter(F.col("model").isin(*models))
        meta = meta.filter(F.col("model").isin(*models))
    present = F.col("feature").isin(*names)
    missing = (mf.filter(~present)
                 .groupBy("model", "member")
                 .agg(X.exact_sum(F.col("coef") * (F.lit(0.0) - F.col("mean")) / F.col("scale")).alias("_miss")))
    bias = (meta.join(missing, ["model", "member"], "left")
                .select("model", "member", F.lit(BIAS).alias("feature"), F.lit(0.0).alias("mean"),
                        F.lit(1.0).alias("scale"),
                        (F.col("intercept") + F.coalesce(F.col("_miss"), F.lit(0.0))).alias("coef")))
    return mf.filter(present).select("model", "member", "feature", "mean", "scale", "coef") \
             .unionByName(bias)


def model_feature_names(model_feature: DataFrame, catalog: Iterable[str], models: list[str] | None = None) -> list[str]:
    """The features of ``catalog`` that the given models use.

    Model metadata, read at plan time so that feature tables compute and
    unpivot only what the models reference; the catalogue bounds the read."""
    mf = model_feature if models is None else model_feature.filter(F.col("model").isin(*models))
    names = mf.filter(F.col("feature").isin(*catalog)).select("feature").distinct().collect()
    return sorted(r["feature"] for r in names)


def member_predictions(features: DataFrame, model_feature: DataFrame, model_meta: DataFrame,
                       ids: Iterable[str], models: list[str] | None = None,
                       catalog: list[str] | None = None) -> DataFrame:
    """Raw prediction of every member for every feature row.

    ``catalog`` lists the features that exist (default: the feature
    columns); a model feature outside it is 0 for every row.  Feature columns
    not in ``features`` but in ``catalog`` must not be named by the models.

    Output: ids..., model, member, raw (9-digit stable), plus the member's
    meta columns (name, description, oil_factor, cv_mae, adj_r2).
    """
    ids = list(ids)
    names = [c for c in features.columns if c not in ids]
    if catalog is not None:
        names = [c for c in names if c in set(catalog)]
    terms = model_terms(model_feature, model_meta, names, models)
    long = to_long(features, ids, names)
    contrib = F.col("coef") * (F.coalesce(F.col("value"), F.lit(0.0)) - F.col("mean")) / F.col("scale")
    raw = long.join(terms, "feature").groupBy(*ids, "model", "member") \
              .agg(X.stable(X.exact_sum(contrib)).alias("raw"))
    meta = model_meta.select("model", "member", "name", "description", "oil_factor", "cv_mae", "adj_r2")
    if models is not None:
        meta = meta.filter(F.col("model").isin(*models))
    return raw.join(meta, ["model", "member"])


def ensemble(members: DataFrame, ids: Iterable[str]) -> DataFrame:
    """Mean of the members per (ids, model), clamped after averaging (A20 new)
    and the legacy form: mean of the members clamped and rounded first."""
    ids = list(ids)
    clamped_rounded = X.round_half_even(X.clamp_low("raw"), 0)
    return members.groupBy(*ids, "model").agg(
        X.stable(X.exact_avg("raw")).alias("mean_raw"),
        X.stable(X.exact_avg(clamped_rounded)).alias("mean_clamped_rounded"),
        F.count(F.lit(1)).alias("n_members"),
        F.map_from_entries(F.sort_array(F.collect_list(
            F.struct("member", X.round_half_even("raw", 0).cast("bigint"))))).alias("member_kg"),
        F.map_from_entries(F.sort_array(F.collect_list(
            F.struct("member", clamped_rounded)))).alias("member_kg_clamped"),
        F.min("name").alias("name"),
        F.min("description").alias("description"),
        F.max("oil_factor").alias("oil_factor"),
        F.max("cv_mae").alias("cv_mae"),
        F.max("adj_r2").alias("adj_r2"))


def map_text(m: Column) -> Column:
    """``k=v,...`` in key order: a flat text form of a small per-row map."""
    return F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(
        e["key"], F.lit("="), e["value"].cast("string"))), ",")
