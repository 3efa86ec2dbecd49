"""Model fitting into model tables (R6) and a per-site regression check.

The service only reads trained models (its trainer is not shipped); the
outputs it expects are a scaler (mean, scale per feature), a linear model
(intercept, coefficients), ``cv_mae`` and ``adj_r2``.  :func:`fit_linear`
produces exactly those as rows of ``model_feature`` / ``model_meta``, so the
scoring operators can use a fitted model directly.

* Training pairs are the features of a weather year joined with the harvest
  of the next year (equi-join on site and year + 1).
* Scaler (mean, *population* deviation), coefficients on the scaled features, intercept, R² and
  the fits without each fold all come from one aggregate of the pairs per fold
  (``plans.normal``): every fold is solved from the sums of the others, nothing is refitted and
  nothing is collected to the driver.
* ``cv_mae`` is the mean over the folds of the mean absolute error on the rows of the
  fold, ``adj_r2`` the adjusted R² of the fit on all pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovecast.functions import expressions as X
from grovecast.plans import normal


def training_pairs(features: DataFrame, harvest: DataFrame, label: str = "harvest_kg") -> DataFrame:
    """Features of weather year y with the harvest of year y + 1."""
    h = harvest.select("site", (F.col("year") - 1).cast("int").alias("year"), F.col(label).alias("label"))
    return features.join(h, ["site", "year"])


def fit_linear(train: DataFrame, names: list[str], model: str, member: str = "lin",
               folds: int = 3) -> tuple[DataFrame, DataFrame]:
    """Fit scaler + linear regression; return (model_feature rows, model_meta rows).

    ``train`` (the named features and ``label``) is read once for the sums and, with ``folds`` of 2 or
    more, once for the errors.  Without any labelled row there are no rows."""
    key = [c for c in ("site", "year") if c in train.columns] or ["label", *names]
    rows = train.where("label is not null").withColumn("fold", normal.fold_of(key, folds))
    stats = normal.statistics(rows, names, "label", "fold")
    # every fold's sums go to the fits that leave it in: all (-1) and those of the other folds
    others = [f for f in range(folds)] if folds >= 2 else []
    to = stats.withColumn("fit", F.explode(F.array(*[F.lit(f) for f in [-1, *others]]))).where("fit <> fold")
    fits = normal.solve(normal.sums(to, "fit", names), names, "fit")
    whole = fits.where("fit = -1")
    n, p = F.col("n"), len(names)
    adj = F.when(n - p - 1 > 0, 1.0 - (1.0 - F.col("r2")) * (n - 1) / (n - p - 1))
    meta = whole.select(
        F.lit(model).alias("model"), F.lit(member).alias("member"), F.lit(f"Fitted linear model ({model})").alias("name"),
        F.format_string("R²=%.2f on %d pairs", "r2", "n").alias("description"), "intercept",
        F.lit(None).cast("double").alias("oil_factor"), "n", adj.alias("adj_r2"))
    if others:
        own = fits.where("fit >= 0").select(F.col("fit").alias("fold"), "mean", "scale", "coef", "intercept")
        errors = rows.join(own, "fold").groupBy("fold").agg(X.exact_avg(F.abs(F.col("label") - normal.predicted(names))).alias("mae"))
        # two rows of one member, put together by an aggregate: there is no key to join them on
        cv = errors.agg(F.avg("mae").alias("cv_mae")).select(F.lit(model).alias("model"), F.lit(member).alias("member"), "cv_mae")
        both = meta.unionByName(cv, allowMissingColumns=True)
        meta = both.groupBy("model", "member").agg(*[F.max(c).alias(c) for c in both.columns if c not in ("model", "member")]).where("n is not null")
        meta = meta.withColumn("cv_mae", F.when(n >= folds, F.col("cv_mae")))
    else:
        meta = meta.withColumn("cv_mae", F.lit(None).cast("double"))
    at = F.arrays_zip(F.array(*[F.lit(x) for x in names]).alias("feature"), "mean", "scale", "coef")
    feats = whole.select(F.explode(at).alias("f")).select(F.lit(model).alias("model"), F.lit(member).alias("member"), "f.feature", "f.mean", "f.scale", "f.coef")
    return feats, meta.select("model", "member", "name", "description", "intercept", "oil_factor", "cv_mae", "adj_r2")


def rolling_origin(train: DataFrame, names: list[str], min_rows: int | None = None) -> DataFrame:
    """Every pair predicted by the fit on the pairs of earlier years only (R5): site, year (of the weather),
    n_train, predicted (not below 0), label, abs_error.  Years with fewer than ``min_rows``
    earlier pairs (default: twice the number of coefficients) are not predicted.

    The sums are one row per year; running sums over these rows give every year's fit."""
    least = 2 * (len(names) + 1) if min_rows is None else min_rows
    stats = normal.statistics(train, names, "label", "year")
    fits = normal.solve(normal.sums_before(stats, "year", names).where(F.col("n") >= least), names, "year")
    rows = train.where("label is not null").join(fits, "year")
    value = X.clamp_low(normal.predicted(names))
    return rows.select("site", "year", F.col("n").alias("n_train"), value.alias("predicted"), "label",
                       F.abs(value - F.col("label")).alias("abs_error"))


def regression_check(train: DataFrame, x: str, digits: int = 6) -> DataFrame:
    """Per site single-feature least squares of the label on ``x``
    (``regr_slope`` / ``regr_intercept`` / ``regr_r2``), rounded to ``digits``
    because the moment updates run in a partition-dependent order."""
    return train.groupBy("site").agg(
        F.regr_count("label", x).alias("n"),
        F.bround(F.regr_slope("label", x), digits).alias("slope"),
        F.bround(F.regr_intercept("label", x), digits).alias("intercept"),
        F.bround(F.regr_r2("label", x), digits).alias("r2"))
