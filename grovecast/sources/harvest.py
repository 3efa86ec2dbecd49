"""Harvest sources.

The current file layout is read by its header (``schemas.HARVEST_FILE``), the older one by
position (``schemas.LEGACY_HARVEST_FILE``); trees are written as ``200.0``.  Values are
cast column by column (no inference; what is no number is null); a file
without a ``site`` column gets the site passed by the caller.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grovecast import schemas

HARVEST_COLUMNS = list(schemas.HARVEST_FILE.values())


def harvest_clean(df: DataFrame) -> DataFrame:
    """Keep site + five columns, drop rows with any NULL, cast year and trees
    to int (truncating, like ``astype(int)``) (S1)."""
    cols = (["site"] if "site" in df.columns else []) + HARVEST_COLUMNS
    return (df.select(*cols).na.drop("any")
              .withColumn("year", F.col("year").cast("int"))
              .withColumn("trees", F.col("trees").cast("int")))


def harvest_clean_legacy(df: DataFrame) -> DataFrame:
    """Legacy cleaning: same columns, NULL rows dropped, only year cast."""
    cols = (["site"] if "site" in df.columns else []) + HARVEST_COLUMNS
    return df.select(*cols).na.drop("any").withColumn("year", F.col("year").cast("int"))


def read_harvest_csv(spark: SparkSession, path: str, site: str | None = None) -> DataFrame:
    """Read harvest CSV file(s) of one layout by header name (S1): extra columns (``price``) or
    another order do not matter."""
    raw = spark.read.option("header", True).csv(path)
    named = raw.select(*(["site"] if site is None else []),
                       *[F.col(h).try_cast("double").alias(c) for h, c in schemas.HARVEST_FILE.items()])
    return harvest_clean(named if site is None else named.withColumn("site", F.lit(site)))


def read_harvest_positional(spark: SparkSession, path: str, site: str | None = None) -> DataFrame:
    """Legacy reader for a seven-column file without usable header names
    (S2, Q9): columns are named by position, then selected by name.  Without ``site``, an
    eighth column holds it."""
    raw = spark.read.option("header", True).csv(path)
    names = schemas.LEGACY_HARVEST_FILE + (["site"] if site is None else [])
    if len(raw.columns) != len(names):
        raise ValueError(f"expected {len(names)} columns, found {len(raw.columns)}")
    df = raw.toDF(*names).select(*(["site"] if site is None else []), *[F.col(c).try_cast("double").alias(c) for c in HARVEST_COLUMNS])
    return harvest_clean_legacy(df if site is None else df.withColumn("site", F.lit(site)))
