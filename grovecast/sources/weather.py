"""Weather sources (S3, P4, P5): the service's daily CSV into ``weather_daily``.

The CSV has capitalised names and a stored ``Year``/``Month`` pair next to
``Date``.  Spark resolves names case-insensitively, so the stored pair is
dropped at the scan and year / month are always derived from the date.
NaN is turned into NULL here, once: pandas skips NaN in sums and means,
Spark only skips NULL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grovecast import schemas
from grovecast.functions.expressions import nan_to_null


def clean_measures(df: DataFrame) -> DataFrame:
    """NaN -> NULL in every weather measure present."""
    return df.select(*[nan_to_null(c).alias(c) if c in schemas.WEATHER_MEASURES else F.col(c)
                       for c in df.columns])


def from_csv_frame(raw: DataFrame, site: str | None = None) -> DataFrame:
    """Rename a service-layout frame into ``weather_daily`` columns."""
    cols = [F.to_date(F.substring("Date", 1, 10), "yyyy-MM-dd").alias("obs_date")]
    # every measure of the schema; one the file lacks is a NULL column
    cols += [(F.col(src).cast("double") if src in raw.columns else F.lit(None).cast("double")).alias(dst)
             for src, dst in schemas.WEATHER_CSV_TO_DAILY.items()]
    site_col = F.col("site") if "site" in raw.columns else F.lit(site)
    return clean_measures(raw.select(site_col.alias("site"), *cols))


def read_weather_csv(spark: SparkSession, path: str, site: str | None = None) -> DataFrame:
    """Read the daily weather CSV(s) with an explicit schema (S3)."""
    schema = schemas.WEATHER_CSV
    if site is None:
        from pyspark.sql import types as T
        schema = T.StructType([T.StructField("site", T.StringType())] + list(schema.fields))
    raw = spark.read.option("header", True).option("enforceSchema", False).schema(schema).csv(path)
    return from_csv_frame(raw, site)


def with_date_parts(weather: DataFrame) -> DataFrame:
    """year and month of the observation date."""
    return weather.withColumn("year", F.year("obs_date")).withColumn("month", F.month("obs_date"))
