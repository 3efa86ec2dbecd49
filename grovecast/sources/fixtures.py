"""Fixture views: the library's logical tables derived from the driver tables.

``weather_daily`` and ``harvest`` are re-expressions of the TPC-H-like
tables (lineitem / orders and their dimensions) in the weather and harvest
schemas.  They are plain DataFrame plans, so their cost grows with the input
and Catalyst prunes every unused column at the parquet scan.

Plan shape at scale: lineitem (5 columns read) joins the supplier -> site
lookup (supplier joined with the two fixed-size TPC dimension tables nation
and region, 25 and 5 rows, which are broadcast), then a partial
(map-side) aggregate by (site, day) before the only large shuffle.  The
result is one row per (site, day), so everything downstream is small per
key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grovecast import schemas

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Compute ``df`` once and cut its lineage: write it as a parquet table
    into the session's checkpoint folder (a shared folder on a cluster) and
    read it back.  Used when one query reads a derived table along several
    branches: the derivation runs once per query, a lost executor does not
    recompute it, and later scans keep column pruning and filter pushdown."""
    import uuid
    from grovecast.session import ensure_checkpoint_dir
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/grovecast-{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    remove_at_exit(spark, path)
    return spark.read.parquet(path)


def remove_at_exit(spark: SparkSession, path: str) -> None:
    """Have the written table removed when the application ends: lazy results
    may read it until then."""
    try:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    except Exception:  # noqa: BLE001  (Spark Connect: no driver-side context)
        return
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(conf).deleteOnExit(p)


def materialize_many(*dfs: DataFrame, names: tuple[str, ...] = ()) -> list[DataFrame]:
    """:func:`materialize` several tables with concurrent jobs (Spark runs
    jobs submitted from separate threads side by side)."""
    from concurrent.futures import ThreadPoolExecutor
    names = names or tuple(f"table{i}" for i in range(len(dfs)))
    with ThreadPoolExecutor(max_workers=len(dfs)) as pool:
        return list(pool.map(lambda pair: materialize(*pair), zip(dfs, names)))


def _floor_half_up(x, scale: float) -> F.Column:
    """``floor(x * scale + 0.5) / scale``: one rounding rule on both engines."""
    return F.floor(x * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def _site_of_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    # nation (25 rows) and region (5 rows) are fixed-size TPC dimensions.
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    region = table(spark, sf_dir, "region").select("r_regionkey", F.col("r_name").alias("site"))
    return nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey) \
                 .select("n_nationkey", "site")


def weather_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily weather per site (schema ``schemas.WEATHER_DAILY``).

    Rain is NULL on every 17th and clouds NULL on every 13th of a month on
    purpose, and clouds can be 0, so the NULL rules of the operators are
    exercised by the real data.
    """
    li = table(spark, sf_dir, "lineitem").select(
        "l_suppkey", "l_quantity", "l_tax", "l_discount", "l_shipdate")
    supp = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    site_of_supp = supp.join(F.broadcast(_site_of_nation(spark, sf_dir)),
                             supp.s_nationkey == F.col("n_nationkey")) \
                       .select("s_suppkey", "site")
    tax100 = F.round(F.col("l_tax") * 100).cast("bigint")
    disc100 = F.round(F.col("l_discount") * 100).cast("bigint")
    base = (li.join(site_of_supp, li.l_suppkey == site_of_supp.s_suppkey)
              .groupBy("site", F.to_date("l_shipdate").alias("obs_date"))
              .agg(F.count(F.lit(1)).cast("double").alias("n"),
                   F.sum(F.col("l_quantity").cast("bigint")).cast("double").alias("q"),
                   F.max("l_quantity").cast("double").alias("qx"),
                   F.min("l_quantity").cast("double").alias("qn"),
                   F.sum(tax100).cast("double").alias("tx"),
                   F.sum(disc100).cast("double").alias("ds"),
                   F.max(disc100).cast("double").alias("dx")))
    m = F.month("obs_date")
    dd = F.dayofmonth("obs_date")
    k = F.abs(m - 7).cast("double")
    n, q, qx, qn, tx, ds, dx = (F.col(c) for c in ("n", "q", "qx", "qn", "tx", "ds", "dx"))
    temp = lambda v: _floor_half_up(27.0 - 3.5 * k + (v - 25.5) * 0.4, 100.0)
    return base.select(
        "site", "obs_date",
        temp(q / n).alias("avg_temp"),
        temp(qx).alias("max_temp"),
        temp(qn).alias("min_temp"),
        F.when(dd == 17, F.lit(None).cast("double"))
         .otherwise(_floor_half_up(F.greatest(F.lit(0.0), (tx / n - 4.0) * 4.0 * (1.0 + k / 6.0)), 100.0))
         .alias("rain"),
        F.when(dd == 13, F.lit(None).cast("double"))
         .otherwise(_floor_half_up(F.least(F.lit(100.0), ds / n * 3.0 + 10.0 * k), 100.0))
         .alias("clouds"),
        _floor_half_up(14.0 - ds / n * 0.3 - k, 100.0).alias("sun_hours"),
        (dx * 3.0).alias("max_wind"),
        _floor_half_up(ds / n * 3.0, 100.0).alias("avg_wind"),
        (dx * 4.0).alias("avg_gust"),
        F.when(m.isin(12, 1, 2), F.floor(tx / n * 20.0 + 0.5) / 100.0).otherwise(F.lit(0.0)).alias("snow"),
        F.lit(1013.0).alias("pressure"),
    )


def harvest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly harvest per site (schema ``schemas.HARVEST_RAW``: trees as double)."""
    orders = table(spark, sf_dir, "orders").select(
        "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority")
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    site_of_cust = cust.join(F.broadcast(_site_of_nation(spark, sf_dir)),
                             cust.c_nationkey == F.col("n_nationkey")) \
                       .select("c_custkey", "site")
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    o = orders.join(site_of_cust, orders.o_custkey == site_of_cust.c_custkey).select(
        "site", F.year("o_orderdate").cast("int").alias("year"), "o_custkey",
        cents.alias("cents"),
        F.when(F.col("o_orderpriority") == "1-URGENT", cents).otherwise(F.lit(0).cast("bigint"))
         .alias("oil_cents"))
    agg = o.groupBy("site", "year").agg(
        F.countDistinct("o_custkey").cast("double").alias("trees"),
        F.sum("cents").cast("double").alias("c"),
        F.sum("oil_cents").cast("double").alias("oc"))
    return agg.select(
        "site", "year", "trees",
        (F.floor(F.col("c") / 1e6 + 0.5) / 10.0).alias("harvest_kg"),
        (F.floor(F.col("oc") / 1e6 + 0.5) / 10.0).alias("oil"),
        (F.floor(F.try_divide("c", "oc") * 1e6 + 0.5) / 1e6).alias("ratio"))


def event_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``events`` table seen as sensor readings of the five sites: site =
    region of ``user_id % 5`` (region: 5 rows, broadcast), reading = value,
    k from the JSON ``props``; times are wall-clock (``timestamp_ntz``)."""
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "value", "props")
    reg = F.broadcast(table(spark, sf_dir, "region").select("r_regionkey", F.col("r_name").alias("site")))
    return ev.join(reg, (ev.user_id % 5) == reg.r_regionkey).select(
        "site", "event_id", F.col("ts").cast("timestamp_ntz").alias("obs_ts"),
        F.col("value").alias("reading"),
        F.get_json_object("props", "$.k").cast("int").alias("k"))


# ---------------------------------------------------------------------------
# Literal model tables.  The service's trained coefficients are not
# published, so these numbers are ours (fixed values used by tests and the
# oracle); scoring results are comparable through the formula only.
# ---------------------------------------------------------------------------
MODEL_FEATURE_ROWS = [
    ("simple", "lin", "Rain_Jan", 60.0, 30.0, 250.0),
    ("simple", "lin", "Clouds_Sep", 35.0, 10.0, -180.0),
    ("simple", "lin", "Clouds_Oct", 45.0, 10.0, 120.0),
    ("complex", "a", "Rain_winter", 180.0, 60.0, 200.0),
    ("complex", "a", "Temp_spring", 16.0, 4.0, -150.0),
    ("complex", "b", "Clouds", 45.0, 10.0, -300.0),
    ("complex", "b", "Sun_Hours", 2700.0, 600.0, 400.0),
    ("complex", "b", "Missing_Feature", 0.0, 1.0, 10.0),
    ("legacy", "a", "Rain_winter", 180.0, 60.0, 200.0),
    ("legacy", "b", "Max_Wind_M3", 25.0, 5.0, 90.0),
    ("legacy", "b", "Temp_Spread_yearly", 12.0, 6.0, -110.0),
]

MODEL_META_ROWS = [
    ("simple", "lin", "Statistical Model (Simple)", "Best statistical model (R²=0.69, p=0.00003)",
     950.0, 0.15, 300.0, 0.69),
    ("complex", "a", "ML Ensemble (Complex)", "Ensemble of trained regressors", 900.0, 0.23, None, None),
    ("complex", "b", "ML Ensemble (Complex)", "Ensemble of trained regressors", -350.0, 0.23, None, None),
    ("legacy", "a", "Legacy Ensemble", "Ensemble on legacy features", 900.0, None, None, None),
    ("legacy", "b", "Legacy Ensemble", "Ensemble on legacy features", 1200.0, None, None, None),
]

FEATURE_IMPORTANCE_ROWS = [
    ("legacy", 1, "Rain_winter", 0.41),
    ("legacy", 2, "Temp_Spread_yearly", 0.33),
    ("legacy", 3, "Max_Wind_M3", 0.26),
    ("complex", 1, "Sun_Hours", 0.38),
    ("complex", 2, "Clouds", 0.27),
    ("complex", 3, "Rain_winter", 0.2),
    ("complex", 4, "Temp_spring", 0.15),
]


# A tree ensemble of a forest and a boosted member (our own numbers): model, member, tree, node, feature,
# threshold, left node, right node, value of a leaf, weight of the tree.
TREE_NODE_ROWS = [
    ("grown", "forest", 0, 0, "Rain_Jan", 120.0, 1, 4, None, 1.0),
    ("grown", "forest", 0, 1, "Temp_spring", 16.4, 2, 3, None, 1.0),
    ("grown", "forest", 0, 2, None, None, None, None, 700.0, 1.0),
    ("grown", "forest", 0, 3, None, None, None, None, 850.5, 1.0),
    ("grown", "forest", 0, 4, "Clouds_Sep", 35.0, 5, 6, None, 1.0),
    ("grown", "forest", 0, 5, None, None, None, None, 1200.25, 1.0),
    ("grown", "forest", 0, 6, None, None, None, None, 990.0, 1.0),
    ("grown", "forest", 1, 0, "Sun_Hours", 3400.0, 1, 2, None, 1.0),
    ("grown", "forest", 1, 1, None, None, None, None, 640.75, 1.0),
    ("grown", "forest", 1, 2, "Rain_winter", 300.0, 3, 4, None, 1.0),
    ("grown", "forest", 1, 3, None, None, None, None, 1010.0, 1.0),
    ("grown", "forest", 1, 4, "Rain_Jan", 150.0, 5, 6, None, 1.0),
    ("grown", "forest", 1, 5, None, None, None, None, 1105.5, 1.0),
    ("grown", "forest", 1, 6, None, None, None, None, 1320.0, 1.0),
    ("grown", "forest", 2, 0, None, None, None, None, 900.0, 1.0),
    ("grown", "boosted", 0, 0, "Rain_winter", 310.0, 1, 2, None, 1.0),
    ("grown", "boosted", 0, 1, None, None, None, None, 800.0, 1.0),
    ("grown", "boosted", 0, 2, None, None, None, None, 1050.0, 1.0),
    ("grown", "boosted", 1, 0, "Temp_spring", 16.2, 1, 2, None, 0.1),
    ("grown", "boosted", 1, 1, None, None, None, None, -150.5, 0.1),
    ("grown", "boosted", 1, 2, "Clouds_Sep", 34.9, 3, 4, None, 0.1),
    ("grown", "boosted", 1, 3, None, None, None, None, 90.0, 0.1),
    ("grown", "boosted", 1, 4, None, None, None, None, -40.0, 0.1),
]
TREE_COMBINE_ROWS = [("grown", "forest", "mean", 0.0), ("grown", "boosted", "sum", 25.0)]


def tree_node(spark: SparkSession) -> DataFrame:
    from grovecast.operators.trees import NODE
    return spark.createDataFrame(TREE_NODE_ROWS, NODE)


def tree_combine(spark: SparkSession) -> DataFrame:
    from grovecast.operators.trees import COMBINE
    return spark.createDataFrame(TREE_COMBINE_ROWS, COMBINE)


def model_feature(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MODEL_FEATURE_ROWS, schemas.MODEL_FEATURE)


def model_meta(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MODEL_META_ROWS, schemas.MODEL_META)


def feature_importance(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FEATURE_IMPORTANCE_ROWS, schemas.FEATURE_IMPORTANCE)


# ---------------------------------------------------------------------------
# Ingest scenario: a store that is 69 days behind, and a pull that re-sends
# the last 99 days (30 of them already stored) as hourly payloads.
# ---------------------------------------------------------------------------
STORE_LAG_DAYS = 69
RESEND_DAYS = 99


def ingest_scenario_payloads(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(store rows, hourly JSON payloads of the re-sent days)."""
    from grovecast.sources import payloads
    w = materialize(weather_daily(spark, sf_dir), "weather")
    newest = w.groupBy("site").agg(F.max("obs_date").alias("_mx"))
    wm = w.join(newest, "site")
    store = wm.filter(F.col("obs_date") <= F.date_sub("_mx", STORE_LAG_DAYS)).drop("_mx")
    recent = wm.filter(F.col("obs_date") > F.date_sub("_mx", RESEND_DAYS)).drop("_mx")
    return store, payloads.hourly_payloads_from_weather(recent)


def ingest_scenario(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(store rows, parsed hourly batch rows) derived from ``weather_daily``."""
    from grovecast.sources import payloads
    store, pl = ingest_scenario_payloads(spark, sf_dir)
    return store, payloads.parse_hourly(pl)
