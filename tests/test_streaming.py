"""Streaming jobs equal their batch forms."""
from pyspark.sql import functions as F

import __spark_entry__ as E
from grovecast.operators import risk
from grovecast.streaming import jobs
from tests.conftest import SF_SMALL, rows
from tests.helpers import days, wx


def test_time_window_equals_row_window_without_gaps(spark, tmp_path):
    recs = [dict(site=s, obs_date=d, avg_temp=float(i % 17), rain=float(i % 3), clouds=float(i % 90))
            for s in ("A", "B") for i, d in enumerate(days("2021-01-01", 80))]
    daily = risk.with_humidity_proxy(wx(spark, recs))
    src = str(tmp_path / "src")
    daily.write.parquet(src)
    q = jobs.start_window_risk(spark, src, str(tmp_path / "out"), str(tmp_path / "ckpt"))
    q.awaitTermination()
    streamed = jobs.window_results(spark.read.parquet(str(tmp_path / "out")))
    rowwise = risk.window30_asof(daily)
    cols = ["site", "obs_date", "n_rows", "rainy_days", "month"]
    assert rows(streamed, *cols) == rows(rowwise, *cols)
    a = rows(streamed, "site", "obs_date", "avg_temp", "total_rain", "avg_humidity")
    b = rows(rowwise, "site", "obs_date", "avg_temp", "total_rain", "avg_humidity")
    assert all(x[:2] == y[:2] and all(abs(p - q_) < 1e-9 for p, q_ in zip(x[2:], y[2:])) for x, y in zip(a, b))


def test_static_window_stats_equal_stream(spark):
    streamed = E.queries()["stream_risk"](spark, SF_SMALL)
    from grovecast.sources import fixtures as fx
    daily = risk.with_humidity_proxy(fx.weather_daily(spark, SF_SMALL))
    static = jobs.window_stats(daily)
    newest = daily.groupBy("site").agg(F.max("obs_date").alias("_mx"))
    static = static.join(newest, "site").filter(F.col("obs_date") <= F.col("_mx")).drop("_mx")
    assert rows(risk.disease_overall(static)) == rows(streamed)


def test_ingest_stream_equals_batch_merge(spark):
    a = E.queries()["stream_ingest"](spark, SF_SMALL)
    b = E.queries()["merge_keep_first"](spark, SF_SMALL)
    assert rows(a) == rows(b)


def test_latest_stream_equals_batch(spark):
    from grovecast.sources import fixtures as fx
    a = E.queries()["stream_latest"](spark, SF_SMALL)
    b = jobs.newest_per_site(fx.event_readings(spark, SF_SMALL))
    assert rows(a) == rows(b.select(*a.columns))


def test_rows_later_than_the_watermark_are_dropped(spark, tmp_path):
    import datetime as dt
    import time
    first = [dict(site="A", obs_date=d, avg_temp=10.0, rain=1.0, clouds=50.0) for d in days("2021-01-01", 90)]
    on_time = [dict(site="A", obs_date=d, avg_temp=10.0, rain=1.0, clouds=50.0) for d in days("2021-04-01", 5)]
    late = [dict(site="A", obs_date="2021-01-15", avg_temp=10.0, rain=999.0, clouds=50.0)]
    src = str(tmp_path / "src")
    for i, part in enumerate((first, on_time, late)):   # one file per micro-batch, in this order
        if i:
            time.sleep(1.1)
        risk.with_humidity_proxy(wx(spark, part)).coalesce(1).write.mode("append").parquet(src)
    q = jobs.start_window_risk(spark, src, str(tmp_path / "out"), str(tmp_path / "ckpt"),
                               max_files_per_trigger=1)
    q.awaitTermination()
    res = {r.obs_date: r for r in jobs.window_results(spark.read.parquet(str(tmp_path / "out"))).collect()}
    assert res[dt.date(2021, 1, 20)].total_rain == 20.0        # the late 999 mm never entered
    assert max(res) == dt.date(2021, 4, 5) and len(res) == 95
    progress = q.recentProgress[-1]["stateOperators"][0]
    assert progress["numRowsDroppedByWatermark"] >= 1
