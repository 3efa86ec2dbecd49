"""Trailing-row windows: blocked form = plain form; latest = last as-of row; gaps."""
import datetime as dt

from pyspark.sql import functions as F

from grovecast.operators import risk, windows
from tests.conftest import rows
from tests.helpers import days, wx


def _aggs():
    return risk.window_aggs()


def test_blocked_equals_unblocked(spark, weather_small):
    w = risk.with_humidity_proxy(weather_small)
    for n, block in ((30, 32), (7, 7), (30, 4096), (1, 5)):
        a = windows.trailing_asof(w, n, _aggs(), block_rows=block)
        b = windows.trailing_asof_unblocked(w, n, _aggs())
        cols = ["site", "obs_date", "n_rows", "avg_temp", "total_rain", "avg_humidity", "rainy_days"]
        assert rows(a, *cols) == rows(b, *cols), (n, block)


def test_positions_are_dense_per_site(spark, weather_small):
    p = windows.row_positions(weather_small)
    got = p.groupBy("site").agg(F.min("_pos").alias("lo"), F.max("_pos").alias("hi"),
                                F.count("*").alias("n"), F.countDistinct("_pos").alias("d")).collect()
    for r in got:
        assert r.lo == 0 and r.hi == r.n - 1 and r.d == r.n


def test_latest_equals_last_asof_row(spark, weather_small):
    w = risk.with_humidity_proxy(weather_small)
    asof = risk.window30_asof(w)
    last = asof.join(asof.groupBy("site").agg(F.max("obs_date").alias("obs_date")), ["site", "obs_date"])
    latest = risk.window30_latest(w)
    cols = ["site", "obs_date", "n_rows", "rainy_days", "month"]
    assert rows(last, *cols) == rows(latest, *cols)
    for a, b in zip(rows(last, "site", "avg_temp", "total_rain"), rows(latest, "site", "avg_temp", "total_rain")):
        assert a[0] == b[0] and abs(a[1] - b[1]) < 1e-9 and abs(a[2] - b[2]) < 1e-9


def test_short_history_and_gaps(spark):
    recs = [dict(site="short", obs_date=d, avg_temp=10.0 + i, rain=1.0) for i, d in enumerate(days("2020-01-01", 12))]
    # 40 days with every 4th day missing: a 30-row window spans more than 30 days
    recs += [dict(site="gappy", obs_date=d, avg_temp=20.0, rain=0.0)
             for i, d in enumerate(days("2020-01-01", 40)) if i % 4 != 3]
    w = risk.with_humidity(wx(spark, recs))
    out = {(r.site, r.obs_date): r for r in risk.window30_asof(w).collect()}
    assert [out[("short", d)].n_rows for d in days("2020-01-01", 12)] == list(range(1, 13))
    assert out[("short", dt.date(2020, 1, 12))].avg_temp == sum(10.0 + i for i in range(12)) / 12
    gappy = sorted(k[1] for k in out if k[0] == "gappy")
    assert len(gappy) == 30 and out[("gappy", gappy[-1])].n_rows == 30
    first_in_window = gappy[0]
    assert (gappy[-1] - first_in_window).days > 30


def test_hot_site_is_split_into_blocks(spark):
    recs = [dict(site="hot", obs_date=d, avg_temp=float(i % 23), rain=float(i % 4))
            for i, d in enumerate(days("2000-01-01", 5000))]
    recs += [dict(site=s, obs_date=d, avg_temp=1.0, rain=1.0) for s in ("a", "b") for d in days("2010-01-01", 100)]
    w = risk.with_humidity(wx(spark, recs))
    blocks = (windows.row_positions(w).where("site = 'hot'")
              .select(F.floor(F.col("_pos") / 256).alias("b")).distinct().count())
    assert blocks == 20                       # the hot site spreads over 20 tasks' worth of blocks
    a = windows.trailing_asof(w, 30, _aggs(), block_rows=256)
    b = windows.trailing_asof_unblocked(w, 30, _aggs())
    cols = ["site", "obs_date", "n_rows", "avg_temp", "total_rain", "rainy_days"]
    assert rows(a, *cols) == rows(b, *cols)
