"""Replaced days, growing roll-ups, refreshed as-of statistics, and payloads with rejects."""
import datetime as dt
import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from grovecast.operators import dedup, risk, store
from grovecast.sources import payloads, rejects
from tests.helpers import days, wx


def day_rows(spark, records):
    return wx(spark, records).withColumn("obs_ts", F.to_timestamp(F.col("obs_date").cast("string")).cast("timestamp_ntz")).withColumn("pos", F.lit(0))


def stored(spark, path):
    return {(r["site"], str(r["obs_date"])): r["avg_temp"] for r in spark.read.parquet(path).collect()}


def test_measured_day_replaces_forecast(spark, tmp_path):
    path = f"file://{tmp_path}/days"
    first = [dict(site=s, obs_date=d, avg_temp=1.0) for s in ("A", "B") for d in ("2019-12-31", "2020-01-01", "2020-01-02")]
    store.replace_days(spark, path, day_rows(spark, first), "p1")
    assert len(stored(spark, path)) == 6
    old = {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{tmp_path}/days/year=2019/*.parquet")}
    second = [dict(site="A", obs_date="2020-01-02", avg_temp=5.0), dict(site="A", obs_date="2020-01-03", avg_temp=6.0), dict(site="C", obs_date=None, avg_temp=0.0)]
    for change in ("p2", "p3"):  # the third run changes nothing
        store.replace_days(spark, path, day_rows(spark, [r for r in second if r["obs_date"]]), change)
        got = stored(spark, path)
        assert len(got) == 7 and got["A", "2020-01-02"] == 5.0 and got["B", "2020-01-02"] == 1.0 and got["A", "2019-12-31"] == 1.0
    # the year that the pull does not touch is not rewritten
    assert old == {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{tmp_path}/days/year=2019/*.parquet")}


def test_interrupted_swap_is_finished_from_the_staged_folder(spark, tmp_path):
    path = f"file://{tmp_path}/days"
    store.replace_days(spark, path, day_rows(spark, [dict(site="A", obs_date=f"2020-01-0{k}", avg_temp=1.0) for k in (1, 2, 3)]), "p1")
    batch = day_rows(spark, [dict(site="A", obs_date="2020-01-03", avg_temp=9.0)])
    real, calls = store.drop_folder, []

    class Lost(RuntimeError):
        pass

    def lose(*a):
        calls.append(a)
        raise Lost
    store.drop_folder = lose
    try:
        with pytest.raises(Lost):
            store.replace_days(spark, path, batch, "p2")
    finally:
        store.drop_folder = real
    # the partition is gone, as after a crash between deleting the old files and moving the new ones
    for f in glob.glob(f"{tmp_path}/days/year=2020/*"):
        os.rename(f, f"{tmp_path}/lost-{os.path.basename(f)}")
    store.replace_days(spark, path, batch, "p2")
    assert stored(spark, path) == {("A", "2020-01-01"): 1.0, ("A", "2020-01-02"): 1.0, ("A", "2020-01-03"): 9.0}
    assert calls and not os.path.exists(f"{tmp_path}/days-staged/p2")


def test_append_counts_and_leaves_no_batch_behind(spark, tmp_path):
    path = f"file://{tmp_path}/days"
    batch = day_rows(spark, [dict(site="A", obs_date=d, avg_temp=1.0) for d in days("2020-01-01", 5)])
    assert [dedup.append_new_days(spark, path, batch) for _ in range(2)] == [5, 0]
    assert dedup.append_new_days(spark, path, batch.limit(0)) == 0
    base = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    assert not glob.glob(f"{base}/grovecast-batch-*")


def hourly(spark, rng, n=60):
    rows = [dict(site=rng.choice("AB"), obs_date=f"2020-01-{rng.randrange(1, 6):02d}",
                 **{m: rng.choice([None, round(rng.uniform(-5, 30), 2)]) for m in ("avg_temp", "max_temp", "min_temp", "rain", "clouds", "sun_hours", "max_wind",
                                                                                  "avg_wind", "avg_gust", "snow", "pressure")}) for _ in range(n)]
    return rows


def test_rollup_in_pulls_equals_the_rollup_of_all_hours(spark, tmp_path):
    rows = hourly(spark, random.Random(2))
    pulls = [wx(spark, rows[k::4]) for k in range(4)]
    s = store.RollupStore(spark, f"file://{tmp_path}/r")
    assert s.read().count() == 0
    as_set = lambda df: sorted(tuple(r[c] for c in sorted(df.columns)) for r in df.collect())
    s.add("a", pulls[0])
    s.add("b", pulls[1])
    s.add("b", pulls[1])  # sent again
    s.compact()
    assert s.generation() == 1 and s.pulls() == {"a", "b"}
    s.add("a", pulls[0])  # sent again after it was merged
    s.add("c", pulls[2])
    s.compact()
    s.compact()
    s.add("d", pulls[3])
    assert s.generation() == 3 and s.pulls() == {"a", "b", "c"}
    want = dedup.daily_rollup(wx(spark, rows))
    assert sorted(want.columns) == sorted(s.read().columns)
    assert str(as_set(s.read())) == str(as_set(want))


def test_incomplete_compaction_does_not_count(spark, tmp_path):
    rows = hourly(spark, random.Random(3))
    s = store.RollupStore(spark, f"file://{tmp_path}/r")
    s.add("a", wx(spark, rows))
    before = sorted(map(str, s.read().collect()))
    store.merged(s.parts()).limit(1).write.parquet(f"file://{tmp_path}/r/gen=1/pulls/pull=merged")  # no list of pulls yet
    assert s.generation() == 0 and sorted(map(str, s.read().collect())) == before
    s.compact()
    assert s.generation() == 1 and sorted(map(str, s.read().collect())) == before


def stats(weather):
    return risk.window30_asof(risk.with_humidity_proxy(weather))


def test_refresh_equals_full_run_and_touches_only_its_years(spark, tmp_path):
    rng = random.Random(6)
    all_days = [dict(site=s, obs_date=d, avg_temp=round(rng.uniform(0, 30), 1), rain=round(rng.uniform(0, 9), 1), clouds=rng.choice([None, 0.0, 40.0]))
                for s, step in (("A", 1), ("B", 40)) for d in days("2015-01-01", 1800 // step, step)]
    weather = wx(spark, all_days).withColumn("year", F.year("obs_date").cast("int"))
    late = (F.col("site") == "A") & F.col("obs_date").between(dt.date(2017, 6, 1), dt.date(2017, 6, 5)) | (F.col("site") == "B") & (F.year("obs_date") == 2017) & (F.month("obs_date") == 3)
    base = f"file://{tmp_path}"
    early, new = weather.where(~late), weather.where(late)
    assert new.groupBy("site").count().count() == 2
    early.write.partitionBy("year").parquet(f"{base}/w")
    stats(early.drop("year")).withColumn("year", F.year("obs_date").cast("int")).write.partitionBy("year").parquet(f"{base}/s")
    new.write.mode("append").partitionBy("year").parquet(f"{base}/w")
    old = {y: sorted(os.stat(f).st_mtime_ns for f in glob.glob(f"{tmp_path}/s/year={y}/*.parquet")) for y in (2015, 2016)}
    store.refresh_asof(spark, f"{base}/w", f"{base}/s", new, 30, stats, "c1")
    key = lambda df: sorted(str(r) for r in df.drop("year").select("site", "obs_date", "n_rows", "avg_temp", "total_rain", "avg_humidity", "rainy_days").collect())
    assert key(spark.read.parquet(f"{base}/s")) == key(stats(weather.drop("year")))
    assert old == {y: sorted(os.stat(f).st_mtime_ns for f in glob.glob(f"{tmp_path}/s/year={y}/*.parquet")) for y in (2015, 2016)}
    store.refresh_asof(spark, f"{base}/w", f"{base}/s", new.limit(0), 30, stats, "c2")  # nothing changed


def test_context_goes_back_as_far_as_rows_are_needed(spark):
    counts = {("A", 2019): 200, ("A", 2018): 200, ("B", 2019): 9, ("B", 2016): 9, ("B", 2015): 30, ("C", 2010): 300}
    rows = [dict(site=s, obs_date=dt.date(y, 1, 1) + dt.timedelta(days=k)) for (s, y), n in counts.items() for k in range(n)]
    w = wx(spark, rows).withColumn("year", F.year("obs_date").cast("int"))
    sites = lambda *x: spark.createDataFrame([(s,) for s in x], "site string")
    assert store.context_from(w, sites("A"), 2020, 30) == 2019
    assert store.context_from(w, sites("A", "B"), 2020, 30) == 2015
    assert store.context_from(w, sites("D"), 2020, 30) == 2020
    assert store.context_from(w, sites("B"), 2016, 100) == 2015  # all it has


# -- rejects ----------------------------------------------------------------------------------
def test_rejects_say_why(spark):
    texts = ['{"site":"A","hourly":{"time":["2020-01-01T00:00","nonsense","2020-01-01T02:00","2020-01-01T03:00"],"temperature_2m":[1.5,2,"x","4.25"],"cloud_cover":[null,1,2,"NaN"]}}',
             '{"site":"A","hourly":{"time":[]}}', '{"site":"B"}', '{"hourly":{"time":["2020-01-01T00:00"]}}', '{"site":"A","hourly"', "", None,
             '{"site":"C","hourly":{"time":["2020-01-01T00:00"],"precipitation":[{"mm":1}],"extra":[1]}}']
    df = spark.createDataFrame([(t,) for t in texts], "json string")
    checked = rejects.checked_hourly(df)
    got = {(r["site"], r["reason"]): r["n_rows"] for r in rejects.account(checked).collect()}
    assert got == {("A", "accepted"): 2, ("A", "bad time"): 1, ("A", "bad value: temperature_2m"): 1, ("A", "no times"): 1, ("B", "no times"): 1,
                   (None, "no site"): 1, (None, "not JSON"): 3, ("C", "bad value: precipitation"): 1}
    ok = sorted((r["pos"], r["avg_temp"], r["clouds"], r["rain"], str(r["obs_date"])) for r in checked.where("reason is null").collect())
    assert ok == [(0, 1.5, None, 0.0, "2020-01-01"), (3, 4.25, None, 0.0, "2020-01-01")]
    assert rejects.account(rejects.checked_hourly(df.limit(0))).count() == 0


def test_usable_hours_equal_the_fixed_schema(spark, weather_small):
    pulls = payloads.hourly_payloads_from_weather(weather_small.where("obs_date < '1996-06-01'"))
    cols = ["site", "pos", "obs_date", "obs_ts", "avg_temp", "max_temp", "min_temp", "rain", "max_wind", "avg_wind", "avg_gust", "sun_hours", "clouds", "snow", "pressure"]
    checked = rejects.checked_hourly(pulls)
    assert checked.where("reason is not null").count() == 0
    a, b = (sorted(map(str, d.select(*cols).collect())) for d in (checked, payloads.parse_hourly(pulls)))
    assert a == b
