"""Payload parsing and keep-first merge (ingest_dups, missing arrays, empty payloads)."""
import datetime as dt
import json

import pytest

from grovecast.operators import dedup
from grovecast.sources import payloads
from tests.helpers import wx


def _payload(spark, site, hourly):
    return spark.createDataFrame([(json.dumps({"site": site, "hourly": hourly}),)], "json string")


def test_missing_arrays_and_defaults(spark):
    h = {"time": ["2024-03-01T00:00", "2024-03-01T06:00", "2024-03-02T00:00"],
         "temperature_2m": [1.0, 2.0, 3.0], "sunshine_duration": [3600.0, None, 7200.0]}
    out = payloads.parse_hourly(_payload(spark, "S", h)).orderBy("pos").collect()
    assert [r.avg_temp for r in out] == [1.0, 2.0, 3.0]
    assert [r.rain for r in out] == [0.0, 0.0, 0.0]          # missing precipitation -> 0
    assert [r.clouds for r in out] == [None, None, None]      # missing cloud cover -> NULL
    assert [r.sun_hours for r in out] == [1.0, 0.0, 2.0]
    assert [r.pressure for r in out] == [1013.0] * 3
    assert out[1].obs_ts == dt.datetime(2024, 3, 1, 6, 0) and out[2].month == 3 and out[2].year == 2024


def test_empty_payloads_give_no_rows(spark):
    assert payloads.parse_hourly(_payload(spark, "S", {"time": []})).count() == 0
    none = spark.createDataFrame([(json.dumps({"site": "S"}),)], "json string")
    assert payloads.parse_hourly(none).count() == 0


def test_keep_first_in_batch_and_against_store(spark):
    store = wx(spark, [dict(site="S", obs_date="2024-03-01", avg_temp=99.0)])
    h = {"time": ["2024-03-01T00:00", "2024-03-02T06:00", "2024-03-02T00:00", "2024-03-03T00:00"],
         "temperature_2m": [1.0, 2.0, 3.0, 4.0]}
    batch = payloads.parse_hourly(_payload(spark, "S", h))
    merged = {r.obs_date: r.avg_temp for r in dedup.merge_keep_first(store, batch).collect()}
    assert merged == {dt.date(2024, 3, 1): 99.0, dt.date(2024, 3, 2): 3.0, dt.date(2024, 3, 3): 4.0}
    last = {r.obs_date: r.avg_temp for r in dedup.merge_keep_first(store, batch, keep="last").collect()}
    assert last[dt.date(2024, 3, 2)] == 2.0
    rep = dedup.ingest_report(batch, dedup.new_rows(store, batch)).collect()[0]
    assert (rep.rows_in, rep.rows_added, rep.last_update, rep.last_temp) == (4, 2, "2024-03-03", 4.0)


def test_append_is_idempotent(spark, tmp_path):
    h = {"time": ["2024-03-01T00:00", "2024-03-01T06:00", "2024-03-02T00:00"],
         "temperature_2m": [1.0, 2.0, 3.0]}
    batch = payloads.parse_hourly(_payload(spark, "S", h))
    path = str(tmp_path / "store")
    assert dedup.append_new_days(spark, path, batch) == 2      # first write creates the store
    assert dedup.append_new_days(spark, path, batch) == 0      # replay adds nothing
    assert spark.read.parquet(path).count() == 2


def test_daily_payload_humidity(spark):
    d = {"time": ["2024-05-01", "2024-05-02", "2024-05-03"], "cloud_cover_mean": [0.0, None, 100.0],
         "precipitation_sum": [None, 2.0, 0.0], "temperature_2m_mean": [10.0, 11.0, 12.0]}
    df = spark.createDataFrame([(json.dumps({"site": "S", "daily": d}),)], "json string")
    out = payloads.parse_daily(df).orderBy("obs_date").collect()
    assert [r.humidity for r in out] == [50.0, 50.0, 0.0]
    assert [r.rain for r in out] == [0.0, 2.0, 0.0] and [r.month for r in out] == [5, 5, 5]


def test_current_conditions_fallback(spark):
    from grovecast.plans.current import current_weather
    resp = spark.createDataFrame([
        (json.dumps({"site": "A", "cod": 200, "dt": 10, "main": {"temp": 21.25, "humidity": 40},
                     "wind": {"speed": 3.0}, "clouds": {"all": 20}, "rain": {"3h": 1.26}}),),
        (json.dumps({"site": "B", "cod": 401, "message": "Invalid API key", "dt": 11}),)], "json string")
    stored = wx(spark, [dict(site="B", obs_date="2024-01-05", avg_temp=7.25, clouds=33.35, rain=None),
                        dict(site="B", obs_date="2024-01-04", avg_temp=1.0)])
    out = {r.site: r for r in current_weather(payloads.parse_current(resp), stored).collect()}
    a, b = out["A"], out["B"]
    assert (a.source, a.temperature, a.humidity, a.clouds, a.rain, a.wind) == ("api", 21.2, 40, 20.0, 1.3, 3.0)
    assert (b.source, b.date, b.temperature, b.humidity, b.clouds, b.wind) == ("file", "2024-01-05", 7.2, 0, 33.4, 0.0)
    assert b.updated == "2024-01-05 (file)" and b.rain is None


def test_malformed_time_gives_nulls_not_failure(spark):
    h = {"time": ["2024-03-01T00:00", "not-a-time"], "temperature_2m": [1.0, 2.0]}
    out = payloads.parse_hourly(_payload(spark, "S", h)).orderBy("pos").collect()
    assert out[0].obs_date == dt.date(2024, 3, 1) and out[1].obs_date is None and out[1].obs_ts is None
    assert out[1].avg_temp == 2.0


def test_store_is_partitioned_by_year(spark, tmp_path):
    import os
    h = {"time": ["2023-12-31T00:00", "2024-01-01T00:00"], "temperature_2m": [1.0, 2.0]}
    path = str(tmp_path / "store")
    assert dedup.append_new_days(spark, path, payloads.parse_hourly(_payload(spark, "S", h))) == 2
    assert sorted(d for d in os.listdir(path) if d.startswith("year=")) == ["year=2023", "year=2024"]
    h2 = {"time": ["2024-01-01T06:00", "2024-01-02T00:00"], "temperature_2m": [9.0, 3.0]}
    assert dedup.append_new_days(spark, path, payloads.parse_hourly(_payload(spark, "S", h2))) == 1
    got = {r.obs_date: r.avg_temp for r in spark.read.parquet(path).collect()}
    assert got == {dt.date(2023, 12, 31): 1.0, dt.date(2024, 1, 1): 2.0, dt.date(2024, 1, 2): 3.0}


def test_store_without_year_partitions_is_refused(spark, tmp_path):
    h = {"time": ["2024-03-01T00:00", "2024-03-02T00:00"], "temperature_2m": [1.0, 3.0]}
    batch = payloads.parse_hourly(_payload(spark, "S", h))
    good, flat = str(tmp_path / "good"), str(tmp_path / "flat")
    assert dedup.append_new_days(spark, good, batch) == 2
    spark.read.parquet(good).drop("year").write.parquet(flat)
    with pytest.raises(ValueError, match="not partitioned"):
        dedup.append_new_days(spark, flat, batch)
    assert spark.read.parquet(flat).count() == 2
