"""Probes of earlier findings: store writer, NaN, rows without a day, folds."""
import datetime as dt

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from grovecast import schemas
from grovecast.functions.rules import DISEASES
from grovecast.operators import dedup, foliar, risk, windows
from grovecast.plans import current, fit
from grovecast.sources import payloads
from tests.helpers import wx


def _batch(spark, days):
    pl = spark.createDataFrame([("s", f'{{"site":"s","hourly":{{"time":["{d}T00:00","{d}T06:00"],"temperature_2m":[10.0,NaN]}}}}') for d in days],
                               "site string, json string")
    return payloads.parse_hourly(pl)


def test_failed_read_of_the_store_raises(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    batch = _batch(spark, ["2024-01-01", "2025-02-01"])
    assert dedup.append_new_days(spark, path, batch) == 2
    assert dedup.append_new_days(spark, path, batch) == 0
    reader = type(spark.read)
    whole = reader.parquet

    def broken(self, *paths, **how):
        raise AnalysisException("no permission", errorClass="UNABLE_TO_INFER_SCHEMA", messageParameters={"format": "Parquet"})

    monkeypatch.setattr(reader, "parquet", broken)
    with pytest.raises(AnalysisException):
        dedup.append_new_days(spark, path, batch)
    monkeypatch.setattr(reader, "parquet", whole)
    assert spark.read.parquet(path).count() == 2


def test_nan_in_a_payload_is_no_value(spark):
    assert dedup.daily_rollup(_batch(spark, ["2024-01-01"])).first()["avg_temp"] == 10.0


def test_asof_keeps_rows_without_a_day(spark):
    rows = [("s", dt.date(2024, 1, d), float(d)) for d in range(1, 6)] + [("s", None, 9.0)]
    df = spark.createDataFrame(rows, "site string, obs_date date, rain double")
    agg = {"total": ("sum0", "rain")}
    blocked = windows.trailing_asof(df, 3, agg, block_rows=3)
    plain = windows.trailing_asof_unblocked(df, 3, agg)
    as_rows = lambda x: sorted((str(r["obs_date"]), r["n_rows"], r["total"]) for r in x.collect())
    assert as_rows(blocked) == as_rows(plain) and blocked.count() == 6


def test_older_good_response_wins(spark):
    resp = spark.createDataFrame([("s", 10, True, 21.0, 40, 5.0, 0.0, 1.0, None), ("s", 11, False, None, None, None, None, None, "Invalid API key"),
                                  ("t", 12, False, None, None, None, None, None, "Invalid API key")],
                                 "site string, dt long, ok boolean, temperature double, humidity int, clouds double, rain double, wind double, message string")
    got = {r["site"]: r for r in current.current_weather(resp, spark.createDataFrame([], schemas.WEATHER_DAILY)).collect()}
    assert got["s"]["source"] == "api" and got["s"]["temperature"] == 21.0
    assert got["t"]["error"] == "Invalid API key"


def test_cv_error_does_not_depend_on_the_partitioning(spark):
    rows = [(f"s{i % 4}", 2000 + i, float((i * 7) % 11), float((i * 5) % 13)) for i in range(40)]
    df = spark.createDataFrame(rows, "site string, year int, x double, label double")
    got = [fit.fit_linear(df.repartition(n), ["x"], "m")[1].select(F.round("cv_mae", 9)).first()[0] for n in (1, 3, 7)]
    assert got[0] == got[1] == got[2]


def test_overlapping_pulls_count_a_day_once(spark):
    recs = [dict(site="S", obs_date=d, avg_temp=18.0, rain=r, clouds=20.0)
            for d, r in ((dt.date(2024, 4, 1), 3.0), (dt.date(2024, 4, 2), 1.0))]
    once = risk.with_humidity_proxy(wx(spark, recs))
    thrice = once.unionByName(once).unionByName(once)
    a, b = risk.disease_report(once).collect()[0], risk.disease_report(thrice).collect()[0]
    assert a == b and b.total_rain_30d == 4.0 and b.rainy_days_30d == 2
    assert [d.disease for d in b.diseases] == [d["disease"] for d in DISEASES]
    assert b.diseases[0].risk_label in ("LOW", "MODERATE", "HIGH") and len(b.diseases[0].recommendations) == 3
    f = foliar.foliar_report(thrice).collect()[0]
    assert f == foliar.foliar_report(once).collect()[0] and f.recent_rain == 4.0
    boron = f.recommendations[0]
    assert boron.type == "boron_preflowering" and boron.current_month == 4 and boron.in_season
    assert boron.conditions.temperature.required == "12-22°C" and boron.conditions.temperature.ok
    assert boron.conditions.no_rain_expected.required == "No rain" and boron.conditions.no_rain_expected.ok
