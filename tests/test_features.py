"""Feature tables: null rules, NaN at the scan, monthly rain sums to yearly rain."""
import math

from pyspark.sql import functions as F

from grovecast.operators import features as feat
from grovecast.sources import weather as wsrc
from tests.helpers import days, wx


def _nulls_fixture(spark):
    recs = [dict(site="A", obs_date=d, avg_temp=5.0, rain=None, clouds=40.0) for d in days("2020-01-01", 31)]
    # February 2020: no rows at all
    recs += [dict(site="A", obs_date=d, avg_temp=10.0, rain=2.0, clouds=None) for d in days("2020-03-01", 10)]
    recs += [dict(site="A", obs_date=d, avg_temp=20.0, rain=1.5, clouds=50.0) for d in days("2020-07-01", 5)]
    return wx(spark, recs)


def test_sum_of_nothing_and_absent_groups(spark):
    f = feat.weather_features(_nulls_fixture(spark)).collect()[0]
    assert f.Rain_Jan == 0.0               # rows exist, rain all NULL -> 0
    assert f.Temp_Jan == 5.0
    assert f.Rain_Feb is None and f.Temp_Feb is None and f.Clouds_Feb is None   # no rows -> NULL
    assert f.Clouds_Mar is None            # all NULL -> mean is NULL
    assert f.Rain_Mar == 20.0
    assert f.Rain == 27.5 and f.Sun_Hours == 0.0
    assert f.Rain_winter == 0.0 and f.Rain_summer == 7.5 and f.Rain_autumn is None
    assert f.Temp_spring == 10.0
    assert abs(f.Clouds - (31 * 40 + 5 * 50) / 36) < 1e-9


def test_nan_is_null_at_scan(spark):
    raw = spark.createDataFrame(
        [("S", "2020-05-01", 2020, 5, 10.0, float("nan")), ("S", "2020-05-02", 2020, 5, 20.0, 3.0)],
        "site string, Date string, Year int, Month int, Avg_Temp double, Rain double")
    w = wsrc.from_csv_frame(raw)
    assert "Year" not in w.columns and "year" not in w.columns
    f = feat.weather_features(w).collect()[0]
    assert f.Rain == 3.0 and f.Rain_May == 3.0 and f.Avg_Temp == 15.0 and f.year == 2020


def test_one_row_per_site_year_and_monthly_sums(spark, weather_small):
    f = feat.weather_features(weather_small)
    assert f.count() == f.select("site", "year").distinct().count()
    months = sum(F.coalesce(F.col(f"Rain_{m}"), F.lit(0.0)) for m in feat.MONTH_NAMES)
    seasons = sum(F.coalesce(F.col(f"Rain_{s}"), F.lit(0.0)) for s in feat.SEASONS)
    for r in f.select("Rain", months.alias("m"), seasons.alias("s")).collect():
        assert math.isclose(r.Rain, r.m, abs_tol=1e-6) and math.isclose(r.Rain, r.s, abs_tol=1e-6)


def test_legacy_key_month_is_first_row_even_if_null(spark):
    recs = [dict(site="L", obs_date="2020-08-01", clouds=None, avg_temp=1.0, max_temp=2.0, min_temp=0.0),
            dict(site="L", obs_date="2020-08-02", clouds=70.0, avg_temp=1.0, max_temp=4.0, min_temp=0.0),
            dict(site="L", obs_date="2020-03-05", max_wind=30.0, avg_temp=1.0, max_temp=2.0, min_temp=1.0)]
    f = feat.legacy_features(wx(spark, recs)).collect()[0]
    assert f.Clouds_M8 is None and f.Max_Wind_M3 == 30.0 and f.Avg_Temp_M4 is None
    assert f.Temp_Spread_yearly == round(round(8 / 3, 9) - round(1 / 3, 9), 9)   # spread of the rounded means
