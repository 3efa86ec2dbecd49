"""Disease scores against a brute-force evaluation of the rules."""
import datetime as dt

from grovecast.functions.rules import DISEASES
from grovecast.operators import risk
from tests.helpers import days, wx


def brute_force(temps, hums, rains, month):
    """Score every disease for one 30-row window, in plain Python."""
    t = sum(temps) / len(temps)
    h = sum(hums) / len(hums)
    total = sum(rains)
    rainy = sum(1 for r in rains if r > 0.5)
    out = {}
    for d in DISEASES:
        s = 0
        if d["temp_lo"] <= t <= d["temp_hi"]:
            s += d["band_pts"]
            if d["opt_lo"] <= t <= d["opt_hi"]:
                s += d["opt_pts"]
        if d["hum_min"] is not None and h >= d["hum_min"]:
            s += d["hum_pts"]
        if d["rainy_min"] is not None and rainy >= d["rainy_min"]:
            s += d["rainy_pts"]
        if d["rain_over"] is not None and total > d["rain_over"]:
            s += d["rain_pts"]
        if d["warm_over"] is not None and t > d["warm_over"]:
            s += d["warm_pts"]
        if month in d["months"]:
            s += d["month_pts"]
        out[d["disease"]] = s
    return out


def label(s):
    return "HIGH" if s >= 70 else "MODERATE" if s >= 40 else "LOW"


def _bounds_fixture():
    """30 equal days per site at every score bound (wx_bounds)."""
    temps = [5, 10, 15, 18, 20, 22, 23, 24, 25, 26, 27, 28, 35]
    humidity = [50, 60, 70, 85]
    rain_patterns = {  # (rain per rainy day, rainy days): totals 30, 40, 50, 0.5 days
        "r30x2": (15.0, 2), "r40x3": (40.0 / 3, 3), "r50x5": (10.0, 5), "r04x4": (0.5, 4), "r51x4": (12.75, 4)}
    recs, expected = [], {}
    for ti, t in enumerate(temps):
        for h in humidity:
            for key, (per, n_rainy) in rain_patterns.items():
                site = f"t{t}_h{h}_{key}"
                month_start = "2021-02-01" if ti % 2 else "2021-06-01"
                ds = days(month_start, 30)
                rains = [per if i < n_rainy else 0.0 for i in range(30)]
                for d, r in zip(ds, rains):
                    recs.append(dict(site=site, obs_date=d, avg_temp=t, rain=r, clouds=100 - h))
                expected[site] = brute_force([t] * 30, [h] * 30, rains, ds[-1].month)
    return recs, expected


def test_scores_match_brute_force(spark):
    recs, expected = _bounds_fixture()
    w = risk.with_humidity_proxy(wx(spark, recs))
    got = risk.disease_scores(risk.window30_latest(w)).collect()
    assert len(got) == 5 * len(expected)
    for r in got:
        raw = expected[r.site][r.disease]
        assert r.risk_level == min(100, raw), (r.site, r.disease)
        assert r.risk_label == label(raw), (r.site, r.disease)
        assert 0 <= r.risk_level <= 100


def test_overall_matches_brute_force(spark):
    recs, expected = _bounds_fixture()
    w = risk.with_humidity_proxy(wx(spark, recs))
    for r in risk.disease_overall(risk.window30_latest(w)).collect():
        labels = [label(s) for s in expected[r.site].values()]
        hi, mo = labels.count("HIGH"), labels.count("MODERATE")
        want = "HIGH" if hi >= 3 else "MODERATE" if hi >= 1 or mo >= 3 else "LOW"
        assert (r.n_high, r.n_moderate, r.n_low, r.overall_risk) == (hi, mo, labels.count("LOW"), want)


def test_peacock_spot_110_is_clipped(spark):
    ds = days("2021-03-01", 30)
    recs = [dict(site="p", obs_date=d, avg_temp=20.0, rain=5.0 if i < 3 else 0.0, clouds=20.0)
            for i, d in enumerate(ds)]
    w = risk.with_humidity_proxy(wx(spark, recs))
    r = [x for x in risk.disease_scores(risk.window30_latest(w)).collect() if x.disease == "peacock_spot"][0]
    assert r.risk_level == 100 and r.risk_label == "HIGH"
    assert r.recommendation_1 == "Apply copper fungicide before winter rains"


def test_null_statistics_score_nothing(spark):
    ds = days("2021-07-01", 30)
    recs = [dict(site="n", obs_date=d) for d in ds]  # every measure NULL
    w = risk.with_humidity(wx(spark, recs))
    st = risk.window30_latest(w).collect()[0]
    assert st.avg_temp is None and st.total_rain == 0.0 and st.rainy_days == 0
    scores = {x.disease: x.risk_level for x in risk.disease_scores(risk.window30_latest(w)).collect()}
    # humidity defaults to 50 (no humidity column): xylella gets its humidity points only
    assert scores == {"peacock_spot": 0, "verticillium_wilt": 0, "olive_knot": 0, "xylella": 20, "anthracnose": 0}


def test_headline_uses_all_rows(spark):
    ds = days("2021-01-01", 45)
    recs = [dict(site="h", obs_date=d, avg_temp=float(i), rain=1.0, clouds=0.0) for i, d in enumerate(ds)]
    rep = risk.disease_report(risk.with_humidity_proxy(wx(spark, recs))).collect()[0]
    assert rep.total_rain_30d == 45.0 and rep.rainy_days_30d == 45 and rep.avg_humidity_estimate == 50.0
    assert rep.obs_date == dt.date(2021, 2, 14)


def test_report_error_row_for_site_without_weather(spark):
    ds = days("2021-03-01", 5)
    daily = risk.with_humidity_proxy(wx(spark, [dict(site="A", obs_date=d, avg_temp=12.0, rain=0.0, clouds=30.0)
                                                for d in ds]))
    sites = spark.createDataFrame([("A",), ("B",)], "site string")
    rep = {r.site: r for r in risk.disease_report(daily, sites).collect()}
    assert rep["A"].error is None and rep["A"].overall_risk in ("LOW", "MODERATE", "HIGH")
    assert rep["B"].error == "No weather data available" and rep["B"].overall_risk is None
