"""CSV sources: harvest by header name, positional legacy layout, weather CSV."""
from grovecast.sources import harvest as hsrc
from grovecast.sources import weather as wsrc


def _write(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text)
    return str(p)


def test_harvest_csv_by_name(spark, tmp_path):
    path = _write(tmp_path, "h.csv", "year,trees,olives,oil,ratio\n"
                  "2001,150.0,900.0,180.0,5.0\n2002,150.0,,100.0,4.0\n2003,149.9,800.0,200.0,4.0\n")
    df = hsrc.read_harvest_csv(spark, path, site="X")
    got = sorted((r.site, r.year, r.trees, r.harvest_kg) for r in df.collect())
    assert got == [("X", 2001, 150, 900.0), ("X", 2003, 149, 800.0)]   # NULL row dropped, trees truncated
    assert dict(df.dtypes)["year"] == "int" and dict(df.dtypes)["trees"] == "int"


def test_harvest_positional_legacy(spark, tmp_path):
    path = _write(tmp_path, "l.csv", "a,b,c,d,e,f,g\n0,2001,150.0,900.0,180.0,5.0,3.2\n")
    r = hsrc.read_harvest_positional(spark, path, site="X").collect()[0]
    assert (r.year, r.trees, r.harvest_kg, r.ratio) == (2001, 150.0, 900.0, 5.0)


def test_weather_csv_drops_stored_year_month(spark, tmp_path):
    path = _write(tmp_path, "w.csv", "Date,Year,Month,Avg_Temp,Max_Temp,Min_Temp,Rain,Max_Wind,Avg_Wind,"
                  "Avg_Gust,Sun_Hours,Clouds,Snow,Pressure\n"
                  "2024-03-01,1999,12,10.5,12.0,8.0,NaN,20.0,10.0,30.0,5.5,40.0,0.0,1013\n")
    df = wsrc.read_weather_csv(spark, path, site="X")
    r = df.collect()[0]
    assert "Year" not in df.columns and "Month" not in df.columns
    assert r.rain is None and r.avg_temp == 10.5 and str(r.obs_date) == "2024-03-01"
    parts = wsrc.with_date_parts(df).collect()[0]
    assert (parts.year, parts.month) == (2024, 3)
