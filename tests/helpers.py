"""Hand-built weather tables for unit tests."""
import datetime as dt

from grovecast import schemas

MEASURES = schemas.WEATHER_MEASURES


def wx(spark, records):
    """records: dicts with site, obs_date (date or 'yyyy-mm-dd') and any measures."""
    out = []
    for r in records:
        d = r["obs_date"]
        if isinstance(d, str):
            d = dt.date.fromisoformat(d)
        out.append((r["site"], d, *[None if r.get(m) is None else float(r[m]) for m in MEASURES]))
    return spark.createDataFrame(out, schemas.WEATHER_DAILY)


def days(start, n, step=1):
    d0 = dt.date.fromisoformat(start)
    return [d0 + dt.timedelta(days=i * step) for i in range(n)]
