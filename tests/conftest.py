import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from grovecast.session import local_session
    s = local_session(cores="*", shuffle_partitions=8, app="grovecast-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def weather_small(spark):
    from grovecast.sources import fixtures as fx
    return fx.weather_daily(spark, SF_SMALL).cache()


def rows(df, *cols):
    """Sorted list of tuples (selected columns) for assertions."""
    sel = df.select(*cols) if cols else df
    return sorted(tuple(r) for r in sel.collect())
