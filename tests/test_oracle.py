"""Every query of the catalog against its DuckDB SQL (row count, columns, values)."""
import pytest

from tests.conftest import SF_SMALL

import __spark_entry__ as E
from checks.compare import digest, duck, type_mismatches
from grovecast.plans import catalog

QUERIES = catalog.QUERIES
ORACLE = {k: v for k, v in E.oracle_sql().items() if k in QUERIES}
NAMES = sorted(ORACLE)


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_every_query_has_its_oracle():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(E.queries())


@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF_SMALL)
    s_cols, s_rows = df.columns, [tuple(r) for r in df.collect()]
    res = con.execute(ORACLE[name])
    d_cols, d_rows = [c[0] for c in res.description], res.fetchall()
    assert sorted(s_cols) == sorted(d_cols)
    assert not type_mismatches(df, con.sql(ORACLE[name]))
    assert len(s_rows) == len(d_rows)
    hs, ks = digest(s_cols, s_rows)
    hd, kd = digest(d_cols, d_rows)
    assert hs == hd, (sorted(set(ks) - set(kd))[:3], sorted(set(kd) - set(ks))[:3])


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "overall_risk" in df.columns
