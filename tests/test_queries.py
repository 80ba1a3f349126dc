"""Every query of the library against its plain SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from nighspark import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return c


def _plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "~"
    return f"{v:.6f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query(spark, con, name):
    df = Q.queries()[name](spark, SF)
    got = con.execute(Q.oracle_sql()[name])
    cols = [d[0] for d in got.description]
    assert sorted(cols) == sorted(df.columns)
    want = sorted(tuple(map(_plain, r)) for r in got.fetchall())
    assert sorted(tuple(map(_plain, r)) for r in df.select(*cols).collect()) == want


@pytest.mark.parametrize("name", ["pred_crosses_lines", "pred_contains_holes", "pred_intersects_multi", "pred_equals_redrawn", "pred_own"])
def test_predicates_that_hold(spark, name):
    assert Q.queries()[name](spark, SF).count() > 0
