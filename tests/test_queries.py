"""Registered queries against their SQL on the smallest tables.

tests/compare.py does the same at any scale.
"""

import os

import pytest

from compare import connect, mismatch
from tallyfield import plans

SF = "/root/testdata/sf0.001"
REGISTRY = plans.load()
NAMES = list(REGISTRY)
SURVEY = dict(S=10, P=22, M=18, C=29, I=9, E=13, G=12, X=23, U=18, D=13, V=14, T=14, N=20, Q=7, W=4)

needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@needs_data
@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    q = REGISTRY[name]
    got = q.run(spark, SF).toPandas()
    if q.sql is not None:
        assert mismatch(got, con.execute(q.sql).df()) is None


def test_every_operator_has_a_query():
    have = {q.survey_id for q in REGISTRY.values()}
    want = {f"{p}{i}" for p, n in SURVEY.items() for i in range(1, n + 1)}
    assert want == have


@needs_data
def test_entry(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark).collect()
    assert [r["days"] for r in sorted(rows, key=lambda r: r["days"])] == [30, 60, 90, 180, 365]
    assert set(entry.oracle_sql()) < set(entry.queries())
