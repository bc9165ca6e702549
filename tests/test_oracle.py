"""Every registered query next to its SQL, on the smallest tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from checks.compare import connect, difference
from checks.oracles import ORACLES
from checks.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
WITHOUT_SQL = set()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_query_has_sql():
    assert set(QUERIES) - set(ORACLES) == WITHOUT_SQL
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) <= set(queries()) and set(ORACLES) <= set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, FOLDER).toPandas()
    assert difference(got, con.execute(ORACLES[name]).df()) is None


def test_entry_fills_what_can_be_filled(spark):
    rows = entry(spark).collect()
    assert len(rows) > 0 and any(r.is_imputed for r in rows)
    assert all(r.value is not None for r in rows)
