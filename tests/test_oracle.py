"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.compare import connect, difference
from tests.conftest import SMALL

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def db():
    return connect(SMALL)


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    got = QUERIES[name](spark, SMALL).toArrow()
    if name in ORACLES:
        assert difference(got, db.execute(ORACLES[name]).to_arrow_table()) is None
    assert len(got) > 0


def test_entry(spark):
    first = entry.entry(spark).first()
    assert first["value"] >= 1 and first["source"] != first["target"]
