"""Every query of the catalogue against SQL on another engine."""

import pytest

from sagefold.plans import catalogue, oracle
from sagefold.streaming import queries as streams

from .compare import connect, difference

QUERIES = {**catalogue.queries(), **streams.queries()}
SQL = {**oracle.oracle_sql(), **streams.oracle_sql()}


@pytest.fixture(scope="module")
def db(small):
    return connect(small)


def test_every_query_has_sql():
    assert QUERIES.keys() == SQL.keys()


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, small, db, name):
    assert difference(QUERIES[name](spark, small), db, SQL[name]) == ""


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries()) and QUERIES.keys() <= e.queries().keys()


def test_reruns_agree(spark, small):
    for name in ("finalize_rules", "pack_chunks", "merge_apply"):
        one, two = ([sorted(map(str, QUERIES[name](spark, small).collect()))] for _ in range(2))
        assert one == two
