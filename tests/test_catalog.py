import pytest

import __spark_entry__ as entry
from signalrank.plans import catalog
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_matches_duckdb(spark, sf, name):
    compare(catalog.queries()[name](spark, sf), catalog.oracle_sql()[name], sf)


def test_every_sql_has_its_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
    assert set(catalog.queries()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_logistic_rank(spark, sf):
    rows = catalog.queries()["logistic_rank"](spark, sf).collect()
    assert rows and all(0 <= r["score"] <= 1 for r in rows)
