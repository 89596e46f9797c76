import pytest

from signalrank.llm import catalog
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_matches_duckdb(spark, sf, name):
    compare(catalog.queries()[name](spark, sf), catalog.oracle_sql()[name], sf)


def test_one_query_for_each_operator():
    names = sorted(catalog.queries(), key=lambda n: int(n[2:].split("_")[0]))
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 14))
