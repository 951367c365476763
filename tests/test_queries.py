import pytest

from tessella.plans import catalog
from tests.oracle import same

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_duckdb(spark, name):
    same(spark, catalog.QUERIES[name], catalog.ORACLES[name], SF, name)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES.keys() - catalog.ORACLES.keys()))
def test_query_without_oracle_runs(spark, name):
    rows = catalog.QUERIES[name](spark, SF)
    assert rows.count() > 0 and len(set(rows.columns)) == len(rows.columns)
