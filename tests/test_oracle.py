"""Every registered query against its DuckDB oracle (sf0.001 here; the gate runs sf0.01)."""

import pytest

from scriptorium.plans import registry
from scriptorium.plans.check import compare, duckdb_con

from .conftest import SF_SMALL

KEYS = sorted(registry.QUERIES)


@pytest.fixture(scope="module")
def con():
    return duckdb_con(SF_SMALL)


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, con, key):
    res = compare(spark, key, registry.QUERIES[key], registry.ORACLE.get(key), SF_SMALL, con)
    if key in registry.ORACLE:
        assert res["status"] == "match", res
    else:
        assert res["spark_rows"] >= 0


def test_entry_smoke(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
