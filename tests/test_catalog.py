"""Every registered query with an oracle matches DuckDB; every query runs."""

import pytest

import __spark_entry__ as E
from oracle_harness import compare

from conftest import SF_SMALL

QUERIES = E.queries()
ORACLES = E.oracle_sql()


def test_oracle_keys_are_queries():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["url_from", "url_to", "status_code"]
    assert df.count() == 43


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck_small, name):
    r = compare(spark, duck_small, name, QUERIES[name], ORACLES.get(name), SF_SMALL)
    assert not r["pairwise_join"], f"{name} plans a cartesian / nested-loop join"
    if ORACLES.get(name) is not None:
        assert r["cols_ok"], r
        assert r["rows_ok"], r
