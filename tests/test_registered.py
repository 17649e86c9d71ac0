"""Every registered query against its SQL, on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
import check

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES = entry.queries()
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return check.connect(SF)


def test_every_query_has_sql():
    others = set(entry.llm.queries()) if entry.llm else set()
    assert set(QUERIES) - others <= set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, con, name):
    if SF.endswith("sf0.001") and name == "document_mixture_gc_fl":
        pytest.skip("80 rows are not there at this scale")
    verdict = check.compare(spark, con, SF, name, QUERIES[name], SQL[name])
    assert verdict.startswith("same"), verdict


def test_entry_runs(spark):
    assert entry.entry(spark).count() == entry.NUM_INSTANCES
