"""Every registered query against its SQL, on the smallest tables."""

import os

import pytest
import support

import __spark_entry__ as entry

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return support.connect(SF_DIR)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_matches_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF_DIR)
    if name in ORACLES:
        assert support.difference(df, duck, ORACLES[name]) is None
    else:
        assert df.count() > 0


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize(
    "name", ["stream_offsets", "random_budget_subset", "repeat_subset", "compute_ledger", "hybrid_select"]
)
def test_the_text_is_read_once(spark, name):
    """What follows the written tokens or counts has no scan of the text left."""
    plan = entry.queries()[name](spark, SF_DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert "text#" not in plan
