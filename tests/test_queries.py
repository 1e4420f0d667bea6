"""Every registered query with SQL gives the SQL's rows."""

import pytest

from tests.oracle import compare
from tideline.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_matches_sql(spark, sf, name):
    compare(spark, sf, catalogue.queries()[name], catalogue.oracle_sql()[name])


def test_entry_and_queries(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert catalogue.queries()["batched_scoring"](spark, "/root/testdata/sf0.001").count() == 500
