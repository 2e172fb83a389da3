"""Every query with an oracle gives the rows of its SQL."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from compare import compare  # noqa: E402

from sedimark.plans import catalog  # noqa: E402


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, name):
    assert compare(spark, catalog.queries()[name], catalog.oracle_sql()[name], "/root/testdata/sf0.001") is None


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    df = catalog.queries()[name](spark, "/root/testdata/sf0.001")
    assert df.columns and df.count() >= 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
