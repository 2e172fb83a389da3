import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from compare import compare  # noqa: E402

from sedimark.llm import queries  # noqa: E402


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    assert compare(spark, queries.queries()[name], queries.oracle_sql()[name], "/root/testdata/sf0.01") is None
