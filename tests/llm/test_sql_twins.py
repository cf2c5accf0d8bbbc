import sys

import pytest

sys.path.insert(0, "tests")
from oracle import compare, connect  # noqa: E402

from quern.llm.queries import ORACLE_SQL, QUERIES  # noqa: E402

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    assert compare(spark, connect(DIR), DIR, QUERIES[name], ORACLE_SQL[name]) == ""
