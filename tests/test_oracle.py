"""Every registered query against its SQL counterpart."""

import os

import pytest
from oracle import compare

import __spark_entry__ as entry

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, name):
    df = QUERIES[name](spark, SF_DIR)
    if name in SQL:
        message, _ = compare(df, SQL[name], SF_DIR)
        assert message is None, message
    else:
        assert df.count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(SQL) <= set(QUERIES)
