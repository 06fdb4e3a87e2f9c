"""Every registered query of the library: against SQL where it has some, else that it runs."""

import pytest
from oracle import compare

import __spark_entry__
from maskframe.plans import queries as Q


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query_equals_sql(spark, tiny, name):
    compare(spark, tiny, Q.QUERIES[name], Q.SQL[name])


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.SQL)))
def test_query_runs(spark, tiny, name):
    df = Q.QUERIES[name](spark, tiny)
    assert df.columns
    assert df.count() >= 0


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() > 0
    assert {"doc_id", "masked_text", "n_spans"} <= set(df.columns)


def test_names_agree():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
