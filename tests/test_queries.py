"""Every query of the core with SQL gives the rows of its SQL."""

import pytest

import __spark_entry__ as entry
from gridloom.plans import data_queries, estimate_queries, file_queries, fit_queries, record_queries, report_queries
from oracle import compare

CORE = {
    **record_queries.QUERIES, **data_queries.QUERIES, **fit_queries.QUERIES, **report_queries.QUERIES, **file_queries.QUERIES,
    **estimate_queries.QUERIES
}


@pytest.mark.parametrize("name", [n for n in CORE if n in entry.oracle_sql()])
def test_rows_of_sql(spark, data, name):
    n, mine, theirs = compare(spark, data, CORE[name], entry.oracle_sql()[name])
    assert not mine and not theirs and n


@pytest.mark.parametrize("name", [n for n in CORE if n not in entry.oracle_sql()])
def test_runs(spark, data, name):
    assert CORE[name](spark, data).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
