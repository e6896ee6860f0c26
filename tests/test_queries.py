"""Every registered query against its SQL text."""

import pytest
from compare import spark_result, sql_result, tables

import __spark_entry__ as entry_points
from cohortry.plans import QUERIES, SQL

@pytest.fixture(scope="module")
def duck(data):
    return tables(data)


# Decompositions of all features; test_describe.py compares them with numpy.
WITHOUT_SQL = {"pca_spectrum", "pca_fraction"}


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES) - WITHOUT_SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, duck, data, name):
    assert spark_result(QUERIES[name](spark, data)) == sql_result(duck, SQL[name])


def test_all_queries_are_registered():
    assert set(QUERIES) <= set(entry_points.queries())
    assert set(SQL) <= set(entry_points.oracle_sql())


def test_entry(spark):
    assert "label" in entry_points.entry(spark).columns
