"""Every registered query against its SQL counterpart on the smallest tables."""

import compare
import pytest

import __spark_entry__ as driver

FOLDER = "/root/testdata/sf0.001"
STATEMENTS = driver.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return compare.duck(FOLDER)


def test_every_query_has_a_statement():
    optional = {n for n in driver.queries() if n.startswith("op") and n[2].isdigit()} | {"pipeline"}
    assert set(driver.queries()) - optional == set(STATEMENTS) - optional


@pytest.mark.parametrize("name", sorted(STATEMENTS))
def test_query(spark, con, name):
    columns, rows = compare.spark_rows(driver.queries()[name](spark, FOLDER))
    expected_columns, expected = compare.duck_rows(con, STATEMENTS[name])
    assert columns == expected_columns
    assert rows == expected
    assert rows


def test_entry(spark):
    assert driver.entry(spark).count() == 15
