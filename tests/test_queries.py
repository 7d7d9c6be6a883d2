"""Every registered query agrees with its SQL on the small tables."""

import pytest

import __spark_entry__ as entry
from compare import compare
from conftest import DATA

ORACLE = entry.oracle_sql()


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, con, name):
    run = entry.queries()[name]
    _, _, _, problem = compare(spark, con, name, run, ORACLE.get(name), DATA)
    assert problem is None


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 6 and all(0.0 <= r["train_accuracy"] <= 1.0 for r in rows)
