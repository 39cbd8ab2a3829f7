"""Every registered query runs, and equals its SQL on the smallest tables."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract
from crossweft.checks import all_queries

from .conftest import SMALL

SQL = contract.oracle_sql()


@pytest.fixture(scope="module")
def con():
    db = duckdb.connect()
    for path in Path(SMALL).glob("*.parquet"):
        db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return db


def cell(v):
    if isinstance(v, float):
        return f"{v + 0.0:.6f}"
    return str(v)


def rows(table):
    names = sorted(table.column_names)
    return Counter(tuple(cell(v) for v in r) for r in zip(*[table[n].to_pylist() for n in names])), names


def test_entry(spark):
    assert contract.entry(spark).count() > 0
    assert set(all_queries()) <= set(contract.queries()) and set(SQL) <= set(contract.queries())


@pytest.mark.parametrize("name", list(all_queries()))
def test_query(spark, con, name):
    got = contract.queries()[name](spark, SMALL).toArrow()
    if name in SQL:
        want = con.sql(SQL[name]).to_arrow_table()
        assert rows(got) == rows(want)
    else:
        assert got.num_rows > 0
