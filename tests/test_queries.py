"""Every registered query against its oracle statement, at the smallest scale."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_points
from pageloom.plans import queries

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    connection = duckdb.connect()
    for file in Path(SF_DIR).glob("*.parquet"):
        connection.sql(f"create view {file.stem} as select * from '{file}'")
    yield connection
    connection.close()
    queries.release_all()


def comparable(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(row[i]) for i in order) for row in rows)


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, oracle, name):
    result = entry_points.queries()[name](spark, SF_DIR)
    wanted = oracle.sql(entry_points.oracle_sql()[name])
    assert sorted(result.columns) == sorted(wanted.columns)
    rows = result.collect()
    assert rows
    assert comparable(rows, result.columns) == comparable(wanted.fetchall(), wanted.columns)


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
