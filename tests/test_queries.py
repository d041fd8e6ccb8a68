"""Every registered query against its DuckDB statement, on the smallest tables."""

import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from gleaner import catalog

FOLDER = os.environ.get("GLEANER_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not Path(FOLDER).is_dir(), reason="the driver's tables are not here")


def plain(value):
    if isinstance(value, float):
        return None if value != value else repr(round(value, 6))
    if isinstance(value, (list, tuple)):
        return str([plain(v) for v in value])
    if hasattr(value, "isoformat"):
        return value.isoformat().removesuffix("T00:00:00")
    return value if value is None else str(value)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(str(plain(row[i])) for i in order) for row in rows)


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for file in Path(FOLDER).glob("*.parquet"):
        connection.sql(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    frame = catalog.queries()[name](spark, FOLDER)
    found = table(frame.columns, frame.collect())
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert found[1]
        return
    relation = duck.sql(sql)
    assert found == table(relation.columns, relation.fetchall())


def test_entry_and_names(spark):
    assert entry.entry(spark).count() >= 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_outside_imports_the_optional_subpackage():
    root = Path(entry.__file__).parent
    for file in (root / "gleaner").rglob("*.py"):
        if "llm" not in file.parts:
            assert "gleaner.llm" not in file.read_text()
