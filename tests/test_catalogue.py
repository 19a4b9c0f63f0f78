"""Every query with SQL gives the same rows in Spark and in DuckDB."""

from pathlib import Path

import duckdb
import pytest

from wavequery import catalogue

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


def cells(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        return repr(round(float(v), 6) + 0.0) if isinstance(v, float) else str(v)

    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def answer(sql):
    """Rows of the SQL over tables, each in a connection of its own."""
    with duckdb.connect(config={"threads": 4}) as c:
        for t in TABLES:
            c.execute(f"CREATE TABLE {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
        got = c.execute(sql)
        return [d[0] for d in got.description], got.fetchall()


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, name):
    df = catalogue.QUERIES[name](spark, str(DATA))
    rows = df.collect()
    if name not in catalogue.ORACLES:
        assert rows
        return
    columns, want = answer(catalogue.ORACLES[name])
    assert sorted(df.columns) == sorted(columns)
    assert cells(df.columns, rows) == cells(columns, want)


def test_entry_points():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(catalogue.QUERIES) >= 40
