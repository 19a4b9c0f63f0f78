"""The corpus queries that have SQL give the same rows in Spark and in DuckDB."""

from pathlib import Path

import duckdb
import pytest

from wavequery.llm import registry

DATA = Path("/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


def cells(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(round(v, 6)) if isinstance(v, float) else str(v) for v in (r[i] for i in order)) for r in rows)


@pytest.mark.parametrize("name", list(registry.ORACLES))
def test_query(spark, name):
    df = registry.QUERIES[name](spark, str(DATA))
    with duckdb.connect() as c:
        for t in ("documents", "labels", "benchmark"):
            c.execute(f"CREATE TABLE {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
        got = c.execute(registry.ORACLES[name])
        columns, want = [d[0] for d in got.description], got.fetchall()
    assert sorted(df.columns) == sorted(columns)
    assert cells(df.columns, df.collect()) == cells(columns, want)


def test_every_operator_is_registered():
    assert [n.split("_")[0] for n in registry.QUERIES] == [*[f"op{i}" for i in range(1, 14)], "pipeline"]
