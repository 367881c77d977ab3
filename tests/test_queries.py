"""Every registered query with SQL gives what DuckDB gives on the same tables."""

import math
import os

import duckdb
import pytest

from loomgraph.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value if isinstance(value, (int, str, bool, type(None))) else str(value)


def rows_of(rows, columns):
    return sorted((tuple(plain(r[c]) for c in columns) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = [dict(zip(df.columns, r, strict=True)) for r in df.collect()]
    if name not in registry.ORACLE_SQL:
        assert got
        return
    found = duck.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = [dict(zip(names, r, strict=True)) for r in found.fetchall()]
    assert rows_of(got, columns) == rows_of(want, columns)
