"""The registered queries of the subpackage: names, and SQL where SQL can express them."""

import duckdb
import pytest

import __spark_entry__ as entry_points
from loomgraph.llm import queries

SF = "/root/testdata/sf0.001"


def test_each_operator_is_registered():
    names = entry_points.queries()
    for n in range(1, 11):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert "pipeline" in names


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    frame = queries.QUERIES[name](spark, SF)
    found = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    want = sorted(map(str, found.fetchall()))
    assert sorted(str(tuple(r[c] for c in names)) for r in frame.collect()) == want
