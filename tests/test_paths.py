"""Searches for paths whose levels have more nodes and edges than the limits of other graph queries."""

import random

import duckdb
import pytest

from loomgraph.operators import graph
from loomgraph.plans import registry

EDGES = "source string, target string, relation string, confidence_tier string"


@pytest.fixture(scope="module")
def crowded(tmp_path_factory):
    """Tables where each of five nations has 4,500 customers, before its region in the order of edges."""
    folder = str(tmp_path_factory.mktemp("crowded"))
    con = duckdb.connect()
    for t in "region nation customer supplier orders lineitem".split():
        few = {"region": "true", "nation": "n_nationkey % 5 = 0", "supplier": "s_suppkey < 5"}.get(t, "false")
        con.execute(f"CREATE TABLE {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet' WHERE {few}")
    con.execute("UPDATE supplier SET s_nationkey = 10")
    con.execute("INSERT INTO customer SELECT i, 'c' || i, (i % 5)::INT * 5, 0, 'X' FROM range(22500) t(i)")
    for t in "region nation customer supplier orders lineitem".split():
        con.execute(f"COPY {t} TO '{folder}/{t}.parquet' (FORMAT parquet)")
    return folder, con


def as_sql(spark, crowded, name):
    folder, con = crowded
    got = registry.QUERIES[name](spark, folder)
    found = con.execute(registry.ORACLE_SQL[name])
    assert [d[0] for d in found.description] == got.columns
    want = sorted(map(str, found.fetchall()))
    assert sorted(str(tuple(r)) for r in got.collect()) == want
    return want


def test_length_in_crowded_nations(spark, crowded):
    assert "('nation::5', 3)" in as_sql(spark, crowded, "shortest_path_length")


def test_steps_in_crowded_nations(spark, crowded):
    assert as_sql(spark, crowded, "shortest_path_steps") == [
        "(0, 'supplier::1', None)", "(1, 'nation::10', 'in')", "(2, 'region::0', 'in')"
    ]


@pytest.mark.parametrize(
    "change, steps",
    [
        ("DELETE FROM supplier", 1),
        ("UPDATE supplier SET s_nationkey = NULL", 2),
        ("DELETE FROM nation WHERE n_nationkey = 10", 2),
        ("UPDATE nation SET n_regionkey = NULL", 3),
    ],
)
def test_steps_as_far_as_there_are_rows(spark, crowded, tmp_path, change, steps):
    con = duckdb.connect()
    for t in "region nation customer supplier orders lineitem".split():
        con.execute(f"CREATE TABLE {t} AS SELECT * FROM '{crowded[0]}/{t}.parquet'")
    con.execute(change)
    for t in "region nation customer supplier orders lineitem".split():
        con.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
    assert len(as_sql(spark, (str(tmp_path), con), "shortest_path_steps")) == steps


def first_parents(edges, source):
    """Breadth-first by hand: the first edge by (source, relation, target) leads to a node."""
    parent, frontier = {source: None}, {source}
    while frontier:
        new = {}
        for s, r, t in sorted(edges):
            for at, to in ((s, t), (t, s)):
                if at in frontier and to not in parent and to not in new:
                    new[to] = (at, r)
        parent |= new
        frontier = set(new)
    return parent


def test_paths_by_hand(spark, monkeypatch):
    """The same by filters, by joins and with hot ends."""
    dice = random.Random(3)
    edges = [(f"n{dice.randrange(90)}", f"n{dice.randrange(90)}", dice.choice("xy")) for _ in range(110)]
    edges += [("hub", f"n{i}", "x") for i in range(0, 60, 3)] + [("p", "q", "x"), ("n1", "n1", "x"), edges[0]]
    frame = spark.createDataFrame([(*e, "EXTRACTED") for e in edges] + [("n2", None, "x", "EXTRACTED")], EDGES).repartition(3)
    parent = first_parents([(s, r, t) for s, t, r in edges], "n0")
    targets = ["n0", "q", "absent", "hub", *(f"n{i}" for i in range(1, 90, 7))]
    want = {}
    for t in targets:
        path, node = [], t
        while parent.get(node):
            path.append((node, parent[node][1]))
            node = parent[node][0]
        want[t] = [("n0", None), *path[::-1]] if t in parent else None
    assert max(len(p) for p in want.values() if p) > 4
    assert graph.shortest_paths(frame, "n0", targets) == want
    assert {t: graph.shortest_path(frame, "n0", t) for t in targets[:6]} == {t: want[t] for t in targets[:6]}
    monkeypatch.setattr(graph, "MAX_VISITED", 3)
    monkeypatch.setattr(graph, "HOT_EDGES", 4)
    assert graph._hot_ends(frame).count() > 0
    assert graph.shortest_paths(frame, "n0", targets) == want
    monkeypatch.setattr(graph, "HOT_ENDS", 15)
    made = []
    level = graph.Level
    monkeypatch.setattr(graph, "Level", lambda *a: made.append(level(*a)) or made[-1])
    assert graph.shortest_paths(frame, "n0", targets) == want
    assert graph._hot_ends(frame).count() > 0 and max(x.size for x in made) > 15


def test_long_levels_are_not_broadcast(spark, monkeypatch):
    """Whatever their size on disk is, which says little of ids that compress well."""
    frame = spark.createDataFrame([("a", f"b{i}", "x", "EXTRACTED") for i in range(50)] + [("b7", "c", "x", "EXTRACTED")], EDGES)
    monkeypatch.setattr(graph, "MAX_VISITED", 3)
    monkeypatch.setattr(graph, "HOT_ENDS", 10)
    plans, write = [], graph.materialise
    monkeypatch.setattr(graph, "materialise", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df, name))
    assert graph.shortest_paths(frame, "a", ["c"]) == {"c": [("a", None), ("b7", "x"), ("c", "x")]}
    assert "SortMergeJoin" in plans[-1] and plans[-1].count("BroadcastHashJoin") <= 2  # hot ends, which are counted


def test_no_path_over_the_most_steps(spark):
    chain = spark.createDataFrame([(f"c{i}", f"c{i + 1}", "x", "EXTRACTED") for i in range(17)], EDGES)
    found = graph.shortest_paths(chain, "c0", ["c15", "c16"])
    assert len(found["c15"]) == 16 and found["c16"] is None
    assert graph.shortest_paths(chain, "c0", []) == {} and graph.shortest_paths(chain, "c9", ["c9"]) == {"c9": [("c9", None)]}
