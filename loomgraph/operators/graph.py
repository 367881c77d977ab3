"""Graph operators over an edge table (source, target, relation, confidence_tier, ...).

Frontiers, neighbourhoods and paths are bounded by their own limits. They are lists of ids that go
into filters, which reach the scan; so a level of a search is one filtered pass and no join. Only
shortest_paths searches without those limits; its levels are tables as soon as they are long. What
grows with the graph is only ever filtered, aggregated or joined by key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import TIERS
from .scratch import discard, materialise

#: Limits of graph queries.
MAX_DEPTH, MAX_NODES, MAX_EDGES = 3, 100, 200
MAX_PATH, MAX_VISITED, MAX_FRONTIER_EDGES = 15, 2000, 4000
HUB_FLOOR, HUB_PERCENTILE = 50, 0.99
#: Edges from which an end is kept out of shuffles by its key, and the most ends that can be: beyond it the edges rise.
#: As many ids may be broadcast.
HOT_EDGES, HOT_ENDS = 1000, 100_000
#: Relations along which a change reaches the source, and those along which it reaches the target.
TO_SOURCE, TO_TARGET = ("calls", "inherits", "imports"), ("decorates", "tested_by")


def ids_frame(df: DataFrame, ids: list[str], name: str = "id") -> DataFrame:
    return df.sparkSession.createDataFrame([(i,) for i in ids], f"{name} string")


def edge_filter(relations: list[str] | None = None, tiers: list[str] | None = None) -> Column:
    """Blank entries do not count; nothing left means no restriction. Unknown tiers are refused."""
    tidy = lambda xs: list(dict.fromkeys(x.strip() for x in xs or () if x.strip()))
    relations, tiers = tidy(relations), [t.upper() for t in tidy(tiers)]
    if unknown := [t for t in tiers if t not in TIERS]:
        raise ValueError(f"unknown confidence tiers: {unknown}")
    test = F.lit(True)
    if relations:
        test = test & F.col("relation").isin(relations)
    if tiers:
        test = test & F.col("confidence_tier").isin(tiers)
    return test


def degree_counts(edges: DataFrame) -> DataFrame:
    """node_id and degree: how often a node is an end of an edge, so a loop counts twice."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("node_id"))
    return ends.groupBy("node_id").agg(F.count(F.lit(1)).alias("degree"))


def hub_threshold(degrees: DataFrame, percentile: float = HUB_PERCENTILE, floor: int = HUB_FLOOR) -> DataFrame:
    """One row: the degree from which a node is a hub, by nearest rank.

    Ranks come from the histogram of degrees, which has as many rows as there are distinct degrees,
    so the one ordered task never sees a row for each node.
    """
    from pyspark.sql import Window as W

    histogram = degrees.groupBy("degree").agg(F.count(F.lit(1)).alias("n"))
    up = W.orderBy("degree").rowsBetween(W.unboundedPreceding, 0)
    everything = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    ranked = histogram.select("degree", F.sum("n").over(up).alias("upto"), F.sum("n").over(everything).alias("total"))
    place = F.floor(F.lit(percentile) * F.col("total") + F.lit(0.999999)).cast("bigint")
    at = F.min(F.when(F.col("upto") >= F.greatest(F.lit(1), F.least(place, F.col("total"))), F.col("degree")))
    return ranked.agg(F.greatest(F.coalesce(at, F.lit(0)), F.lit(floor)).alias("threshold"))


def top_entities(
    edges: DataFrame, entities: DataFrame, limit: int = 3, include_tests: bool = False
) -> DataFrame:
    """The best-connected entities below the hub threshold: id, kind, name, path, degree.

    Degrees are counted and written once; the threshold comes from their histogram and is a number by
    the time they are read again, so hubs are filtered out before the join."""
    degrees = materialise(degree_counts(edges), "degrees")
    threshold = hub_threshold(degrees).first()["threshold"]
    shown = entities
    if not include_tests:
        shown = entities.where(
            (F.col("kind") != "test") & ~F.col("is_test")
            & ~F.lower("path").like("tests/%") & ~F.lower("path").like("test/%")
        )
    ranked = shown.join(degrees, shown["id"] == degrees["node_id"], "left").select(
        "id", "kind", "name", "path", F.coalesce("degree", F.lit(0)).cast("bigint").alias("degree")
    )
    return ranked.where(F.col("degree") < threshold).orderBy(F.desc("degree"), "name", "id").limit(limit)


def touching(edges: DataFrame, ids: list[str]) -> DataFrame:
    """Edges with an end among a few ids, at most MAX_VISITED."""
    if len(ids) > MAX_VISITED:
        raise ValueError(f"more than {MAX_VISITED} ids")
    return edges.where(F.col("source").isin(ids) | F.col("target").isin(ids))


def adjacent_edges(
    edges: DataFrame, ids: list[str], limit: int, relations: list[str] | None = None, tiers: list[str] | None = None
) -> DataFrame:
    found = touching(edges.where(edge_filter(relations, tiers)), ids)
    return found.orderBy("source", "relation", "target").limit(limit)


def induced_edges(
    edges: DataFrame, nodes: DataFrame | list[str], limit: int, relations: list[str] | None = None, tiers: list[str] | None = None
) -> DataFrame:
    """Edges with both ends among the nodes: a filter for a list of ids, two semi-joins for a table."""
    kept = edges.where(edge_filter(relations, tiers))
    if isinstance(nodes, list):
        kept = kept.where(F.col("source").isin(nodes) & F.col("target").isin(nodes))
    else:
        few = nodes.select(F.col("id").alias("_n")).distinct()
        kept = kept.join(few, kept["source"] == few["_n"], "left_semi").join(few, F.col("target") == few["_n"], "left_semi")
    return kept.orderBy("source", "relation", "target").limit(limit)


@dataclass(frozen=True)
class Neighbourhood:
    nodes: list[tuple[str, int]]
    edges: list[tuple[str, str, str]]
    truncated: bool


def _level(edges: DataFrame, frontier: list[str], seen: set[str], room: int) -> tuple[list[tuple], bool, bool]:
    """New nodes next to a frontier, in edge order, at most `room`, each with its first edge.

    What comes to the driver is bounded: at most MAX_FRONTIER_EDGES edges in their order."""
    near = touching(edges, frontier).orderBy("source", "relation", "target")
    rows = near.limit(MAX_FRONTIER_EDGES + 1).collect()
    cut = len(rows) > MAX_FRONTIER_EDGES
    found: dict[str, tuple] = {}
    ahead = set(frontier)
    for r in rows[:MAX_FRONTIER_EDGES]:
        for node, parent in ((r["source"], r["target"]), (r["target"], r["source"])):
            if node not in seen and node not in found and parent in ahead:
                found[node] = (parent, r["source"], r["relation"], r["target"])
    new = list(found.items())
    return new[:room], cut, len(new) > room


def neighbourhood(
    edges: DataFrame, start: str, depth: int = 1, relations: list[str] | None = None, tiers: list[str] | None = None
) -> Neighbourhood:
    """Breadth-first and undirected, then the edges among the nodes found."""
    if not 1 <= depth <= MAX_DEPTH:
        raise ValueError(f"depth must be from 1 to {MAX_DEPTH}")
    kept = edges.where(edge_filter(relations, tiers)).select("source", "relation", "target")
    nodes, frontier, truncated = {start: 0}, [start], False
    for level in range(1, depth + 1):
        if not frontier or len(nodes) >= MAX_NODES:
            break
        new, cut, more = _level(kept, frontier, set(nodes), MAX_NODES - len(nodes))
        truncated = truncated or cut or more
        frontier = [n for n, _ in new]
        nodes |= dict.fromkeys(frontier, level)
    among = induced_edges(kept, list(nodes), MAX_EDGES + 1).collect()
    truncated = truncated or len(among) > MAX_EDGES
    return Neighbourhood(
        list(nodes.items()), [(r["source"], r["relation"], r["target"]) for r in among[:MAX_EDGES]], truncated
    )


def neighbourhood_frame(edges: DataFrame, start: str, depth: int, entities: DataFrame | None = None) -> DataFrame:
    """The nodes of a neighbourhood as rows: id, level, kind (external where no entity has the id)."""
    found = neighbourhood(edges, start, depth)
    rows = edges.sparkSession.createDataFrame(found.nodes, "id string, level int")
    if entities is None:
        return rows
    named = entities.select(F.col("id").alias("_id"), "kind", "name").where(F.col("id").isin([n for n, _ in found.nodes]))
    return rows.join(named, rows["id"] == named["_id"], "left").select(
        "id", "level", F.coalesce("kind", F.lit("external")).alias("kind"), F.coalesce("name", "id").alias("name")
    )


def shortest_path(
    edges: DataFrame, source: str, target: str, relations: list[str] | None = None, tiers: list[str] | None = None
) -> list[tuple[str, str | None]] | None:
    """Nodes from source to target, each with the relation that led to it; None if there is no path
    of at most MAX_PATH edges among the first MAX_VISITED nodes."""
    if source == target:
        return [(source, None)]
    kept = edges.where(edge_filter(relations, tiers)).select("source", "relation", "target")
    parent: dict[str, tuple] = {source: (None, None)}
    frontier = [source]
    for _ in range(MAX_PATH):
        if not frontier or len(parent) >= MAX_VISITED:
            return None
        new, _, _ = _level(kept, frontier, set(parent), MAX_VISITED - len(parent))
        parent |= {node: (by[0], by[2]) for node, by in new}
        if target in parent:
            path, at = [], target
            while at is not None:
                path.append((at, parent[at][1]))
                at = parent[at][0]
            return path[::-1]
        frontier = [n for n, _ in new]
    return None


@dataclass(frozen=True)
class Level:
    """Nodes that are equally far from a start (id, parent, relation), and their ids if they are few."""

    table: DataFrame
    ids: list[str] | None
    size: int

    def keys(self) -> DataFrame:
        """Broadcast by number only: a table of ids is many times as large in memory as on disk."""
        return self.table.select(F.col("id").alias("_n")).hint("broadcast" if self.size <= HOT_ENDS else "merge")


def _arcs(edges: DataFrame) -> DataFrame:
    """Each edge as seen from both of its ends: at, to."""
    ways = F.array(*(F.struct(F.col(a).alias("at"), F.col(b).alias("to")) for a, b in (("source", "target"), ("target", "source"))))
    return edges.select("source", "relation", "target", F.inline(ways)).where("to IS NOT NULL")


def _hot_ends(edges: DataFrame) -> DataFrame:
    """Ends with more edges than HOT_EDGES and more than their share, at most HOT_ENDS."""
    most = max(HOT_EDGES, 2 * edges.count() // HOT_ENDS)
    return degree_counts(edges).where(F.col("degree") > most).select(F.col("node_id").alias("_hot"))


def _arcs_from(edges: DataFrame, level: Level, hot: DataFrame | None) -> DataFrame:
    """The arcs at the nodes of a level: a filter if they are few, else a join by key; if it shuffles,
    hot ends take no part in that."""
    if level.ids is not None:
        return _arcs(touching(edges, level.ids)).where(F.col("at").isin(level.ids))
    arcs, ahead = _arcs(edges), level.keys()
    if level.size <= HOT_ENDS:
        return arcs.join(ahead, arcs["at"] == ahead["_n"], "left_semi")
    plain = arcs.join(F.broadcast(hot), arcs["at"] == hot["_hot"], "left_anti").join(ahead, F.col("at") == F.col("_n"), "left_semi")
    hot = hot.join(ahead, hot["_hot"] == ahead["_n"], "left_semi")
    return plain.unionByName(arcs.join(F.broadcast(hot), arcs["at"] == hot["_hot"], "left_semi"))


def _without(nodes: DataFrame, level: Level) -> DataFrame:
    if level.ids is not None:
        return nodes.where(~F.col("id").isin(level.ids))
    seen = level.keys()
    return nodes.join(seen, nodes["id"] == seen["_n"], "left_anti")


def shortest_paths(
    edges: DataFrame, source: str, targets: list[str], relations: list[str] | None = None, tiers: list[str] | None = None
) -> dict[str, list[tuple[str, str | None]] | None]:
    """What shortest_path gives for each of a few targets, by one search of the whole graph: however
    many nodes and edges a level has, all are looked at. None if no path has at most MAX_PATH edges.

    A level is written as a table, with the first edge that leads to each node by a grouped minimum.
    The neighbours of a level are in itself, the one before or the next, so two levels are taken out.
    """
    kept = edges.where(edge_filter(relations, tiers)).select("source", "relation", "target")
    start = edges.sparkSession.createDataFrame([(source, None, None)], "id string, parent string, relation string")
    levels, far, hot, written = [Level(start, [source], 1)], {source: 0} if source in targets else {}, None, []
    while len(levels) <= MAX_PATH and (wanted := [t for t in targets if t not in far]):
        if levels[-1].size > HOT_ENDS and hot is None:
            hot = materialise(_hot_ends(kept), "hot")
            written.append(hot)
        first = F.min(F.struct("source", "relation", "target")).alias("e")
        new = _arcs_from(kept, levels[-1], hot).groupBy(F.col("to").alias("id")).agg(first)
        for level in levels[-2:]:
            new = _without(new, level)
        parent = F.when(F.col("e.source") == F.col("id"), F.col("e.target")).otherwise(F.col("e.source"))
        table = materialise(new.select("id", parent.alias("parent"), F.col("e.relation").alias("relation")), "level")
        written.append(table)
        ids = [r["id"] for r in table.select("id").limit(MAX_VISITED + 1).collect()]
        if not ids:
            break
        far |= dict.fromkeys((r["id"] for r in table.where(F.col("id").isin(wanted)).select("id").collect()), len(levels))
        levels.append(Level(table, ids, len(ids)) if len(ids) <= MAX_VISITED else Level(table, None, table.count()))
    paths = {t: [] if t in far else None for t in targets}
    at = {}
    for k in range(max(far.values(), default=-1), 0, -1):
        at |= {t: t for t, n in far.items() if n == k}
        by = {r["id"]: r for r in levels[k].table.where(F.col("id").isin(list(set(at.values())))).collect()}
        for t, node in at.items():
            paths[t].append((node, by[node]["relation"]))
            at[t] = by[node]["parent"]
    discard(*written)
    return {t: None if path is None else [(source, None), *path[::-1]] for t, path in paths.items()}


def resolve_node(entities: DataFrame, wanted: str) -> DataFrame:
    """The one entity that a request means: by id, else path, else symbol name, else file name."""
    low = F.lower(F.lit(wanted))
    stage = (
        F.when(F.col("id") == wanted, 0)
        .when(F.lower("path") == low, 1)
        .when((F.col("kind") != "file") & ((F.lower("name") == low) | F.lower("name").endswith("." + wanted.lower())), 2)
        .when((F.col("kind") == "file") & (F.lower("name") == low), 3)
    )
    found = entities.withColumn("stage", stage).where("stage IS NOT NULL")
    length = F.when(F.col("stage") == 2, F.length("name")).otherwise(F.length("path"))
    return found.orderBy("stage", length, "path", "id").limit(1)


def dependents(
    edges: DataFrame,
    entities: DataFrame,
    changed: DataFrame,
    processed: DataFrame,
    limit: int | None = 50,
    to_source: tuple[str, ...] = TO_SOURCE,
    to_target: tuple[str, ...] = TO_TARGET,
) -> tuple[DataFrame, DataFrame]:
    """Paths of what depends on changed nodes, and whether the limit cut them off.

    Which end depends on which follows from the relation. Paths already processed are taken out
    before the limit, never after it. Without a limit all are given, and nothing was cut off."""
    c = changed.select(F.col("id").alias("_c"))
    backward = edges.where(F.col("relation").isin(*to_source))
    forward = edges.where(F.col("relation").isin(*to_target))
    found = (
        backward.join(c, backward["target"] == c["_c"], "left_semi").select(F.col("source").alias("id"))
        .unionByName(forward.join(c, forward["source"] == c["_c"], "left_semi").select(F.col("target").alias("id")))
        .distinct()
    )
    paths = found.join(entities.select("id", "path"), "id").select("path").distinct()
    rest = paths.join(processed.select("path"), "path", "left_anti")
    if limit is None:
        return rest, rest.sparkSession.createDataFrame([(False,)], "cap_hit boolean")
    probe = rest.orderBy("path").limit(limit + 1)
    return probe.orderBy("path").limit(limit), probe.agg((F.count(F.lit(1)) > limit).alias("cap_hit"))


def connected_candidates(edges: DataFrame, anchors: list[str], candidates: DataFrame, limit: int = 128) -> DataFrame:
    """Candidates with a direct edge to an anchor, looking at the first `limit` edges of the anchors."""
    near = touching(edges.select("source", "relation", "target"), anchors)
    near = near.orderBy("source", "relation", "target").limit(limit)
    ends = F.array(F.when(F.col("source").isin(anchors), F.col("target")), F.when(F.col("target").isin(anchors), F.col("source")))
    both = near.select(F.explode(F.array_compact(ends)).alias("id")).distinct()
    c = candidates.select(F.col("id").alias("_k"))
    return both.join(c, both["id"] == c["_k"], "left_semi")


def orphan_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with an end that is no node."""
    n = nodes.select(F.col("id").alias("_n"))
    no_source = edges.join(n, edges["source"] == n["_n"], "left_anti")
    no_target = edges.join(n, edges["target"] == n["_n"], "left_anti")
    return no_source.unionByName(no_target).distinct()


def edges_to_removed(edges: DataFrame, removed: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges to a removed symbol that has not come back; other orphans are left alone."""
    r = removed.select(F.col("id").alias("_r"))
    s = symbols.select(F.col("id").alias("_s"))
    gone = r.join(s, r["_r"] == s["_s"], "left_anti")
    return edges.join(gone, edges["target"] == gone["_r"], "left_semi")
