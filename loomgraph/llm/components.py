"""Connected components of an edge table by alternating large-star and small-star steps.

A node's smallest neighbour comes from a grouped minimum, which combines before the shuffle, and goes
back to the edges by a join. The edges of a node with many are dealt out by a second key in that
join, so a hub's edges are never gathered in one place. The number of steps grows with the logarithm
of the number of nodes. Each step is written to the shared folder, so lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise

#: Rows of one key from which it is dealt out, and the most keys that can be: beyond it the rows rise.
HOT_ROWS, HOT_KEYS = 1000, 100_000


def join_by_key(rows: DataFrame, counted: DataFrame, key: str, spread: str, total: int) -> DataFrame:
    """rows with the columns of `counted` for their key; counted has one row a key, and its column n
    says how many rows the key has (total: all together).

    Keys with more rows than HOT_ROWS, or than total / HOT_KEYS, are dealt out by the column
    `spread`. There can be no more than HOT_KEYS such keys, so their table may be broadcast."""
    hot_rows = max(HOT_ROWS, total // HOT_KEYS)
    parts = F.when(F.col("n") > hot_rows, F.ceil(F.col("n") / hot_rows).cast("int"))
    hot = counted.select(F.col(key).alias("_hot"), parts.alias("_parts")).where("_parts IS NOT NULL")
    marked = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left")
    dealt = marked.withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(spread), F.col("_parts")), F.lit(0))).drop("_hot", "_parts")
    copies = counted.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), (F.coalesce(parts, F.lit(1)) - 1).cast("bigint"))))
    return dealt.join(copies, [key, "_salt"]).drop("_salt")


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
    return tuple(row)


def _with_smallest(directed: DataFrame, total: int) -> DataFrame:
    """(u, v, m): edges with the smallest of u and its neighbours."""
    least = directed.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    return join_by_key(directed, least, "u", "v", total).select("u", "v", F.least("u", "m").alias("m"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the undirected edges (u, v) that is not its own root; the root
    is the component's smallest node. Loops and repeated edges do no harm; no edges, no rows."""
    tidy = edges.where(F.col("u") != F.col("v")).select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    )
    current = materialise(tidy.distinct(), "edges")
    seen = _digest(current)
    while seen[0]:
        # Large star: a node's larger neighbours go to its smallest neighbour.
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_smallest(both, 2 * seen[0]).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialise(large.where(F.col("u") != F.col("v")).distinct(), "edges")
        # Small star: a node and its smaller neighbours go to the smallest of them.
        small = (
            _with_smallest(large, seen[0])
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
        )
        before, current = current, materialise(small.where(F.col("u") != F.col("v")).distinct(), "edges")
        discard(before, large)
        now = _digest(current)
        if now == seen:
            break
        seen = now
    return current.select(F.col("u").alias("node"), F.col("v").alias("root"))
