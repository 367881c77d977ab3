"""Adapters from the star-schema tables to the engine's relations, and the same adapters in SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def node(kind: str, key: str):
    return F.concat(F.lit(f"{kind}::"), F.col(key).cast("string"))


def g_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, target, relation, confidence_tier over regions, nations, customers, suppliers, orders, parts."""
    t = lambda name: table(spark, sf_dir, name)

    def edges(df: DataFrame, source: tuple[str, str], target: tuple[str, str], relation: str, tier: str) -> DataFrame:
        return df.select(
            node(*source).alias("source"), node(*target).alias("target"), F.lit(relation).alias("relation"),
            F.lit(tier).alias("confidence_tier"),
        )

    # Repeated edges go while their ends are still numbers; a filter on the ids passes below that.
    lines = lambda *keys: t("lineitem").select(*keys).distinct()
    parts = [
        edges(t("customer"), ("customer", "c_custkey"), ("nation", "c_nationkey"), "in", "EXTRACTED"),
        edges(t("nation"), ("nation", "n_nationkey"), ("region", "n_regionkey"), "in", "EXTRACTED"),
        edges(t("supplier"), ("supplier", "s_suppkey"), ("nation", "s_nationkey"), "in", "EXTRACTED"),
        edges(t("orders"), ("order", "o_orderkey"), ("customer", "o_custkey"), "placed_by", "EXTRACTED"),
        edges(lines("l_orderkey", "l_partkey"), ("order", "l_orderkey"), ("part", "l_partkey"), "contains", "INFERRED"),
        edges(lines("l_suppkey", "l_partkey"), ("supplier", "l_suppkey"), ("part", "l_partkey"), "supplies", "AMBIGUOUS"),
    ]
    return reduce(DataFrame.unionByName, parts)


G_EDGES = """g_edges AS (
  SELECT 'customer::' || c_custkey AS source, 'nation::' || c_nationkey AS target, 'in' AS relation, 'EXTRACTED' AS confidence_tier FROM customer
  UNION ALL SELECT 'nation::' || n_nationkey, 'region::' || n_regionkey, 'in', 'EXTRACTED' FROM nation
  UNION ALL SELECT 'supplier::' || s_suppkey, 'nation::' || s_nationkey, 'in', 'EXTRACTED' FROM supplier
  UNION ALL SELECT 'order::' || o_orderkey, 'customer::' || o_custkey, 'placed_by', 'EXTRACTED' FROM orders
  UNION ALL SELECT DISTINCT 'order::' || l_orderkey, 'part::' || l_partkey, 'contains', 'INFERRED' FROM lineitem
  UNION ALL SELECT DISTINCT 'supplier::' || l_suppkey, 'part::' || l_partkey, 'supplies', 'AMBIGUOUS' FROM lineitem
)"""


def g_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, parent_id, kind, name, path, is_test of regions, nations, customers, suppliers and parts."""
    t = lambda name: table(spark, sf_dir, name)
    none = F.lit(None).cast("string")

    def rows(df: DataFrame, kind: str, key: str, name: str, parent, test=None) -> DataFrame:
        return df.select(
            node(kind, key).alias("id"), parent.alias("parent_id"), F.lit(kind).alias("kind"),
            F.col(name).alias("name"), F.concat(F.lit(f"{kind}/"), F.col(key).cast("string")).alias("path"),
            (F.lit(False) if test is None else test).alias("is_test"),
        )

    parts = [
        rows(t("region"), "region", "r_regionkey", "r_name", none),
        rows(t("nation"), "nation", "n_nationkey", "n_name", node("region", "n_regionkey")),
        rows(t("customer"), "customer", "c_custkey", "c_name", node("nation", "c_nationkey"), F.col("c_custkey") % 10 == 0),
        rows(t("supplier"), "supplier", "s_suppkey", "s_name", node("nation", "s_nationkey")),
        rows(t("part"), "part", "p_partkey", "p_name", none, F.col("p_partkey") % 7 == 0),
    ]
    return reduce(DataFrame.unionByName, parts)


G_ENTITIES = """g_entities AS (
  SELECT 'region::' || r_regionkey AS id, NULL::VARCHAR AS parent_id, 'region' AS kind, r_name AS name, 'region/' || r_regionkey AS path, false AS is_test FROM region
  UNION ALL SELECT 'nation::' || n_nationkey, 'region::' || n_regionkey, 'nation', n_name, 'nation/' || n_nationkey, false FROM nation
  UNION ALL SELECT 'customer::' || c_custkey, 'nation::' || c_nationkey, 'customer', c_name, 'customer/' || c_custkey, c_custkey % 10 = 0 FROM customer
  UNION ALL SELECT 'supplier::' || s_suppkey, 'nation::' || s_nationkey, 'supplier', s_name, 'supplier/' || s_suppkey, false FROM supplier
  UNION ALL SELECT 'part::' || p_partkey, NULL, 'part', p_name, 'part/' || p_partkey, p_partkey % 7 = 0 FROM part
)"""


def versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two versions of the documents as files (path, sha256): some deleted, changed and added."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    path = lambda c: F.concat(F.lit("docs/"), c.cast("string"), F.lit(".txt"))
    before = docs.select(path(F.col("doc_id")).alias("path"), F.sha2("text", 256).alias("sha256"))
    kept = docs.where("doc_id % 17 <> 0").select(
        path(F.col("doc_id")).alias("path"),
        F.sha2(F.when(F.expr("doc_id % 13 = 0"), F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("sha256"),
    )
    added = docs.where("doc_id % 29 = 0").select(
        path(F.col("doc_id") + 1_000_000).alias("path"), F.sha2("text", 256).alias("sha256")
    )
    return before, kept.unionByName(added)


VERSIONS = """v1 AS (
  SELECT 'docs/' || doc_id || '.txt' AS path, sha256(coalesce(text, '')) AS sha256 FROM documents
), v2 AS (
  SELECT 'docs/' || doc_id || '.txt' AS path,
    sha256(CASE WHEN doc_id % 13 = 0 THEN coalesce(text, '') || '!' ELSE coalesce(text, '') END) AS sha256
  FROM documents WHERE doc_id % 17 <> 0
  UNION ALL SELECT 'docs/' || (doc_id + 1000000) || '.txt', sha256(coalesce(text, '')) FROM documents WHERE doc_id % 29 = 0
)"""
