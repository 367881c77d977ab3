"""Evaluation of retrieval answers: recall, precision, roles, samples, corpus checks, tree digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Categories whose related slices count as precise, and the roles that are relations.
IMPACT_CATEGORIES = ("refactor", "structural", "test-impact", "debug", "cross-file")
RELATION_ROLES = ("caller", "dependency", "test")


def score_answers(tasks: DataFrame, slices: DataFrame, evidence: DataFrame, ranges: DataFrame) -> DataFrame:
    """(id, recall, role_recall, precision) of each task.

    tasks: id, category, expected_status; slices: id, path, lo, hi, role; evidence: id, path,
    line, role (null: any); ranges: id, path, lo, hi. Joins are equi-joins on (id, path) with the
    overlap as a further condition."""
    e = evidence.select("id", "path", "line", F.col("role").alias("want"), F.monotonically_increasing_id().alias("e"))
    hit = e.join(slices, ["id", "path"]).where("line BETWEEN lo AND hi")
    hits = hit.groupBy("id", "e").agg(F.max((F.col("want").isNull() | (F.col("role") == F.col("want"))).cast("int")).alias("role_ok"))
    recalls = (
        e.select("id", "e").join(hits, ["id", "e"], "left").groupBy("id")
        .agg(F.avg(F.col("role_ok").isNotNull().cast("int")).alias("recall"), F.avg(F.coalesce("role_ok", F.lit(0))).alias("role_recall"))
    )
    r = ranges.select(F.col("id").alias("_i"), F.col("path").alias("_p"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
    overlaps = (F.col("id") == F.col("_i")) & (F.col("path") == F.col("_p")) & (F.col("lo") <= F.col("_hi")) & (F.col("hi") >= F.col("_lo"))
    told = slices.join(tasks.select("id", "category"), "id")
    related = F.col("category").isin(*IMPACT_CATEGORIES) & F.col("role").isin(*RELATION_ROLES)
    inside = told.join(r, overlaps, "left_semi").select("id", F.lit(1).alias("ok"))
    outside = told.join(r, overlaps, "left_anti").select("id", related.cast("int").alias("ok"))
    precise = inside.unionByName(outside).groupBy("id").agg(F.avg("ok").alias("precision"))
    empty = F.when(F.col("expected_status") != "ready", 1.0).otherwise(0.0)
    return tasks.join(recalls, "id", "left").join(precise, "id", "left").select(
        "id", F.coalesce("recall", F.lit(1.0)).alias("recall"), F.coalesce("role_recall", F.lit(1.0)).alias("role_recall"),
        F.coalesce("precision", empty).alias("precision"),
    )


def sample_medians(samples: DataFrame, key: str, order: str, whole: list[str], real: list[str]) -> DataFrame:
    """One row a key: medians of its samples (whole numbers are cut off), their number, and the rest
    of the last sample."""
    return samples.groupBy(key).agg(
        *[F.median(c).cast("bigint").alias(c) for c in whole],
        *[F.bround(F.median(c), 3).alias(c) for c in real],
        F.count(F.lit(1)).alias("sample_count"),
        F.max(order).alias("last"),
    )


def corpus_completeness(tasks: DataFrame, repositories: DataFrame, expected: int) -> DataFrame:
    """One row of gates: exact number of tasks, all supported, contracts complete, pins complete.

    tasks: id, repo, commit, supported, status, n_targets, n_candidates, n_ranges, n_evidence."""
    pins = repositories.select(F.col("repo").alias("_r"), F.col("commit").alias("_c"))
    joined = tasks.join(pins, tasks["repo"] == pins["_r"], "left")
    present = (
        F.when(F.col("status") == "ready", F.col("n_targets") > 0).when(F.col("status") == "ambiguous", F.col("n_candidates") > 0)
    ).otherwise(True)
    complete = present & (F.col("n_ranges") > 0) & ((F.col("status") != "ready") | (F.col("n_evidence") > 0))
    yes = lambda c: F.coalesce(F.bool_and(c), F.lit(True))
    return joined.agg(
        F.count(F.lit(1)).alias("task_count"),
        (F.count(F.lit(1)) == expected).alias("task_count_exact"),
        yes(F.col("supported")).alias("all_tasks_supported"),
        yes(~F.col("supported") | complete).alias("task_contracts_complete"),
        yes(~F.col("supported") | F.coalesce(F.col("_c") == F.col("commit"), F.lit(False))).alias("repository_pins_complete"),
    )


def counts_of(rows: DataFrame, value: str) -> DataFrame:
    return rows.groupBy(value).agg(F.count(F.lit(1)).alias("n")).orderBy(value)


def tree_digest(files: DataFrame) -> str:
    """SHA-1 over path and content of all files in order of path, as a tree's revision.

    Rows stream to the driver in order, one partition at a time, so it never holds a tree."""
    import hashlib

    digest = hashlib.sha1(usedforsecurity=False)
    for row in files.select("path", "content").orderBy("path").toLocalIterator():
        digest.update(row["path"].encode() + b"\0" + bytes(row["content"]) + b"\0")
    return digest.hexdigest()


def gates(summary: DataFrame, least: dict[str, float], most: dict[str, float]) -> DataFrame:
    """Adds passed: every metric within its bounds."""
    tests: list[Column] = [F.col(k) >= v for k, v in least.items()] + [F.col(k) <= v for k, v in most.items()]
    out = F.lit(True)
    for t in tests:
        out = out & t
    return summary.withColumn("passed", out)
