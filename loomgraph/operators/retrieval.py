"""Retrieval operators: candidates, ranking, expansion, selection and packing into a budget."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T

#: Limits and thresholds of retrieval.
MAX_CANDIDATES, MAX_SLICES, MAX_RELATIONSHIPS = 256, 16, 128
CONFIDENCE, MARGIN = 0.75, 0.15
#: Relations in the order in which expansion looks at them.
RELATION_ORDER = ("calls", "tested_by", "inherits", "imports")
#: What a role adds to the score of a neighbour.
ROLE_BONUS = {"test": 8.0, "dependency": 7.0, "caller": 6.0}


def target_cascade(symbols: DataFrame, wanted: str, reexported: DataFrame | None = None, limit: int = 9) -> DataFrame:
    """(id, stage): what a requested target may be, from the first stage that finds anything.

    Stages: 0 id, 1 exact name, 2 re-export, 3 qualified suffix, 4 exact path, 5 part of a name or
    path. symbols: id, name, path, start_line."""
    low = wanted.strip().lower()
    path = wanted.strip().replace("\\", "/").lstrip("./").lower()
    name, sid, at = F.lower("name"), F.lower("id"), F.lower("path")
    stage = (
        F.when(F.col("id") == wanted.strip(), 0).when(name == low, 1)
        .when(sid.endswith("::" + low) | sid.endswith("." + low), 3).when(at == path, 4)
        .when(name.contains(low) | at.contains(path), 5)
    )
    found = symbols.select("id", "name", "path", "start_line", stage.alias("stage")).where("stage IS NOT NULL")
    if reexported is not None:
        more = symbols.join(reexported.select("id"), "id", "left_semi")
        found = found.unionByName(more.select("id", "name", "path", "start_line", F.lit(2).alias("stage")))
    length = F.when(F.col("stage") == 5, F.length("name")).otherwise(0)
    first = found.orderBy("stage", length, "path", "start_line", "id").limit(limit)
    least = F.min("stage").over(W.partitionBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return first.withColumn("least", least).where("stage = least").select("id", "stage")


def score_candidates(
    rows: DataFrame, task: str, target: str | None = None, fts_count: int = 0, asks_for_tests: bool | None = None
) -> DataFrame:
    """Adds score, precedence, penalty_rank, scope_rank, graph_rank to candidate rows.

    rows: id, name, path, is_test, and the evidence target_position, target_exact, fts_position,
    exact_name, scope (0 same file, 1 imported, else 2), graph_near; nulls mean no such evidence."""
    low = F.lit(task.lower())
    task_tokens = T.words(*_tokens(task)) if _tokens(task) else F.array().cast("array<string>")
    tests = asks_for_tests if asks_for_tests is not None else bool(set(_tokens(task)) & set(T.TEST_WORDS))
    name, path = F.lower("name"), F.lower("path")
    explicit = F.lit(False)
    if target:
        want = target.lower()
        explicit = (name == want) | (path == want) | (F.lower("id") == want)
    base = F.greatest(
        F.when(F.col("target_position").isNotNull(), 100.0 - F.col("target_position")),
        F.when(F.col("fts_position").isNotNull(), 30.0 - F.col("fts_position") / F.lit(float(max(1, fts_count))) * 10.0),
        F.when(F.col("exact_name"), F.lit(60.0)), F.lit(0.0),
    )
    precedence = F.least(
        F.when(explicit, 0),
        F.when(F.col("target_position").isNotNull(), F.when(F.col("target_exact"), 0).otherwise(1)),
        F.when(F.col("exact_name"), 2),
        F.when(F.col("fts_position").isNotNull(), 3),
        F.lit(9),
    )
    rows = rows.withColumn("precedence", precedence)
    free = F.col("precedence") == 0
    test_penalty = F.col("is_test") & F.lit(not tests) & ~free
    vendor_penalty = T.is_generated_path(path) & ~free
    overlap = F.size(F.array_intersect(F.array_distinct(T.identifier_tokens(F.concat_ws(" ", name, path))), task_tokens))
    bonus = lambda test, x: F.when(test, F.lit(x)).otherwise(F.lit(0.0))
    scope = F.coalesce("scope", F.lit(2))
    score = (
        base + bonus((name != "") & F.contains(low, name), 20.0) + bonus((path != "") & F.contains(low, path), 15.0)
        + bonus(explicit, 50.0) + overlap * 2.0
        + F.when(scope == 0, 18.0).when(scope == 1, 12.0).otherwise(0.0) + bonus(F.col("graph_near"), 6.0)
        - bonus(test_penalty, 24.0) - bonus(vendor_penalty, 20.0)
    )
    return rows.select(
        "*", score.alias("score"), (test_penalty | vendor_penalty).cast("int").alias("penalty_rank"),
        scope.alias("scope_rank"), F.when(F.col("graph_near"), 0).otherwise(1).alias("graph_rank"),
    )


def _tokens(task: str) -> list[str]:
    """Query tokens on the driver: a task is one short text."""
    import re

    spaced = re.sub(T.ACRONYM, r"\1 \2", re.sub(T.CAMEL, r"\1 \2", task))
    found = [t.lower() for t in re.sub(T.NON_ALNUM, " ", spaced).split()]
    return [t for t in found if len(t) > 1 and t not in T.STOP_WORDS]


def rank_order() -> list[Column]:
    """The ten sort keys of candidates; full-text positions count within their own tier alone."""
    return [
        F.col("precedence"), F.col("penalty_rank"),
        F.when(F.col("precedence") == 3, F.coalesce("fts_position", F.lit(MAX_CANDIDATES))).otherwise(0),
        F.col("scope_rank"), F.col("graph_rank"), F.desc("score"),
        F.when(F.col("id").startswith("symbol::"), 0).otherwise(1), F.lower("path"), F.col("start_line"), F.col("id"),
    ]


def deduplicated(rows: DataFrame) -> DataFrame:
    """Of ranked rows with the same content at the same place, the first; rows carry `rank`."""
    keys = [F.coalesce(F.nullif(F.col("source_hash"), F.lit("")), F.col("id")), "path", "start_line", "end_line"]
    first = F.row_number().over(W.partitionBy(*keys).orderBy("rank"))
    return rows.withColumn("_f", first).where("_f = 1").drop("_f")


def confidence_and_margin(top: Column, second: Column, exact: Column) -> tuple[Column, Column]:
    top, second = F.greatest(F.coalesce(top, F.lit(0.0)), F.lit(0.0)), F.greatest(F.coalesce(second, F.lit(0.0)), F.lit(0.0))
    sure = F.bround(F.least(F.lit(1.0), top / F.greatest(top + second, F.lit(1.0))), 4)
    apart = F.bround(F.greatest(F.lit(0.0), (top - second) / F.greatest(top, F.lit(1.0))), 4)
    return (
        F.when(exact, 1.0).when(top <= 0, 0.0).otherwise(sure),
        F.when(exact, 1.0).when(top <= 0, 0.0).otherwise(apart),
    )


def one_hop(edges: DataFrame, target: str, intent: str, limit: int = MAX_RELATIONSHIPS, base: float = 0.0) -> DataFrame:
    """(id, role, position, score) of a target's neighbours, in order of relation and ends."""
    order = F.lit(len(RELATION_ORDER))
    for k, relation in reversed(list(enumerate(RELATION_ORDER))):
        order = F.when(F.col("relation") == relation, k).otherwise(order)
    near = edges.where((F.col("source") == target) | (F.col("target") == target)).where("source <> target")
    near = near.withColumn("_o", order).orderBy("_o", "source", "target").limit(limit)
    outgoing = F.col("source") == target
    # At most `limit` rows from here on, so one ordered partition is bounded.
    at = F.row_number().over(W.orderBy("_o", "source", "target"))
    rows = near.select(
        F.when(outgoing, F.col("target")).otherwise(F.col("source")).alias("id"),
        T.role_of(F.col("relation"), outgoing).alias("role"), at.alias("at"),
    )
    rank = F.when(F.col("role") == "test", -1).otherwise(T.role_rank(F.col("role"), intent))
    best = rows.groupBy("id").agg(F.min("at").alias("at"), F.min_by("role", F.struct(rank, "at")).alias("role"))
    position = (F.row_number().over(W.orderBy("at")) - 1).alias("position")
    bonus = F.when(F.col("role") == "test", ROLE_BONUS["test"] + (4.0 if intent == "debug" else 0.0))
    bonus = bonus.when(F.col("role") == "dependency", ROLE_BONUS["dependency"]).when(F.col("role") == "caller", ROLE_BONUS["caller"])
    placed = best.select("id", "role", position, bonus.otherwise(4.0).alias("bonus"))
    return placed.select(
        "id", "role", "position", F.round(F.lit(base) - 10.0 + F.col("bonus") - F.col("position") * 0.01, 4).alias("score")
    )


def inferred_edges(occurrences: DataFrame, symbols: DataFrame, limit: int = 48) -> DataFrame:
    """(source, target, relation, confidence) for unresolved references with one candidate only."""
    lone = occurrences.where("target IS NULL AND size(candidates) = 1").select(
        "source", F.get("candidates", F.lit(0)).alias("target"), "relation"
    )
    ids = symbols.select(F.col("id").alias("_s"))
    known = lone.join(ids, lone["target"] == ids["_s"], "left_semi").where("source <> target").distinct()
    return known.orderBy("source", "target", "relation").limit(limit).withColumn("confidence", F.lit(0.65))


def pack_greedily(rows: DataFrame, group: str, order: list[str], size: str, budget: int, limit: int = MAX_SLICES) -> DataFrame:
    """(group, kept, used): fills a budget in order with at most `limit` rows, skipping what does not
    fit; groups of which nothing fits are there with nothing kept.

    Of rows of one size the fold can keep the first ones only, since room never grows: so the first
    min(limit, budget / size) of each size stand for the group, whatever its length, and the fold's
    array is bounded. The last column of `order` names the kept rows."""
    sized = rows.withColumn("_size", F.col(size).cast("bigint"))
    rank = F.row_number().over(W.partitionBy(group, "_size").orderBy(*order))
    fitting = sized.where(F.col("_size") <= budget).withColumn("_k", rank).where(F.col("_k") <= limit)
    fitting = fitting.where(F.col("_k") * F.col("_size") <= budget)
    listed = fitting.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(*order, F.col("_size").alias("_size")))).alias("xs"))
    id_ = order[-1]
    none = F.array().cast("array<bigint>")
    folded = F.aggregate(
        "xs", F.struct(F.lit(0).cast("bigint").alias("used"), none.alias("kept")),
        lambda acc, x: F.when(
            (acc["used"] + x["_size"] <= budget) & (F.size(acc["kept"]) < limit),
            F.struct((acc["used"] + x["_size"]).alias("used"), F.concat(acc["kept"], F.array(x[id_].cast("bigint"))).alias("kept")),
        ).otherwise(acc),
    )
    every = rows.select(F.col(group).alias("_g")).distinct()
    out = listed.select(F.col(group).alias("_h"), folded.alias("f"))
    return every.join(out, F.col("_g").eqNullSafe(F.col("_h")), "left").select(
        F.col("_g").alias(group), F.coalesce("f.kept", none).alias("kept"), F.coalesce("f.used", F.lit(0)).cast("bigint").alias("used")
    )


def select_roles(rows: DataFrame, order: list[str], role_take: dict[str, int], limit: int) -> DataFrame:
    """Rows by requested role, each role's first few; the target always comes first."""
    take = F.when(F.col("role") == "target", F.lit(1))
    place = F.when(F.col("role") == "target", F.lit(0))
    for k, (role, n) in enumerate(role_take.items(), 1):
        take = take.when(F.col("role") == role, F.lit(n))
        place = place.when(F.col("role") == role, F.lit(k))
    in_role = F.row_number().over(W.partitionBy("role").orderBy(*order))
    kept = rows.withColumn("_n", in_role).withColumn("_p", place).where(F.col("_n") <= F.coalesce(take, F.lit(0)))
    return kept.orderBy("_p", "_n").limit(limit).drop("_n", "_p")


@dataclass(frozen=True)
class Caps:
    candidates: int
    slices: int
    relationships: int


def band(files: int, symbols: int) -> int:
    return 0 if files <= 100 and symbols <= 1000 else 1 if files <= 1000 and symbols <= 20_000 else 2


def caps_columns(tokens: Column, intent: Column, mode: Column, budget: Column, band_: Column, exact: Column) -> dict[str, Column]:
    """The three limits of a request as columns, for whole tables of requests."""
    terms = F.size(F.array_intersect(F.array_distinct(tokens), T.words(*T.CONTEXT_WORDS)))
    room = F.greatest(F.lit(1), F.least(F.lit(4), F.floor(budget / 800).cast("int")))
    impact = (mode == "impact") | intent.isin("debug", "review", "edit", "test-impact")
    pick = lambda a, b, c: F.when(mode == "structural", a).when(impact, b).otherwise(c)
    extra = pick(2, 1, 0)
    has = lambda w: F.array_contains(tokens, w)
    base = pick(4, 3, 1) + F.when(terms >= 2, F.least(F.lit(2), terms - 1)).otherwise(0)
    base = base + F.when(has("dependencies") & (mode == "impact"), 1).otherwise(0)
    base = base + F.when(has("dependencies") & has("callers") & (mode == "impact"), 1).otherwise(0)
    base = F.when((intent == "debug") & (mode == "impact"), F.greatest(base, F.lit(5))).otherwise(base)
    slices = F.when(exact & (mode == "lexical"), 1).otherwise(F.least(F.lit(MAX_SLICES), F.greatest(base, room + extra)))
    candidates = (
        F.when(exact, 16).otherwise(32) + band_ * 24 + terms * 8 + extra * 16 + (room - 1) * 8
        + F.when(mode == "structural", 24).otherwise(0)
    )
    more = F.when(terms >= 2, 8).when((terms == 1) & (mode != "lexical"), 4).otherwise(0)
    relations = pick(40, 24, 8) + more + band_ * 16 + (room - 1) * 8
    return {
        "candidate_limit": F.least(F.lit(MAX_CANDIDATES), candidates).cast("int"),
        "slice_limit": slices.cast("int"),
        "relationship_limit": F.least(F.lit(MAX_RELATIONSHIPS), relations).cast("int"),
    }


def tokens_needed(response: dict) -> int:
    """Estimated tokens of a response, written out."""
    return max(1, -(-len(json.dumps(response, indent=2, ensure_ascii=False)) // 3))


def fits(response: dict, budget: int) -> bool:
    """Whether a response, written out, stays within its budget of estimated tokens."""
    return tokens_needed(response) <= budget


def shrink(response: dict, budget: int) -> dict:
    """Drops parts of a response until it fits: diagnostics, warnings, slices from the end, the
    suggestion, what is missing."""
    out = {k: v for k, v in response.items() if v not in (None, [], {}, "")}
    for part in ("diagnostics", "warnings"):
        if not fits(out, budget):
            out.pop(part, None)
    while not fits(out, budget) and out.get("slices"):
        out["slices"] = out["slices"][:-1]
    for part in ("next", "missing", "candidates"):
        if not fits(out, budget):
            out.pop(part, None)
    return out if fits(out, budget) else {"status": out.get("status", "insufficient")}


#: Words by which a task asks for a role, and the plurals that ask for all of it.
ROLE_TERMS = {
    "test": ("test", "tests", "testing", "coverage", "regression"),
    "caller": ("caller", "callers", "reference", "references", "usage", "used"),
    "dependency": ("dependency", "dependencies", "import", "imports", "flow", "routing"),
}
ROLE_PLURALS = {"test": "tests", "caller": "callers", "dependency": "dependencies"}

#: Words of each intent of an overview, in the order they are tried.
INTENT_KEYWORDS = (
    ("review", ("review", "pr", "merge", "diff", "changes", "changeset")),
    ("debug", ("debug", "bug", "error", "fix", "broken", "failing", "crash", "regression")),
    ("refactor", ("refactor", "rename", "extract", "cleanup", "dead", "unused", "remove")),
    ("explore", ("explore", "understand", "architecture", "overview", "map", "learn", "what is", "how does", "improve", "improvement", "roadmap")),
)
#: What to do next under each intent.
NEXT_STEPS = {
    "review": ("refresh", "context"), "debug": ("context", "graph"), "refactor": ("graph", "path"),
    "explore": ("graph", "context"), "general": ("context",),
}


def overview_intent(task: Column) -> Column:
    """The intent of an overview's task by whole words; the first that has any wins."""
    out = F.lit("general")
    for intent, keywords in reversed(INTENT_KEYWORDS):
        pattern = r"\b(?:" + "|".join(k.replace(" ", r"\s") for k in keywords) + r")\b"
        out = F.when(F.lower(F.coalesce(task, F.lit(""))).rlike(pattern), intent).otherwise(out)
    return out


def mentions_role(tokens: list[str]) -> bool:
    """Whether a task asks for what surrounds its target."""
    return any(set(terms) & set(tokens) for terms in ROLE_TERMS.values())


def requested_roles(tokens: list[str], intent: str) -> list[str]:
    """Roles in the order in which a task mentions them; without any, all three, except to debug."""
    first = {role: min((k for k, t in enumerate(tokens) if t in terms), default=None) for role, terms in ROLE_TERMS.items()}
    order = sorted((at, role) for role, at in first.items() if at is not None)
    roles = [role for _, role in order]
    if intent == "debug" and "test" in tokens and not {"tests", "coverage", "regression"} & set(tokens):
        roles = [r for r in roles if r != "test"]
    return roles or ([] if intent == "debug" else ["dependency", "caller", "test"])


def select_context(ranked: list[tuple[str, str]], tokens: list[str], intent: str, limit: int) -> list[tuple[str, str]]:
    """Which of the ranked (id, role) rows, the target among them, a context shows.

    The target; then the roles asked for, one row each or all where a plural asks for them; an edit
    keeps room for two tests; what is left goes to other roles if nothing asked for was there, or to
    debug. The rows are at most MAX_CANDIDATES, so this is driver work."""
    waiting = {role: [r for r in ranked if r[1] == role] for role in ROLE_TERMS}
    chosen = [r for r in ranked if r[1] == "target"][:1]

    def take(role: str, n: int, upto: int) -> int:
        fresh = [r for r in waiting[role] if r not in chosen][: max(0, min(n, upto - len(chosen)))]
        chosen.extend(fresh)
        return len(fresh)

    roles = requested_roles(tokens, intent)
    kept_back = min(2, len(waiting["test"])) if intent == "edit" and "test" not in roles else 0
    if kept_back:
        roles.sort(key=lambda r: (r != "dependency", r))
    matched = False
    for role in roles:
        every = ROLE_PLURALS[role] in tokens or (intent == "debug" and role == "test")
        matched |= take(role, len(ranked) if every else 1, max(1, limit - kept_back)) > 0
    if kept_back:
        take("test", kept_back, limit)
    if intent == "debug" or not matched:
        rest = ("caller", "test", "dependency") if intent == "debug" and not {"dependency", "dependencies"} & set(tokens) else ("dependency", "caller", "test")
        for role in rest:
            take(role, len(ranked) if intent == "debug" else 1, limit)
    return chosen[:limit]
