"""Retrieval queries: BM25, candidates, ranking, expansion, selection, packing."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import lexical, retrieval
from ..operators.scratch import materialise
from ..sources.driver_tables import G_EDGES, g_edges, g_entities, node, table
from .registry import query
from .text_plans import _INTENT, _MODE, _TASKS, _tasks

_TERMS = ["the", "tion", "of", "token", "the"]


def _bm25_sql(columns: dict[str, float], terms: list[str], source: str, limit: int) -> str:
    """BM25 in SQL over a relation with node_id and these columns."""
    split = lambda c: f"list_filter(string_split(regexp_replace(lower(coalesce({c}, '')), '[^a-z0-9]+', ' ', 'g'), ' '), lambda t: t <> '')"
    every = " UNION ALL ".join(f"SELECT node_id, unnest({split(c)}) AS term, {w}::DOUBLE AS w FROM src" for c, w in columns.items())
    dl = " + ".join(f"len({split(c)})" for c in columns)
    asked = ", ".join(f"('{t}')" for t in terms)
    return f"""WITH src AS ({source}), q AS (SELECT term, count(*) AS times FROM (VALUES {asked}) v(term) GROUP BY term),
p AS (SELECT node_id, term, sum(w) AS tf FROM ({every}) WHERE term IN (SELECT term FROM q) GROUP BY 1, 2),
d AS (SELECT node_id, ({dl})::DOUBLE AS dl FROM src), t AS (SELECT count(*) AS n, avg(dl) AS a FROM d),
i AS (SELECT term, ln((t.n - count(*) + 0.5) / (count(*) + 0.5)) AS raw FROM p, t GROUP BY term, t.n)
SELECT node_id, round(sum(CASE WHEN raw > 0 THEN raw ELSE 1e-6 END * times * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))), 6) AS score, any_value(dl) AS dl
FROM p JOIN i USING (term) JOIN q USING (term) JOIN d USING (node_id), t GROUP BY node_id ORDER BY score DESC, node_id LIMIT {limit}"""


_BODY = "SELECT 'doc::' || doc_id AS node_id, text AS body FROM documents"


@query("bm25_topk", _bm25_sql({"body": 1.0}, _TERMS, _BODY, 25))
def bm25_topk(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(node("doc", "doc_id").alias("node_id"), F.col("text").alias("body"))
    return lexical.top_documents(lexical.bm25(docs, _TERMS, {"body": 1.0}), 25)


@query("bm25_stored_index", _bm25_sql({"body": 1.0}, _TERMS, _BODY, 25))
def bm25_stored_index(spark, sf_dir):
    """The same from postings that are written by term, as a snapshot keeps them."""
    docs = table(spark, sf_dir, "documents").select(node("doc", "doc_id").alias("node_id"), F.col("text").alias("body"))
    stored = materialise(lexical.stored_postings(docs, {"body": 1.0}), "postings")
    dl = materialise(lexical.lengths(docs, ["body"]), "lengths")
    return lexical.top_documents(lexical.ranked(stored, lexical.totals(dl), _TERMS), 25)


_WIDE = """SELECT 'part::' || p_partkey AS node_id, p_name AS name, p_brand AS path, p_type AS signature, '' AS docstring,
  p_type || ' ' || p_name AS summary, p_name || ' ' || p_size AS source FROM part"""


def _wide(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        node("part", "p_partkey").alias("node_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("path"),
        F.col("p_type").alias("signature"), F.lit("").alias("docstring"), F.concat_ws(" ", "p_type", "p_name").alias("summary"),
        F.concat_ws(" ", "p_name", F.col("p_size").cast("string")).alias("source"),
    )


def _part_terms(spark, sf_dir) -> list[str]:
    return ["small", "steel", "brand", "13", "promo", "steel"]


@query("bm25_multicolumn_weights", _bm25_sql(lexical.WEIGHTS, ["small", "steel", "brand", "13", "promo", "steel"], _WIDE, 50))
def bm25_multicolumn_weights(spark, sf_dir):
    return lexical.top_documents(lexical.bm25(_wide(spark, sf_dir), _part_terms(spark, sf_dir)), 50)


@query("exact_name_candidates", """SELECT id FROM (SELECT 'part::' || p_partkey AS id FROM part WHERE lower(p_name) IN (SELECT lower(p_name) FROM part WHERE p_partkey <= 2)) ORDER BY id LIMIT 256""")
def exact_name_candidates(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(node("part", "p_partkey").alias("id"), F.lower("p_name").alias("name"), "p_partkey")
    names = parts.where("p_partkey <= 2").select("name").distinct()
    return parts.join(names, "name", "left_semi").select("id").orderBy("id").limit(256)


_SYMBOLS = "symbols AS (SELECT 'symbol::part/' || p_partkey || '::function::' || replace(p_name, ' ', '.') AS id, replace(p_name, ' ', '.') AS name, 'part/' || p_partkey AS path, CAST(p_size AS INTEGER) AS start_line FROM part)"


def _symbols(spark, sf_dir):
    name = F.replace("p_name", F.lit(" "), F.lit("."))
    path = F.concat(F.lit("part/"), F.col("p_partkey").cast("string"))
    return table(spark, sf_dir, "part").select(
        T.symbol_id(path, F.lit("function"), name).alias("id"), name.alias("name"), path.alias("path"), F.col("p_size").cast("int").alias("start_line"),
    )


_WANTED = ("symbol::part/1::function::nothing", "PART/12", "part/7", "rt/19", "zzz")


def _cascade_sql() -> str:
    cases = """CASE WHEN id = w THEN 0 WHEN lower(name) = lower(w) THEN 1 WHEN ends_with(lower(id), '::' || lower(w)) OR ends_with(lower(id), '.' || lower(w)) THEN 3
      WHEN lower(path) = lower(w) THEN 4 WHEN contains(lower(name), lower(w)) OR contains(lower(path), lower(w)) THEN 5 END"""
    wanted = ", ".join(f"('{w}')" for w in _WANTED)
    return f"""WITH {_SYMBOLS}, s AS (SELECT w AS wanted, id, name, path, start_line, {cases} AS stage FROM symbols, (VALUES {wanted}) v(w)),
r AS (SELECT *, row_number() OVER (PARTITION BY wanted ORDER BY stage, CASE WHEN stage = 5 THEN length(name) ELSE 0 END, path, start_line, id) AS k, min(stage) OVER (PARTITION BY wanted) AS least FROM s WHERE stage IS NOT NULL)
SELECT wanted, id, CAST(stage AS INTEGER) AS stage FROM r WHERE k <= 9 AND stage = least"""


@query("target_cascade_stage", _cascade_sql())
def target_cascade_stage(spark, sf_dir):
    symbols, out = _symbols(spark, sf_dir), None
    for wanted in _WANTED:
        one = retrieval.target_cascade(symbols, wanted).select(F.lit(wanted).alias("wanted"), "id", "stage")
        out = one if out is None else out.unionByName(one)
    return out


_TASK = "fix the small steel part named promo in part/12"
_CAND = """cand AS (SELECT 'symbol::part/' || p_partkey AS id, p_name AS name, CASE WHEN p_partkey % 11 = 0 THEN 'vendor/' ELSE '' END || 'part/' || p_partkey AS path,
  CAST(p_size AS INTEGER) AS start_line, p_partkey % 7 = 0 AS is_test, CASE WHEN p_partkey <= 3 THEN p_partkey - 1 END AS target_position,
  CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 32 END AS fts_position, p_partkey % 13 = 0 AS exact_name,
  CASE WHEN p_size < 10 THEN 0 WHEN p_size < 20 THEN 1 END AS scope, p_partkey % 2 = 0 AS graph_near FROM part)"""


def _candidates(spark, sf_dir):
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("symbol::part/"), k.cast("string")).alias("id"), F.col("p_name").alias("name"),
        F.concat(F.when(k % 11 == 0, "vendor/").otherwise(""), F.lit("part/"), k.cast("string")).alias("path"),
        F.col("p_size").cast("int").alias("start_line"), (k % 7 == 0).alias("is_test"),
        F.when(k <= 3, k - 1).alias("target_position"), F.lit(False).alias("target_exact"),
        F.when(k % 3 == 0, k % 32).alias("fts_position"), (k % 13 == 0).alias("exact_name"),
        F.when(F.col("p_size") < 10, 0).when(F.col("p_size") < 20, 1).alias("scope"), (k % 2 == 0).alias("graph_near"),
    )


def _score_sql(tail: str) -> str:
    from .text_plans import tokens_sql

    tokens = retrieval._tokens(_TASK)
    overlap = f"len(list_intersect(list_distinct({tokens_sql('lower(name) || chr(32) || lower(path)')}), [{', '.join(repr(t) for t in tokens)}]))"
    return f"""WITH {_CAND}, a AS (SELECT *, CASE WHEN target_position IS NOT NULL THEN 1 WHEN exact_name THEN 2 WHEN fts_position IS NOT NULL THEN 3 ELSE 9 END AS precedence,
  starts_with(path, 'vendor/') AS vendor FROM cand), b AS (SELECT *, CAST((is_test OR vendor) AS INTEGER) AS penalty_rank, CAST(coalesce(scope, 2) AS INTEGER) AS scope_rank,
  CASE WHEN graph_near THEN 0 ELSE 1 END AS graph_rank,
  greatest(coalesce(100.0::DOUBLE - target_position, 0), coalesce(30.0::DOUBLE - fts_position / 32.0::DOUBLE * 10, 0), CASE WHEN exact_name THEN 60 ELSE 0 END)
  + CASE WHEN contains('{_TASK}', lower(name)) THEN 20 ELSE 0 END + CASE WHEN contains('{_TASK}', lower(path)) THEN 15 ELSE 0 END + 2 * {overlap}
  + CASE scope WHEN 0 THEN 18 WHEN 1 THEN 12 ELSE 0 END + CASE WHEN graph_near THEN 6 ELSE 0 END - CASE WHEN is_test THEN 24 ELSE 0 END - CASE WHEN vendor THEN 20 ELSE 0 END AS score FROM a)
SELECT {tail}"""


@query("candidate_scoring", _score_sql("id, CAST(precedence AS INTEGER) AS precedence, penalty_rank, round(score, 6) AS score FROM b"))
def candidate_scoring(spark, sf_dir):
    rows = retrieval.score_candidates(_candidates(spark, sf_dir), _TASK, fts_count=32)
    return rows.select("id", "precedence", "penalty_rank", F.round("score", 6).alias("score"))


@query("candidate_rank10", _score_sql("""id, CAST(row_number() OVER (ORDER BY precedence, penalty_rank, CASE WHEN precedence = 3 THEN fts_position ELSE 0 END, scope_rank, graph_rank, score DESC, lower(path), start_line, id) AS INTEGER) AS rank
FROM b ORDER BY rank LIMIT 256"""))
def candidate_rank10(spark, sf_dir):
    rows = retrieval.score_candidates(_candidates(spark, sf_dir), _TASK, fts_count=32)
    top = rows.orderBy(*retrieval.rank_order()).limit(retrieval.MAX_CANDIDATES)
    return top.select("id", F.row_number().over(W.orderBy(*retrieval.rank_order())).alias("rank"))  # at most 256 rows


@query("confidence_margin", """WITH r AS (SELECT lang, n_chars::DOUBLE / 1000 AS s, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS k FROM documents),
t AS (SELECT lang, max(s) FILTER (k = 1) AS a, coalesce(max(s) FILTER (k = 2), 0) AS b FROM r GROUP BY lang)
SELECT lang, round_even(least(1, a / greatest(a + b, 1)), 4) AS confidence, round_even(greatest(0, (a - b) / greatest(a, 1)), 4) AS margin FROM t""")
def confidence_margin(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("lang", (F.col("n_chars").cast("double") / 1000).alias("s"), "n_chars", "doc_id")
    # Best and second best by two combining aggregates, no window over a whole language.
    best = docs.groupBy("lang").agg(F.max_by("doc_id", F.struct("n_chars", -F.col("doc_id"))).alias("first"))
    rest = docs.join(best, "lang").groupBy("lang").agg(
        F.max(F.when(F.col("doc_id") == F.col("first"), F.col("s"))).alias("a"), F.max(F.when(F.col("doc_id") != F.col("first"), F.col("s"))).alias("b")
    )
    sure, apart = retrieval.confidence_and_margin(F.col("a"), F.col("b"), F.lit(False))
    return rest.select("lang", sure.alias("confidence"), apart.alias("margin"))


@query("dedup_ranked_rows", "SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY sha256(text), source")
def dedup_ranked_rows(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.col("doc_id").cast("string").alias("id"), F.sha2("text", 256).alias("source_hash"), F.col("source").alias("path"),
        F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), F.col("doc_id").alias("rank"),
    )
    keys = ["source_hash", "path"]
    copies = docs.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"))
    return retrieval.deduplicated(docs).join(copies, keys).select("doc_id", "copies")


def _hop_sql(target: str, intent_rank: str, limit: int) -> str:
    return f"""WITH {G_EDGES}, n AS (SELECT *, CASE relation WHEN 'calls' THEN 0 WHEN 'tested_by' THEN 1 WHEN 'inherits' THEN 2 WHEN 'imports' THEN 3 ELSE 4 END AS o FROM (
  SELECT source, target, CASE relation WHEN 'supplies' THEN 'calls' WHEN 'contains' THEN 'tested_by' ELSE 'imports' END AS relation FROM g_edges)
  WHERE (source = '{target}' OR target = '{target}') ORDER BY o, source, target LIMIT {limit}),
r AS (SELECT CASE WHEN source = '{target}' THEN target ELSE source END AS id, CASE WHEN relation = 'tested_by' THEN 'test' WHEN source = '{target}' THEN 'dependency' ELSE 'caller' END AS role,
  row_number() OVER (ORDER BY o, source, target) AS pos FROM n),
b AS (SELECT id, min(pos) AS pos, arg_min(role, {intent_rank}) AS role FROM r GROUP BY id)
SELECT id, role, CAST(row_number() OVER (ORDER BY pos) - 1 AS INTEGER) AS position,
  round(-10 + CASE role WHEN 'test' THEN 8 WHEN 'dependency' THEN 7 WHEN 'caller' THEN 6 ELSE 4 END - (row_number() OVER (ORDER BY pos) - 1) * 0.01::DOUBLE, 4) AS score FROM b"""


@query("one_hop_roles", _hop_sql("part::5", "CASE role WHEN 'test' THEN -1 WHEN 'dependency' THEN 1 WHEN 'caller' THEN 3 ELSE 4 END", 128))
def one_hop_roles(spark, sf_dir):
    relation = F.when(F.col("relation") == "supplies", "calls").when(F.col("relation") == "contains", "tested_by").otherwise("imports")
    edges = g_edges(spark, sf_dir).select("source", "target", relation.alias("relation"))
    return retrieval.one_hop(edges, "part::5", "edit")


@query("inferred_unique_candidates", """WITH o AS (SELECT 'supplier::' || s_suppkey AS source, list_sort(list(DISTINCT 'part::' || p_partkey)) AS c
  FROM supplier JOIN part ON p_partkey = s_suppkey * 7 AND p_size > 30 GROUP BY s_suppkey)
SELECT source, c[1] AS target, 'calls' AS relation, 0.65::DOUBLE AS confidence FROM o WHERE len(c) = 1 ORDER BY 1, 2, 3 LIMIT 48""")
def inferred_unique_candidates(spark, sf_dir):
    parts = table(spark, sf_dir, "part").where("p_size > 30").withColumn("m", F.col("p_partkey"))
    suppliers = table(spark, sf_dir, "supplier").withColumn("m", F.col("s_suppkey") * 7)
    occurrences = parts.join(suppliers, "m").groupBy(node("supplier", "s_suppkey").alias("source")).agg(
        F.array_sort(F.collect_set(node("part", "p_partkey"))).alias("candidates")
    ).select("source", F.lit(None).cast("string").alias("target"), F.lit("calls").alias("relation"), "candidates")
    return retrieval.inferred_edges(occurrences, g_entities(spark, sf_dir))


@query("scope_files_imports", """WITH scope AS (SELECT page_id FROM pages WHERE page_id % 10 = 3)
SELECT DISTINCT (page_id * 3) % (SELECT count(*) FROM pages) AS imported FROM scope""")
def scope_files_imports(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id")
    n = pages.count()
    imports = pages.select("page_id", ((F.col("page_id") * 3) % n).alias("imported"))
    scope = pages.where("page_id % 10 = 3")
    return imports.join(scope, "page_id", "left_semi").select("imported").distinct()


@query("role_selection", f"""WITH {G_EDGES}, r AS (SELECT source AS id, CASE relation WHEN 'contains' THEN 'test' WHEN 'supplies' THEN 'caller' END AS role FROM g_edges WHERE target = 'part::9'
  UNION ALL SELECT 'part::9', 'target'), k AS (SELECT id, role, row_number() OVER (PARTITION BY role ORDER BY id) AS n FROM r)
SELECT id, role FROM k WHERE (role = 'target' AND n <= 1) OR (role = 'caller' AND n <= 4) OR (role = 'test' AND n <= 2)""")
def role_selection(spark, sf_dir):
    edges = g_edges(spark, sf_dir).where("target = 'part::9'")
    role = F.when(F.col("relation") == "contains", "test").when(F.col("relation") == "supplies", "caller")
    rows = edges.select(F.col("source").alias("id"), role.alias("role")).unionByName(
        spark.createDataFrame([("part::9", "target")], "id string, role string")
    )
    return retrieval.select_roles(rows, ["id"], {"caller": 4, "test": 2}, retrieval.MAX_SLICES)


@query("budget_packing_greedy", """WITH RECURSIVE o AS (SELECT source, doc_id, greatest(1, CAST(ceil(length(text) / 3.0) AS BIGINT)) AS size, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents),
f(source, k, used, kept, n) AS (
  SELECT source, 0::BIGINT, 0::BIGINT, ''::VARCHAR, 0 FROM (SELECT DISTINCT source FROM o)
  UNION ALL SELECT f.source, o.k, CASE WHEN f.used + o.size <= 2000 AND n < 16 THEN f.used + o.size ELSE f.used END,
    CASE WHEN f.used + o.size <= 2000 AND n < 16 THEN f.kept || ',' || o.doc_id ELSE f.kept END, CASE WHEN f.used + o.size <= 2000 AND n < 16 THEN n + 1 ELSE n END
  FROM f JOIN o ON o.source = f.source AND o.k = f.k + 1)
SELECT source, ltrim(arg_max(kept, k), ',') AS kept, CAST(arg_max(used, k) AS BIGINT) AS used FROM f GROUP BY source""")
def budget_packing_greedy(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", T.token_estimate(F.col("text")).alias("size"))
    return retrieval.pack_greedily(docs, "source", ["doc_id"], "size", 2000).withColumn("kept", F.array_join("kept", ","))


_TERMS_IN = "[" + ", ".join(f"'{w}'" for w in T.CONTEXT_WORDS) + "]"


@query("caps_by_band", f"""WITH {_TASKS}, i AS (SELECT *, {_INTENT} AS intent FROM tok), m AS (SELECT *, {_MODE} AS mode,
  len(list_intersect(list_distinct(t), {_TERMS_IN})) AS terms, least(4, greatest(1, (256 + conv_id % 4000) // 800)) AS room, conv_id % 3 AS band, conv_id % 2 = 0 AS exact FROM i),
x AS (SELECT *, CASE WHEN mode = 'structural' THEN 2 WHEN mode = 'impact' THEN 1 ELSE 0 END AS extra, CASE WHEN mode = 'structural' THEN 4 WHEN mode = 'impact' THEN 3 ELSE 1 END + CASE WHEN terms >= 2 THEN least(2, terms - 1) ELSE 0 END
  + CASE WHEN mode = 'impact' AND list_contains(t, 'dependencies') THEN 1 ELSE 0 END + CASE WHEN mode = 'impact' AND list_contains(t, 'dependencies') AND list_contains(t, 'callers') THEN 1 ELSE 0 END AS base FROM m)
SELECT conv_id, turn, CAST(least(256, CASE WHEN exact THEN 16 ELSE 32 END + band * 24 + terms * 8 + extra * 16 + (room - 1) * 8 + CASE WHEN mode = 'structural' THEN 24 ELSE 0 END) AS INTEGER) AS candidate_limit,
  CAST(CASE WHEN exact AND mode = 'lexical' THEN 1 ELSE least(16, greatest(CASE WHEN intent = 'debug' THEN greatest(base, 5) ELSE base END, room + extra)) END AS INTEGER) AS slice_limit,
  CAST(least(128, CASE WHEN mode = 'structural' THEN 40 WHEN mode = 'impact' THEN 24 ELSE 8 END + CASE WHEN terms >= 2 THEN 8 WHEN terms = 1 AND mode <> 'lexical' THEN 4 ELSE 0 END + band * 16 + (room - 1) * 8) AS INTEGER) AS relationship_limit FROM x""")
def caps_by_band(spark, sf_dir):
    rows = _tasks(spark, sf_dir).withColumn("intent", T.infer_intent(F.col("t")))
    rows = rows.withColumn("mode", T.plan_mode(F.col("t"), F.col("intent")))
    caps = retrieval.caps_columns(
        F.col("t"), F.col("intent"), F.col("mode"), F.lit(256) + F.col("conv_id") % 4000, F.col("conv_id") % 3, F.col("conv_id") % 2 == 0
    )
    return rows.select("conv_id", "turn", *[c.alias(k) for k, c in caps.items()])


@query("line_window_search_rank", """WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS line, unnest(string_split(text, chr(10))) AS content FROM documents)
SELECT doc_id, CAST(line AS INTEGER) AS line, CAST(score AS INTEGER) AS score FROM (SELECT doc_id, line, 4 * (contains(lower(content), 'license')::INT + contains(lower(content), 'token')::INT + contains(lower(content), 'public')::INT) AS score FROM l)
WHERE score > 0 ORDER BY score DESC, doc_id, line LIMIT 40""")
def line_window_search_rank(spark, sf_dir):
    return lexical.line_search(table(spark, sf_dir, "documents"), ["license", "token", "public"], 40)


@query("lexical_postings", """WITH t AS (SELECT doc_id, unnest(list_filter(string_split(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' '), lambda t: t <> '')) AS term FROM documents)
SELECT term, count(DISTINCT doc_id) AS documents, count(*) AS n FROM t GROUP BY term""")
def lexical_postings(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = lexical.postings(docs, {"text": 1.0}, "doc_id")
    return rows.groupBy("term").agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("n"))


