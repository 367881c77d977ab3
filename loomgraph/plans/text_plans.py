"""Scalar functions over documents, parts, events and page addresses."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.driver_tables import table
from .registry import query

_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


def tokens_sql(column: str) -> str:
    spaced = f"regexp_replace(regexp_replace({column}, '{T.CAMEL}', '\\1 \\2', 'g'), '{T.ACRONYM}', '\\1 \\2', 'g')"
    return (
        f"list_filter(string_split(lower(regexp_replace({spaced}, '{T.NON_ALNUM}', ' ', 'g')), ' '), "
        f"lambda t: length(t) > 1 AND t NOT IN ({_STOP}))"
    )


def in_list(column: str, values: tuple[str, ...]) -> str:
    return f"list_has_any({column}, [{', '.join(repr(v) for v in values)}])"


_NAMES = """names AS (
  SELECT p_partkey AS k, 'getHTTPResponse' || replace(p_name, ' ', 'For') || '_' || p_brand AS ident FROM part
)"""


def _names(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("k"),
        F.concat(F.lit("getHTTPResponse"), F.replace("p_name", F.lit(" "), F.lit("For")), F.lit("_"), "p_brand").alias("ident"),
    )


@query("tokenize_identifiers", f"WITH {_NAMES} SELECT k, array_to_string({tokens_sql('ident')}, ' ') AS tokens FROM names")
def tokenize_identifiers(spark, sf_dir):
    return _names(spark, sf_dir).select("k", F.array_join(T.identifier_tokens(F.col("ident")), " ").alias("tokens"))


@query("token_counts", f"""SELECT token, count(*) AS n FROM (SELECT unnest({tokens_sql('text')}) AS token FROM documents) GROUP BY token""")
def token_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.explode(T.identifier_tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query("sha256_dedup_first_wins", "SELECT min(doc_id) AS doc_id, sha256(text) AS digest FROM documents GROUP BY sha256(text)")
def sha256_dedup_first_wins(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    return docs.groupBy("digest").agg(F.min("doc_id").alias("doc_id"))


@query("id_build_and_short_name", """SELECT 'file::parts/' || p_partkey AS file_id,
  'symbol::parts/' || p_partkey || '::function::' || replace(p_name, ' ', '.') AS symbol_id,
  list_extract(string_split(p_name, ' '), -1) AS short_name, list_extract(string_split('a/' || p_type, '/'), -1) AS terminal FROM part""")
def id_build_and_short_name(spark, sf_dir):
    path = F.concat(F.lit("parts/"), F.col("p_partkey").cast("string"))
    name = F.replace("p_name", F.lit(" "), F.lit("."))
    return table(spark, sf_dir, "part").select(
        T.file_id(path).alias("file_id"),
        T.symbol_id(path, F.lit("function"), name).alias("symbol_id"),
        T.short_name(name).alias("short_name"),
        T.import_terminal(F.concat(F.lit("a/"), "p_type")).alias("terminal"),
    )


@query("regex_identifiers", """SELECT page_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(
  regexp_extract_all(url, '[A-Za-z_][A-Za-z0-9_.]*'), lambda x: lower(x)), lambda x: length(x) > 2))), ' ') AS names FROM pages""")
def regex_identifiers(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(T.task_identifiers(F.col("url")), " ").alias("names"))


_MENTION = r"[A-Za-z0-9_./-]+\.(?:py|ts|tsx|js|jsx|mjs|cjs)"


@query("path_mentions", f"""WITH t AS (SELECT page_id, 'see ./src/page' || page_id || '.py and lib/u' || page_id % 7 || '.ts then ./src/page' || page_id || '.py' AS task FROM pages)
SELECT page_id, array_to_string(list_distinct(list_transform(regexp_extract_all(task, '{_MENTION}'), lambda x: ltrim(x, './')))[1:16], ' ') AS paths,
  len(list_distinct(regexp_extract_all(task, '{_MENTION}'))) AS n FROM t""".replace("array_to_string(list_distinct(", "array_to_string(list_sort(list_distinct(").replace("ltrim(x, './')))[1:16]", "ltrim(x, './'))))[1:16]"))
def path_mentions(spark, sf_dir):
    n = F.col("page_id").cast("string")
    task = F.concat(F.lit("see ./src/page"), n, F.lit(".py and lib/u"), (F.col("page_id") % 7).cast("string"), F.lit(".ts then ./src/page"), n, F.lit(".py"))
    found = F.regexp_extract_all(task, F.lit(_MENTION), F.lit(0))
    plain = F.array_distinct(F.transform(found, lambda x: F.ltrim(x, F.lit("./"))))
    return table(spark, sf_dir, "pages").select(
        "page_id", F.array_join(F.array_sort(F.slice(plain, 1, 16)), " ").alias("paths"),
        F.size(F.array_distinct(found)).cast("bigint").alias("n"),
    )


@query("json_list_parse", """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
  CASE WHEN event_id % 3 = 0 THEN event_type || ',' || 'k' WHEN event_id % 3 = 1 THEN '' ELSE '' END AS items FROM events""")
def json_list_parse(spark, sf_dir):
    kind = F.col("event_id") % 3
    listed = F.concat(F.lit('["'), "event_type", F.lit('","k","'), "event_type", F.lit('"]'))
    value = F.when(kind == 0, listed).when(kind == 1, F.col("props")).otherwise(F.lit("no json"))
    return table(spark, sf_dir, "events").select(
        "event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"),
        F.array_join(T.json_strings(value), ",").alias("items"),
    )


@query("token_estimate", "SELECT doc_id, CAST(greatest(1, ceil(length(text) / 3.0)) AS BIGINT) AS tokens FROM documents")
def token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


@query("epoch_iso", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso FROM events")
def epoch_iso(spark, sf_dir):
    seconds = F.unix_timestamp(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select("event_id", T.epoch_iso(seconds).alias("iso"))


@query("python_module_resolve", """SELECT page_id, 'pkg.m' || page_id % 5 || '.sub' AS module,
  CASE page_id % 4 WHEN 0 THEN 'pkg.m' || page_id % 5 || '.x' WHEN 1 THEN 'pkg.y' WHEN 2 THEN 'os.path' ELSE 'pkg.m' || page_id % 5 END AS target FROM pages""")
def python_module_resolve(spark, sf_dir):
    path = F.concat(F.lit("pkg/m"), (F.col("page_id") % 5).cast("string"), F.lit("/sub.py"))
    name = F.element_at(T.words(".x", "..y", "os.path", "."), (F.col("page_id") % 4 + 1).cast("int"))
    module = T.python_module(path)
    return table(spark, sf_dir, "pages").select("page_id", module.alias("module"), T.resolve_dotted(name, module).alias("target"))


@query("script_module_resolve", """SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'src.a' || page_id WHEN 1 THEN 'src' ELSE 'tests.a.test' END AS module,
  CASE page_id % 3 WHEN 0 THEN 'lib.b' WHEN 1 THEN 'lib.b' ELSE 'lib.b' END AS target FROM pages""")
def script_module_resolve(spark, sf_dir):
    kind = F.col("page_id") % 3
    path = F.when(kind == 0, F.concat(F.lit("src/a"), F.col("page_id").cast("string"), F.lit(".ts"))).when(kind == 1, F.lit("src/index.js")).otherwise(F.lit("tests/a.test.ts"))
    name = F.when(kind == 1, F.lit("./lib/b")).otherwise(F.lit("../lib/b"))
    module = T.script_module(path)
    return table(spark, sf_dir, "pages").select("page_id", module.alias("module"), T.resolve_relative(name, module).alias("target"))


_PATHS = """paths AS (SELECT page_id, regexp_replace(url, '^[a-z]+://[^/]*/?', '') AS plain,
  CASE page_id % 6 WHEN 0 THEN 'tests/' WHEN 1 THEN 'src/vendor/' WHEN 2 THEN 'src/__tests__/' WHEN 3 THEN 'Build/' ELSE 'src/' END
  || 'page' || page_id || CASE page_id % 5 WHEN 0 THEN '.test.ts' WHEN 1 THEN '_test.py' WHEN 2 THEN '.min.js' WHEN 3 THEN '.generated.ts' ELSE '.py' END AS path FROM pages)"""


def _paths(spark, sf_dir):
    six, five = F.col("page_id") % 6, F.col("page_id") % 5
    start = F.when(six == 0, "tests/").when(six == 1, "src/vendor/").when(six == 2, "src/__tests__/").when(six == 3, "Build/").otherwise("src/")
    end = F.when(five == 0, ".test.ts").when(five == 1, "_test.py").when(five == 2, ".min.js").when(five == 3, ".generated.ts").otherwise(".py")
    return table(spark, sf_dir, "pages").select("page_id", F.concat(start, F.lit("page"), F.col("page_id").cast("string"), end).alias("path"))


@query("generated_path_filter", f"""WITH {_PATHS} SELECT page_id, path FROM paths WHERE
  list_has_any(string_split(lower(path), '/'), [{', '.join(repr(p) for p in T.GENERATED_PARTS)}])
  OR path LIKE '%.generated.%' OR path LIKE '%.min.js' OR path LIKE '%.g.py' OR path LIKE '%.g.ts'""")
def generated_path_filter(spark, sf_dir):
    return _paths(spark, sf_dir).where(T.is_generated_path(F.col("path")))


@query("test_path_filter", f"""WITH {_PATHS} SELECT page_id, path FROM paths WHERE regexp_matches(path, '^(tests|test|__tests__)/')
  OR path LIKE '%/\\_\\_tests\\_\\_/%' ESCAPE '\\' OR regexp_matches(path, '(_test|\\.test|\\.spec)\\.[^.]*$')""")
def test_path_filter(spark, sf_dir):
    return _paths(spark, sf_dir).where(T.is_test_path(F.col("path")))


@query("include_root_filter", f"WITH {_PATHS} SELECT page_id, path FROM paths WHERE path LIKE 'src/vendor/%' OR path LIKE 'tests/%'")
def include_root_filter(spark, sf_dir):
    return _paths(spark, sf_dir).where(T.under_root(F.col("path"), "src/vendor", "tests"))


_TASKS = f"""tasks AS (SELECT conv_id, turn, CASE conv_id % 5 WHEN 0 THEN 'Fix the failing ' WHEN 1 THEN 'Rename ' WHEN 2 THEN 'Review ' WHEN 3 THEN 'Show callers and dependencies of ' ELSE '' END || coalesce(text, '') AS task FROM conversations),
tok AS (SELECT conv_id, turn, {tokens_sql('task')} AS t FROM tasks)"""


def _tasks(spark, sf_dir):
    five = F.col("conv_id") % 5
    start = F.when(five == 0, "Fix the failing ").when(five == 1, "Rename ").when(five == 2, "Review ").when(five == 3, "Show callers and dependencies of ").otherwise("")
    rows = table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", T.identifier_tokens(F.concat(start, F.coalesce("text", F.lit("")))).alias("t"))


_INTENT = f"CASE WHEN {in_list('t', T.DEBUG_WORDS)} THEN 'debug' WHEN {in_list('t', T.EDIT_WORDS)} THEN 'edit' WHEN list_has_any(t, ['review', 'merge']) THEN 'review' ELSE 'understand' END"
_MODE = f"CASE WHEN intent IN ('edit', 'debug', 'review') THEN 'impact' WHEN {in_list('t', T.STRUCTURAL_WORDS)} THEN 'structural' ELSE 'lexical' END"


@query("intent_classify", f"WITH {_TASKS}, i AS (SELECT *, {_INTENT} AS intent FROM tok) SELECT conv_id, turn, intent, {_MODE} AS mode FROM i")
def intent_classify(spark, sf_dir):
    found = _tasks(spark, sf_dir).withColumn("intent", T.infer_intent(F.col("t")))
    return found.select("conv_id", "turn", "intent", T.plan_mode(F.col("t"), F.col("intent")).alias("mode"))


@query("unique_leaf_names", "SELECT p_partkey, leaf FROM (SELECT p_partkey, list_extract(string_split(p_name, ' '), -1) AS leaf, count(*) OVER (PARTITION BY p_brand, p_name) AS n FROM part) WHERE n = 1")
def unique_leaf_names(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_name", F.substring_index("p_name", " ", -1).alias("leaf"))
    once = parts.groupBy("p_brand", "p_name").agg(F.count(F.lit(1)).alias("n")).where("n = 1")
    return parts.join(once, ["p_brand", "p_name"], "left_semi").select("p_partkey", "leaf")


@query("round_robin_spread", "SELECT p_partkey, p_brand, r FROM (SELECT p_partkey, p_brand, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS INTEGER) AS r FROM part) ORDER BY r, p_brand LIMIT 100")
def round_robin_spread(spark, sf_dir):
    place = F.row_number().over(W.partitionBy("p_brand").orderBy("p_partkey")).alias("r")
    return table(spark, sf_dir, "part").select("p_partkey", "p_brand", place).orderBy("r", "p_brand").limit(100)


_OVERVIEW = """CASE WHEN regexp_matches(t, '\\b(?:review|pr|merge|diff|changes|changeset)\\b') THEN 'review' WHEN regexp_matches(t, '\\b(?:debug|bug|error|fix|broken|failing|crash|regression)\\b') THEN 'debug'
  WHEN regexp_matches(t, '\\b(?:refactor|rename|extract|cleanup|dead|unused|remove)\\b') THEN 'refactor'
  WHEN regexp_matches(t, '\\b(?:explore|understand|architecture|overview|map|learn|what\\sis|how\\sdoes|improve|improvement|roadmap)\\b') THEN 'explore' ELSE 'general' END"""


@query("overview_intents", f"""WITH x AS (SELECT conv_id, turn, lower(CASE conv_id % 6 WHEN 0 THEN 'Review the diff ' WHEN 1 THEN 'Prefix errors ' WHEN 2 THEN 'what is ' WHEN 3 THEN 'rename ' WHEN 4 THEN 'broken: ' ELSE '' END || coalesce(text, '')) AS t FROM conversations)
SELECT conv_id, turn, {_OVERVIEW} AS intent FROM x""")
def overview_intents(spark, sf_dir):
    from ..operators import retrieval

    six = F.col("conv_id") % 6
    start = F.when(six == 0, "Review the diff ").when(six == 1, "Prefix errors ").when(six == 2, "what is ").when(six == 3, "rename ").when(six == 4, "broken: ").otherwise("")
    rows = table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", retrieval.overview_intent(F.concat(start, F.coalesce("text", F.lit("")))).alias("intent"))
