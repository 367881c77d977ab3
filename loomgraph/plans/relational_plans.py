"""Tables, upserts, cascades, resolution and counts over the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import resolution, store
from ..sources.driver_tables import G_EDGES, G_ENTITIES, g_edges, g_entities, node, table
from .registry import query


@query("entities_view", f"""WITH {G_ENTITIES} SELECT e.id, e.kind, e.name, e.path, coalesce(p.name, '') AS parent_name
FROM g_entities e LEFT JOIN g_entities p ON p.id = e.parent_id""")
def entities_view(spark, sf_dir):
    e = g_entities(spark, sf_dir)
    parents = e.select(F.col("id").alias("parent_id"), F.col("name").alias("parent_name"))
    return e.join(parents, "parent_id", "left").select("id", "kind", "name", "path", F.coalesce("parent_name", F.lit("")).alias("parent_name"))


_SUPPLY = "SELECT 'supplier::' || l_suppkey AS source, 'part::' || l_partkey AS target, 'supplies' AS relation"


@query("edge_dedup_upsert", f"""WITH new AS (
  SELECT source, target, relation, max(seq) AS seq FROM ({_SUPPLY}, l_orderkey * 8 + l_linenumber AS seq FROM lineitem WHERE l_quantity > 25) GROUP BY 1, 2, 3
), base AS (SELECT source, target, relation, min(seq) AS seq FROM ({_SUPPLY}, l_orderkey * 8 + l_linenumber AS seq FROM lineitem WHERE l_quantity < 30) GROUP BY 1, 2, 3)
SELECT source, target, relation, seq FROM new UNION ALL
SELECT source, target, relation, seq FROM base WHERE (source, target, relation) NOT IN (SELECT (source, target, relation) FROM new)""")
def edge_dedup_upsert(spark, sf_dir):
    keys = ["source", "target", "relation"]
    rows = table(spark, sf_dir, "lineitem").select(
        node("supplier", "l_suppkey").alias("source"), node("part", "l_partkey").alias("target"), F.lit("supplies").alias("relation"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"), "l_quantity",
    )
    new = store.last_wins(rows.where("l_quantity > 25").drop("l_quantity"), keys, "seq")
    base = store.first_wins(rows.where("l_quantity < 30").drop("l_quantity"), keys, "seq")
    return store.upsert(base, new, keys)


@query("insert_ignore", """SELECT o_custkey AS lookup, o_orderstatus AS status, 'old' AS origin FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2
UNION ALL SELECT o_custkey, o_orderstatus, 'new' FROM orders GROUP BY 1, 2 HAVING o_orderstatus <> 'F'""")
def insert_ignore(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("lookup"), F.col("o_orderstatus").alias("status"))
    base = rows.where("status = 'F'").distinct().withColumn("origin", F.lit("old"))
    return store.insert_ignore(base, rows.withColumn("origin", F.lit("new")), ["lookup", "status"])


@query("replace_latest", "SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY o_custkey")
def replace_latest(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return store.last_wins(rows, ["o_custkey"], "o_orderkey")


@query("delete_cascade_set_null", """SELECT 'orders' AS part, count(*) AS n, count(*) FILTER (o_custkey IS NULL) AS nulls FROM (
  SELECT o_orderkey, CASE WHEN o_custkey % 10 = 0 THEN NULL ELSE o_custkey END AS o_custkey FROM orders WHERE o_orderkey % 7 <> 0)
UNION ALL SELECT 'lineitem', count(*), 0 FROM lineitem WHERE l_orderkey % 7 <> 0""")
def delete_cascade_set_null(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    gone = orders.where("o_orderkey % 7 = 0")
    kept = store.set_null_where(
        store.delete_where(orders, "o_orderkey", gone, "o_orderkey"), "o_custkey",
        table(spark, sf_dir, "customer").where("c_custkey % 10 = 0"), "c_custkey",
    )
    rest = store.delete_where(items, "l_orderkey", gone, "o_orderkey")
    count = F.count(F.lit(1)).alias("n")
    return (
        kept.agg(count, F.count_if(F.col("o_custkey").isNull()).alias("nulls")).select(F.lit("orders").alias("part"), "n", "nulls")
        .unionByName(rest.agg(count).select(F.lit("lineitem").alias("part"), "n", F.lit(0).cast("bigint").alias("nulls")))
    )


@query("fk_integrity_report", """SELECT 'orders' AS "table", 'o_custkey' AS "column", 'customer' AS "references", count(*) AS violations FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'lineitem', 'l_orderkey', 'orders', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'lineitem', 'l_partkey', 'part', count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part)
UNION ALL SELECT 'labels', 'doc_id', 'documents', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)""")
def fk_integrity_report(spark, sf_dir):
    tables = {n: table(spark, sf_dir, n) for n in ("orders", "customer", "lineitem", "part", "labels", "documents")}
    keys = (
        ("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"),
        ("lineitem", "l_partkey", "part", "p_partkey"), ("labels", "doc_id", "documents", "doc_id"),
    )
    return store.foreign_key_report(tables, keys)


@query("module_lookup_greatest_path", "SELECT p_name AS module_name, arg_max('file::' || p_partkey, 'src/' || p_brand || '/' || p_partkey) AS file_id FROM part GROUP BY p_name")
def module_lookup_greatest_path(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    files = parts.select(node("file", "p_partkey").alias("id"), F.concat(F.lit("src/"), "p_brand", F.lit("/"), F.col("p_partkey").cast("string")).alias("path"))
    lookup = parts.select(F.col("p_name").alias("module_name"), node("file", "p_partkey").alias("file_id"))
    return resolution.module_files(lookup, files)


_LOOKUP = """lookup AS (SELECT p_name AS name, p_brand AS file_id, 'part::' || p_partkey AS symbol_id FROM part),
refs AS (SELECT DISTINCT 'Brand#' || (1 + l_suppkey % 5) || (1 + l_orderkey % 5) AS file_id, p_name AS name FROM lineitem JOIN part ON p_partkey = l_partkey),
bind AS (SELECT 'Brand#' || (1 + l_suppkey % 5) || (1 + l_partkey % 5) AS file_id, p_name AS name, 'part::' || p_partkey AS symbol_id FROM lineitem JOIN part ON p_partkey = l_partkey)"""


@query("resolve_targets_cascade", f"""WITH {_LOOKUP}, s AS (
  SELECT r.file_id, r.name,
    (SELECT list_sort(list(DISTINCT symbol_id)) FROM lookup l WHERE l.name = r.name AND l.file_id = r.file_id) AS a,
    (SELECT list_sort(list(DISTINCT symbol_id)) FROM bind b WHERE b.name = r.name AND b.file_id = r.file_id) AS b,
    (SELECT list_sort(list(DISTINCT symbol_id)) FROM lookup l WHERE l.name = r.name) AS c
  FROM refs r)
SELECT file_id, name, CASE WHEN len(a) = 1 THEN a[1] WHEN coalesce(len(a), 0) = 0 AND len(b) = 1 THEN b[1] END AS target,
  CASE WHEN len(a) > 1 THEN 'ambiguous' WHEN len(a) = 1 THEN 'resolved' WHEN len(b) > 1 THEN 'ambiguous' WHEN len(b) = 1 THEN 'resolved' WHEN len(c) > 1 THEN 'ambiguous' ELSE 'unresolved' END AS status,
  CASE WHEN len(a) > 0 THEN 'same_file' WHEN len(b) > 0 THEN 'explicit_import' ELSE 'unbound_name' END AS strategy,
  array_to_string(CASE WHEN len(a) > 0 THEN a WHEN len(b) > 0 THEN b ELSE c END, ',') AS candidates FROM s""")
def resolve_targets_cascade(spark, sf_dir):
    parts, items = (table(spark, sf_dir, n) for n in ("part", "lineitem"))
    brand = lambda a, b: F.concat(F.lit("Brand#"), (1 + F.col(a) % 5).cast("string"), (1 + F.col(b) % 5).cast("string"))
    lookup = parts.select(F.col("p_name").alias("name"), F.col("p_brand").alias("file_id"), node("part", "p_partkey").alias("symbol_id"))
    names = parts.select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("name"))
    refs = items.join(names, "l_partkey").select(brand("l_suppkey", "l_orderkey").alias("file_id"), "name")
    bind = items.join(names, "l_partkey").select(
        brand("l_suppkey", "l_partkey").alias("file_id"), "name", node("part", "l_partkey").alias("symbol_id")
    )
    return resolution.resolve_references(refs, lookup, bind).withColumn("candidates", F.array_join("candidates", ","))


@query("import_binding_status", """WITH b AS (SELECT DISTINCT l_suppkey, l_partkey, CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE p_brand END AS resolved_file_id,
  CASE WHEN l_partkey % 3 = 0 THEN 'absent' ELSE p_name END AS imported_name FROM lineitem JOIN part ON p_partkey = l_partkey),
s AS (SELECT p_brand, p_name, min('part::' || p_partkey) AS one, count(*) AS n FROM part GROUP BY 1, 2)
SELECT b.*, CASE WHEN n = 1 THEN one END AS resolved_symbol_id,
  CASE WHEN resolved_file_id IS NULL THEN 'external' WHEN n = 1 THEN 'resolved' WHEN n > 1 THEN 'ambiguous' ELSE 'file_resolved' END AS status
FROM b LEFT JOIN s ON s.p_brand = b.resolved_file_id AND s.p_name = b.imported_name""")
def import_binding_status(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct().join(
        parts.select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_name"), "l_partkey"
    )
    bindings = rows.select(
        "l_suppkey", "l_partkey", F.when(F.col("l_suppkey") % 4 != 0, F.col("p_brand")).alias("resolved_file_id"),
        F.when(F.col("l_partkey") % 3 == 0, "absent").otherwise(F.col("p_name")).alias("imported_name"),
    )
    symbols = parts.select(F.col("p_brand").alias("file_id"), F.col("p_name").alias("name"), node("part", "p_partkey").alias("symbol_id"))
    return resolution.binding_status(bindings, symbols)


def _hops(k: int) -> str:
    seen = ", ".join(f"w{j}.at" for j in range(k + 1))
    joins = " ".join(f"JOIN b b{j} ON b{j}.name = {'p.p_partkey' if j == 0 else f'b{j - 1}.target'}" for j in range(k))
    at = "p.p_partkey" if k == 0 else f"b{k - 1}.target"
    path = ["p.p_partkey", *[f"b{j}.target" for j in range(k)]]
    fresh = " AND ".join(f"{path[i]} <> {path[j]}" for i in range(len(path)) for j in range(i)) or "true"
    del seen
    return f"SELECT p.p_partkey AS start, {at} AS leaf, {k} AS hops FROM part p {joins} WHERE {fresh} AND NOT EXISTS (SELECT 1 FROM b WHERE b.name = {at})"


@query("reexport_closure_depth4", f"""WITH b AS (SELECT p_partkey AS name, (p_partkey * 7) % (SELECT count(*) FROM part) AS target FROM part WHERE p_partkey % 3 <> 0)
SELECT DISTINCT start, leaf, CAST(hops AS INTEGER) AS hops FROM ({' UNION ALL '.join(_hops(k) for k in range(5))})""")
def reexport_closure_depth4(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    n = parts.count()
    bindings = parts.where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("name"), ((F.col("p_partkey") * 7) % n).alias("target"))
    return resolution.reexport_closure(bindings, parts.select(F.col("p_partkey").alias("start")))


@query("method_parent_fixup", """WITH m AS (SELECT 'c::' || c_custkey AS id, n_name AS class_name, 'd' || c_custkey % 5 AS top FROM customer JOIN nation ON n_nationkey = c_nationkey),
c AS (SELECT 'n::' || n_nationkey || '::' || k AS parent_id, n_name AS class_name, 'd' || k AS top FROM nation, (SELECT unnest([0, 1, 2]) AS k))
SELECT id, parent_id FROM (SELECT id, parent_id, row_number() OVER (PARTITION BY id ORDER BY m.top = c.top DESC, parent_id) AS r FROM m JOIN c USING (class_name)) WHERE r = 1""")
def method_parent_fixup(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    key = lambda c: F.col(c).cast("string")
    methods = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        node("c", "c_custkey").alias("id"), F.concat("n_name", F.lit(".m")).alias("name"),
        F.concat(F.lit("d"), (F.col("c_custkey") % 5).cast("string"), F.lit("/x.py")).alias("path"),
    )
    classes = nation.withColumn("k", F.explode(F.array(*map(F.lit, range(3))))).select(
        F.concat(F.lit("n::"), key("n_nationkey"), F.lit("::"), key("k")).alias("id"), F.col("n_name").alias("name"),
        F.concat(F.lit("d"), key("k"), F.lit("/y.py")).alias("path"),
    )
    return resolution.method_parents(methods, classes)


@query("tested_by_swap", f"""WITH {G_EDGES}, {G_ENTITIES} SELECT DISTINCT target AS source, source AS target, 'tested_by' AS relation FROM g_edges
WHERE source IN (SELECT id FROM g_entities WHERE is_test) AND source <> target""")
def tested_by_swap(spark, sf_dir):
    return resolution.tested_by(g_edges(spark, sf_dir), g_entities(spark, sf_dir))


@query("decorates_reverse", "SELECT DISTINCT 'user::' || user_id AS source, 'event::' || event_type AS target, 'decorates' AS relation FROM events")
def decorates_reverse(spark, sf_dir):
    return resolution.decorates(table(spark, sf_dir, "events").select(node("event", "event_type").alias("decorated"), node("user", "user_id").alias("decorator")))


@query("top_languages", "SELECT lang AS language, count(*) AS n FROM documents WHERE lang <> '' GROUP BY lang ORDER BY n DESC, lang LIMIT 3")
def top_languages(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").where("lang <> ''").groupBy(F.col("lang").alias("language")).agg(F.count(F.lit(1)).alias("n"))
    return rows.orderBy(F.desc("n"), "language").limit(3)


@query("graph_totals", f"""WITH {G_EDGES}, {G_ENTITIES} SELECT (SELECT count(*) FROM documents) AS files, (SELECT count(*) FROM g_entities) AS symbols,
  (SELECT count(*) FROM g_edges) AS edges, (SELECT count(*) FROM g_entities WHERE is_test) AS tests""")
def graph_totals(spark, sf_dir):
    entities = g_entities(spark, sf_dir)
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    one_row = entities.agg(F.count(F.lit(1)).alias("symbols"), F.count_if("is_test").alias("tests"))
    return (
        count(table(spark, sf_dir, "documents"), "files").crossJoin(one_row)  # one row each
        .crossJoin(count(g_edges(spark, sf_dir), "edges")).select("files", "symbols", "edges", "tests")
    )


@query("status_summary", """SELECT count(*) AS files, count(*) FILTER (n_chars > 3000) AS long_files, CAST(coalesce(sum(n_chars), 0) AS BIGINT) AS size,
  array_to_string(list_sort(list(DISTINCT lang)), ',') AS languages FROM documents""")
def status_summary(spark, sf_dir):
    return table(spark, sf_dir, "documents").agg(
        F.count(F.lit(1)).alias("files"), F.count_if(F.col("n_chars") > 3000).alias("long_files"),
        F.coalesce(F.sum("n_chars"), F.lit(0)).alias("size"), F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("languages"),
    )


@query("occurrence_keys", """SELECT l_orderkey, l_linenumber, CAST(row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey * 8 + l_linenumber) - 1 AS INTEGER) AS ordinal,
  substr(sha256(l_partkey || chr(31) || l_suppkey || chr(31) || (row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey * 8 + l_linenumber) - 1)), 1, 32) AS key FROM lineitem""")
def occurrence_keys(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("seq", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    numbered = store.occurrence_ordinals(rows, ["l_partkey", "l_suppkey"], "seq")
    key = store.occurrence_key(F.col("l_partkey"), F.col("l_suppkey"), F.col("ordinal"))
    return numbered.select("l_orderkey", "l_linenumber", "ordinal", F.lower(F.hex(key)).alias("key"))


_SOURCES = (
    ("helpers.py", "def clean_name(value):\n    return value.strip()\n"),
    ("service.py", "from helpers import clean_name\n\n\nclass Service:\n    def create(self, name):\n        return clean_name(name)\n"),
    ("tests/test_service.py", "from service import Service\n\n\ndef test_create():\n    assert Service().create('a')\n"),
    ("src/text.ts", "export function trim(x: string) {\n  return x.trim();\n}\nexport const up = (x: string) => trim(x);\n"),
    ("src/store.js", "import { trim } from './text';\nclass Store extends Base {\n  put(x) {\n    return trim(x);\n  }\n}\n"),
    ("broken.py", "def f(:\n"),
)


def _parsed(spark):
    from ..operators import parsing

    rows = [(path, bytearray(text, "utf-8")) for path, text in _SOURCES]
    return parsing.parse_files(spark.createDataFrame(rows, "path string, content binary"))


@query("parse_symbols_udtf", """SELECT * FROM (VALUES
  ('helpers.py', 'ok', 'function', 'clean_name', 'def clean_name(value):', 1, 2, false),
  ('service.py', 'ok', 'class', 'Service', 'class Service:', 4, 6, false),
  ('service.py', 'ok', 'method', 'Service.create', 'def create(self, name):', 5, 6, false),
  ('tests/test_service.py', 'ok', 'function', 'test_create', 'def test_create():', 4, 5, true),
  ('src/text.ts', 'ok', 'function', 'trim', 'function trim(x: string)', 1, 3, false),
  ('src/text.ts', 'ok', 'function', 'up', 'const up = (x: string) => trim(x);', 4, 4, false),
  ('src/store.js', 'ok', 'class', 'Store', 'class Store extends Base', 2, 6, false),
  ('src/store.js', 'ok', 'method', 'Store.put', 'put(x)', 3, 5, false),
  ('broken.py', 'error', NULL, NULL, NULL, NULL, NULL, NULL)) v(path, status, kind, name, signature, start_line, end_line, is_test)""")
def parse_symbols_udtf(spark, sf_dir):
    """Symbols of sources given in line; the tables hold no code."""
    parsed = _parsed(spark)
    return parsed.select("path", "status", F.explode_outer("symbols").alias("s")).select(
        "path", "status", "s.kind", "s.name", "s.signature", "s.start_line", "s.end_line", "s.is_test"
    )


@query("index_edges", """SELECT * FROM (VALUES
  ('symbol::service.py::method::Service.create', 'symbol::helpers.py::function::clean_name', 'calls'),
  ('symbol::tests/test_service.py::function::test_create', 'symbol::service.py::class::Service', 'calls'),
  ('symbol::service.py::class::Service', 'symbol::tests/test_service.py::function::test_create', 'tested_by'),
  ('symbol::src/text.ts::function::up', 'symbol::src/text.ts::function::trim', 'calls'),
  ('symbol::src/store.js::method::Store.put', 'symbol::src/text.ts::function::trim', 'calls'),
  ('file::service.py', 'file::helpers.py', 'imports'), ('file::tests/test_service.py', 'file::service.py', 'imports'), ('file::src/store.js', 'file::src/text.ts', 'imports')) v(source, target, relation)""")
def index_edges(spark, sf_dir):
    from ..operators import indexing
    from ..operators.scratch import materialise

    return indexing.build_tables(materialise(_parsed(spark), "parsed"))["edges"].select("source", "target", "relation")


@query("one_hop_imports", """SELECT * FROM (VALUES ('service.py', 0, 0), ('helpers.py', 1, 0)) v(path, position, line)""")
def one_hop_imports(spark, sf_dir):
    """Imported files of sources given in line; the tables hold no code."""
    from ..operators import resolution

    files = spark.createDataFrame(_SOURCES, "path string, text string")
    asked = spark.createDataFrame([("tests/test_service.py", 0), ("service.py", 1), ("src/store.js", 2)], "path string, position int")
    return resolution.one_hop_imports(files, asked)
