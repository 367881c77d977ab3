"""Maintenance and evaluation queries: versions of documents, saves, leases, rules, metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import maintenance
from ..sources.driver_tables import VERSIONS, table, versions
from .registry import query
from .text_plans import _PATHS, _paths


@query("change_detection_full_outer", f"""WITH {VERSIONS} SELECT coalesce(v1.path, v2.path) AS path,
  CASE WHEN v2.path IS NULL THEN 'deleted' WHEN v1.path IS NULL THEN 'new' WHEN v1.sha256 <> v2.sha256 THEN 'changed' ELSE 'unchanged' END AS change
FROM v1 FULL OUTER JOIN v2 ON v1.path = v2.path""")
def change_detection_full_outer(spark, sf_dir):
    return maintenance.detect_changes(*versions(spark, sf_dir))


@query("unchanged_diff", f"WITH {VERSIONS} SELECT v1.path FROM v1 JOIN v2 USING (path) WHERE v1.sha256 = v2.sha256")
def unchanged_diff(spark, sf_dir):
    before, after = versions(spark, sf_dir)
    touched = maintenance.detect_changes(before, after).where("change <> 'unchanged'").select("path")
    return before.select("path").join(touched, "path", "left_anti")


@query("untracked_intersect", f"WITH {VERSIONS} SELECT path FROM v1 INTERSECT SELECT path FROM v2 WHERE path LIKE '%3.txt'")
def untracked_intersect(spark, sf_dir):
    before, after = versions(spark, sf_dir)
    return before.select("path").intersect(after.where(F.col("path").endswith("3.txt")).select("path"))


@query("refresh_apply", f"""WITH {VERSIONS}, dep AS (SELECT path FROM v2 WHERE path LIKE '%77.txt')
SELECT v2.path, v2.sha256, CASE WHEN v1.path IS NOT NULL AND v1.sha256 = v2.sha256 AND v2.path NOT IN (SELECT path FROM dep) THEN 'kept' ELSE 'written' END AS origin
FROM v2 LEFT JOIN v1 ON v1.path = v2.path""")
def refresh_apply(spark, sf_dir):
    before, after = versions(spark, sf_dir)
    dependents = after.where(F.col("path").endswith("77.txt")).select("path")
    return maintenance.refresh(before, after, dependents)


@query("save_debounce_sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS start FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT user_id, ts, sum(start) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id AS root, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS ended, count(*) AS n FROM s GROUP BY user_id, k""")
def save_debounce_sessions(spark, sf_dir):
    saves = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return maintenance.debounced(saves, "user_id", "ts", "30 minutes").select("root", text("started"), text("ended"), "n")


@query("lease_acquire_timeline", """WITH RECURSIVE o AS (SELECT user_id, event_id, epoch(ts)::DOUBLE AS tm, row_number() OVER (PARTITION BY user_id ORDER BY epoch(ts), event_id) AS k FROM events),
f(user_id, event_id, tm, k, acquired, until) AS (
  SELECT user_id, event_id, tm, k, true, tm + 86400 FROM o WHERE k = 1
  UNION ALL SELECT o.user_id, o.event_id, o.tm, o.k, o.tm >= f.until, CASE WHEN o.tm >= f.until THEN o.tm + 86400 ELSE f.until END FROM f JOIN o ON o.user_id = f.user_id AND o.k = f.k + 1)
SELECT user_id, event_id, acquired FROM f""")
def lease_acquire_timeline(spark, sf_dir):
    attempts = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").cast("double").alias("at"))
    return maintenance.lease_timeline(attempts, "user_id", "at", "event_id", 86_400.0).select("user_id", "event_id", "acquired")


@query("latest_revision_per_root", "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def latest_revision_per_root(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return maintenance.latest_revision(rows, "user_id", "event_id")


_RULES = ("# comment", "tests/", "*.min.js", "!src/*4.min.js", "src/vendor/*", "!page7*")


@query("ignore_rules_last_match", f"""WITH {_PATHS}, m AS (SELECT page_id, path, list_extract(string_split(path, '/'), -1) AS name FROM paths)
SELECT page_id, path FROM m WHERE starts_with(path, 'tests/') OR
  CASE WHEN starts_with(name, 'page7') THEN false WHEN starts_with(path, 'src/vendor/') THEN true WHEN path LIKE 'src/%4.min.js' THEN false ELSE ends_with(name, '.min.js') END""")
def ignore_rules_last_match(spark, sf_dir):
    rules = [r for line in _RULES if (r := maintenance.parse_rule(line))]
    return _paths(spark, sf_dir).where(maintenance.is_ignored(F.col("path"), rules))


@query("range_overlap_precision", """SELECT l_orderkey, l_linenumber FROM lineitem a WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = a.l_orderkey
  AND a.l_quantity <= (o.o_custkey % 40) + 5 AND a.l_quantity + 3 >= o.o_custkey % 40)""")
def range_overlap_precision(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("lo"), (F.col("l_quantity") + 3).alias("hi"))
    ranges = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_custkey") % 40).alias("lo"), (F.col("o_custkey") % 40 + 5).alias("hi"))
    return maintenance.range_matches(items, ranges, "l_orderkey").select("l_orderkey", "l_linenumber")


@query("evidence_recall", """WITH f AS (SELECT o_orderkey, o_orderstatus, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45) AS found FROM orders)
SELECT o_orderstatus AS category, count(*) AS n, round(avg(found::INT), 6) AS recall FROM f GROUP BY 1""")
def evidence_recall(spark, sf_dir):
    hits = table(spark, sf_dir, "lineitem").where("l_quantity > 45").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.lit(1).alias("hit"))
    orders = table(spark, sf_dir, "orders").join(hits, "o_orderkey", "left")
    return orders.groupBy(F.col("o_orderstatus").alias("category")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(F.coalesce("hit", F.lit(0))), 6).alias("recall")
    )


_METRICS = """SELECT l_returnflag, count(*) AS n, median(l_quantity) AS median, round(avg(l_quantity), 6) AS mean, round(stddev_pop(l_quantity), 6) AS deviation,
  list_sort(list(l_quantity))[CAST(round_even(0.95 * (count(*) - 1), 0) AS BIGINT) + 1] AS p95, round(avg((l_discount < 0.05)::INT), 6) AS rate FROM lineitem GROUP BY l_returnflag"""


def _metrics(spark, sf_dir):
    found = maintenance.metrics(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_quantity", F.col("l_discount") < 0.05)
    rounded = [F.round(c, 6).alias(c) for c in ("mean", "deviation", "rate")]
    return found.select("l_returnflag", "n", "median", "p95", *rounded)


@query("metrics_median_p95_by_group", _METRICS)
def metrics_median_p95_by_group(spark, sf_dir):
    return _metrics(spark, sf_dir)


@query("gates", f"SELECT l_returnflag, rate >= 0.4 AS recall_gate, p95 - median < 25 AS latency_gate, deviation / mean <= 0.6 AS ratio_gate FROM ({_METRICS})")
def gates(spark, sf_dir):
    return _metrics(spark, sf_dir).select(
        "l_returnflag", (F.col("rate") >= 0.4).alias("recall_gate"), (F.col("p95") - F.col("median") < 25).alias("latency_gate"),
        (F.col("deviation") / F.col("mean") <= 0.6).alias("ratio_gate"),
    )


@query("corpus_quality_counts", """SELECT source, count(*) AS n, count(*) FILTER (n_chars > 1000) AS long_ones, count(DISTINCT lang) = 4 AS complete, bool_and(n_chars > 0) AS valid FROM documents GROUP BY source ORDER BY source""")
def corpus_quality_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("n_chars") > 1000).alias("long_ones"),
        (F.size(F.collect_set("lang")) == 4).alias("complete"), F.bool_and(F.col("n_chars") > 0).alias("valid"),
    )


_TASKS_SQL = """t AS (SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'debug' ELSE 'definition' END AS category, CASE WHEN o_orderkey % 5 = 0 THEN 'ambiguous' ELSE 'ready' END AS expected_status FROM orders),
s AS (SELECT l_orderkey AS id, 'p' || l_partkey % 3 AS path, CAST(l_quantity AS INTEGER) AS lo, CAST(l_quantity AS INTEGER) + 5 AS hi, CASE l_suppkey % 4 WHEN 0 THEN 'caller' WHEN 1 THEN 'test' WHEN 2 THEN 'target' ELSE 'context' END AS role FROM lineitem WHERE l_orderkey % 7 <> 0),
e AS (SELECT o_orderkey AS id, 'p' || j AS path, CAST(o_custkey % 50 AS INTEGER) AS line, CASE WHEN j = 1 THEN 'test' END AS role FROM orders, (SELECT unnest([0, 1]) AS j) WHERE o_orderkey % 11 <> 0),
r AS (SELECT o_orderkey AS id, 'p0' AS path, 10 AS lo, CAST(10 + o_custkey % 20 AS INTEGER) AS hi FROM orders)"""


@query("response_scoring", f"""WITH {_TASKS_SQL},
h AS (SELECT e.id, e.path, max((e.role IS NULL OR s.role = e.role)::INT) AS ok FROM e JOIN s ON s.id = e.id AND s.path = e.path AND e.line BETWEEN s.lo AND s.hi GROUP BY 1, 2),
c AS (SELECT e.id, avg((h.ok IS NOT NULL)::INT) AS recall, avg(coalesce(h.ok, 0)) AS role_recall FROM e LEFT JOIN h ON h.id = e.id AND h.path = e.path GROUP BY e.id),
p AS (SELECT s.id, avg((EXISTS (SELECT 1 FROM r WHERE r.id = s.id AND r.path = s.path AND s.lo <= r.hi AND s.hi >= r.lo) OR (t.category = 'debug' AND s.role IN ('caller', 'test')))::INT) AS precision FROM s JOIN t USING (id) GROUP BY s.id)
SELECT t.id, round(coalesce(recall, 1), 6) AS recall, round(coalesce(role_recall, 1), 6) AS role_recall, round(coalesce(precision, CASE WHEN expected_status <> 'ready' THEN 1 ELSE 0 END), 6) AS precision
FROM t LEFT JOIN c USING (id) LEFT JOIN p USING (id)""")
def response_scoring(spark, sf_dir):
    from ..operators import evaluation

    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    k = F.col("o_orderkey")
    tasks = orders.select(
        k.alias("id"), F.when(k % 3 == 0, "debug").otherwise("definition").alias("category"),
        F.when(k % 5 == 0, "ambiguous").otherwise("ready").alias("expected_status"),
    )
    four, lo = F.col("l_suppkey") % 4, F.col("l_quantity").cast("int")
    slices = items.where("l_orderkey % 7 <> 0").select(
        F.col("l_orderkey").alias("id"), F.concat(F.lit("p"), (F.col("l_partkey") % 3).cast("string")).alias("path"),
        lo.alias("lo"), (lo + 5).alias("hi"), F.when(four == 0, "caller").when(four == 1, "test").when(four == 2, "target").otherwise("context").alias("role"),
    )
    evidence = orders.where("o_orderkey % 11 <> 0").select(k.alias("id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("j"), (F.col("o_custkey") % 50).cast("int").alias("line")).select(
        "id", F.concat(F.lit("p"), F.col("j").cast("string")).alias("path"), "line", F.when(F.col("j") == 1, "test").alias("role")
    )
    ranges = orders.select(k.alias("id"), F.lit("p0").alias("path"), F.lit(10).alias("lo"), (10 + F.col("o_custkey") % 20).cast("int").alias("hi"))
    found = evaluation.score_answers(tasks, slices, evidence, ranges)
    return found.select("id", *[F.round(c, 6).alias(c) for c in ("recall", "role_recall", "precision")])


@query("sample_medians", """SELECT l_orderkey AS id, CAST(trunc(median(l_linenumber * 3)) AS BIGINT) AS tokens, round_even(median(l_extendedprice), 3) AS latency, count(*) AS sample_count, max(l_linenumber) AS last FROM lineitem GROUP BY l_orderkey""")
def sample_medians(spark, sf_dir):
    from ..operators import evaluation

    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("id"), "l_linenumber", (F.col("l_linenumber") * 3).alias("tokens"), F.col("l_extendedprice").alias("latency")
    )
    return evaluation.sample_medians(rows, "id", "l_linenumber", ["tokens"], ["latency"])


@query("corpus_completeness", """SELECT count(*) AS task_count, count(*) = 1500 AS task_count_exact, bool_and(o_orderkey % 97 <> 0) AS all_tasks_supported,
  bool_and(o_orderkey % 97 = 0 OR CASE o_orderstatus WHEN 'F' THEN true ELSE o_totalprice > 0 END) AS task_contracts_complete, bool_and(o_orderkey % 97 = 0 OR o_custkey IN (SELECT c_custkey FROM customer)) AS repository_pins_complete FROM orders""")
def corpus_completeness(spark, sf_dir):
    from ..operators import evaluation

    one = F.lit(1)
    tasks = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("repo"), F.col("o_custkey").alias("commit"), (F.col("o_orderkey") % 97 != 0).alias("supported"),
        F.when(F.col("o_orderstatus") == "F", "insufficient").otherwise("ready").alias("status"), (F.col("o_totalprice") > 0).cast("int").alias("n_targets"),
        F.lit(0).alias("n_candidates"), one.alias("n_ranges"), one.alias("n_evidence"),
    )
    pins = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("repo"), F.col("c_custkey").alias("commit"))
    return evaluation.corpus_completeness(tasks, pins, 1500)


@query("counts_by_value", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def counts_by_value(spark, sf_dir):
    from ..operators import evaluation

    return evaluation.counts_of(table(spark, sf_dir, "events"), "event_type")


@query("parse_cache_misses", f"WITH {VERSIONS} SELECT v2.path, v1.path IS NOT NULL AND v1.sha256 = v2.sha256 AS cached FROM v2 LEFT JOIN v1 ON v1.path = v2.path")
def parse_cache_misses(spark, sf_dir):
    before, after = versions(spark, sf_dir)
    hit = after.join(before, ["path", "sha256"], "left_semi").select("path", F.lit(True).alias("cached"))
    miss = after.join(before, ["path", "sha256"], "left_anti").select("path", F.lit(False).alias("cached"))
    return hit.unionByName(miss)
