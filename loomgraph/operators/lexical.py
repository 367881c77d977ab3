"""Weighted BM25 over an inverted index kept as tables (postings by term, document lengths), or over
documents directly."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: BM25 parameters and the weights of the lexical columns.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
WEIGHTS = {"name": 4.0, "path": 2.0, "signature": 1.0, "docstring": 2.0, "summary": 1.0, "source": 1.0}


def terms_of(text: Column) -> Column:
    """Index terms: lower case, split at everything that is no letter or digit; no camel split."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda t: t != "")


def postings(docs: DataFrame, weights: dict[str, float], key: str = "node_id") -> DataFrame:
    """(node_id, term, tf, n): weighted and plain frequency of each term of each document."""
    parts = [
        docs.select(F.col(key).alias("node_id"), F.explode(terms_of(F.col(c))).alias("term"), F.lit(float(w)).alias("w"))
        for c, w in weights.items()
    ]
    rows = reduce(DataFrame.unionByName, parts)
    return rows.groupBy("node_id", "term").agg(F.sum("w").alias("tf"), F.count(F.lit(1)).alias("n"))


def lengths(docs: DataFrame, columns: list[str], key: str = "node_id") -> DataFrame:
    """(node_id, dl): terms in all columns; a projection, so nothing is shuffled for it."""
    total = reduce(lambda a, b: a + b, (F.size(terms_of(F.col(c))) for c in columns))
    return docs.select(F.col(key).alias("node_id"), total.cast("double").alias("dl"))


def weighted_terms(docs: DataFrame, weights: dict[str, float], key: str = "node_id", only: list[str] | None = None) -> DataFrame:
    """(node_id, dl, term, tf): one pass over the documents; with `only`, just those terms go on."""
    columns = list(weights)
    split = docs.select(F.col(key).alias("node_id"), *[terms_of(F.col(c)).alias(f"_t{k}") for k, c in enumerate(columns)])
    wanted = lambda terms: F.filter(terms, lambda t: t.isin(only)) if only else F.col(terms)
    weighing = lambda w: lambda t: F.struct(t.alias("term"), F.lit(float(w)).alias("w"))
    pairs = [F.transform(wanted(f"_t{k}"), weighing(weights[c])) for k, c in enumerate(columns)]
    total = reduce(lambda a, b: a + b, (F.size(f"_t{k}") for k in range(len(columns))))
    # The length is a column before terms become rows; beside explode() it would be counted for each.
    rows = split.select("node_id", total.cast("double").alias("dl"), F.concat(*pairs).alias("xs"))
    rows = rows.select("node_id", "dl", F.explode("xs").alias("x"))
    return rows.groupBy("node_id", "dl", F.col("x.term").alias("term")).agg(F.sum("x.w").alias("tf"))


def stored_postings(docs: DataFrame, weights: dict[str, float] | None = None, key: str = "node_id") -> DataFrame:
    """(node_id, dl, term, tf), in order of term, to be written: a query's filter on term then reads
    only the row groups that have its terms."""
    found = weighted_terms(docs, weights or WEIGHTS, key)
    return found.repartitionByRange("term").sortWithinPartitions("term", "node_id")


def totals(dl: DataFrame) -> DataFrame:
    """One row: number of documents and their mean length."""
    return dl.agg(F.count(F.lit(1)).alias("N"), F.avg("dl").alias("avgdl"))


def ranked(matched: DataFrame, corpus: DataFrame, query_terms: list[str]) -> DataFrame:
    """(node_id, score, dl) from postings (node_id, dl, term, tf) that have the query's terms; a
    repeated query term counts again. corpus: one row of totals()."""
    asked: dict[str, int] = {}
    for t in query_terms:
        asked[t] = asked.get(t, 0) + 1
    spark = matched.sparkSession
    if not asked:
        return spark.createDataFrame([], "node_id string, score double, dl double")
    matched = matched.where(F.col("term").isin(list(asked)))
    q = spark.createDataFrame(list(asked.items()), "term string, times int")
    df = matched.groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(corpus))  # a row for each query term
    raw = F.ln((F.col("N") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = df.join(F.broadcast(q), "term").select(
        "term", "avgdl", (F.when(raw > 0, raw).otherwise(F.lit(LEAST_IDF)) * F.col("times")).alias("idf")
    )
    norm = F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl"))
    scored = matched.join(F.broadcast(idf), "term")  # idf: a row for each query term
    return scored.groupBy("node_id").agg(
        F.sum(F.col("idf") * F.col("tf") * (K1 + 1) / norm).alias("score"), F.first("dl").alias("dl")
    )


def bm25(docs: DataFrame, query_terms: list[str], weights: dict[str, float] | None = None, key: str = "node_id") -> DataFrame:
    """As ranked(), for documents without stored postings: only the query's terms are shuffled."""
    weights = weights or WEIGHTS
    matched = weighted_terms(docs, weights, key, list(dict.fromkeys(query_terms)))
    return ranked(matched, totals(lengths(docs, list(weights), key)), query_terms)


def top_documents(scores: DataFrame, limit: int) -> DataFrame:
    """The best documents; ties go by id, so that the limit is deterministic. Rounding first keeps
    the order from depending on how a sum was split."""
    rounded = scores.withColumn("score", F.round("score", 6))
    return rounded.orderBy(F.desc("score"), "node_id").limit(limit)


def line_search(docs: DataFrame, terms: list[str], limit: int) -> DataFrame:
    """The lines with the most query terms: 4 for each, 12 more where a line defines something."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "content"))
    low = F.lower("content")
    found = reduce(lambda a, b: a + b, (F.when(low.contains(t), 4).otherwise(0) for t in terms))
    defines = F.when(low.rlike(r"^\s*(def|class|function|const)\s"), 12).otherwise(0)
    scored = lines.where(found > 0).select("doc_id", (F.col("line") + 1).alias("line"), (found + defines).alias("score"))
    return scored.orderBy(F.desc("score"), "doc_id", "line").limit(limit)


def ranked_matches(files: DataFrame, terms: list[str], limit: int) -> DataFrame:
    """(path, line, score) of lines of (path, text) that contain a term, the best first: 4 for each term
    among the line's words, 3 for each among the path's, 12 more for a definition, 8 less in tests,
    unless tests are asked for. Ties go by path and line."""
    low = [t.lower() for t in dict.fromkeys(terms)]
    lines = files.select("path", F.posexplode(F.split("text", r"\r\n|\r|\n")).alias("line", "content"))
    matched = lines.where(reduce(lambda a, b: a | b, (F.contains(F.lower("content"), F.lit(t)) for t in low)))
    asked = F.array(*[F.lit(t) for t in low])
    shared = lambda c: F.size(F.array_intersect(T.identifier_tokens(F.col(c)), asked))
    defines = F.lower("content").rlike(r"^\s*(?:async\s+)?(?:def|class|function|export)\b")
    in_tests = F.contains(F.concat(F.lit("/"), F.lower("path")), F.lit("/test")) & F.lit(not {"test", "tests"} & set(low))
    score = 4 * shared("content") + 3 * shared("path") + F.when(defines, 12).otherwise(0) - F.when(in_tests, 8).otherwise(0)
    return matched.select("path", (F.col("line") + 1).alias("line"), score.alias("score")).orderBy(F.desc("score"), F.lower("path"), "path", "line").limit(limit)
