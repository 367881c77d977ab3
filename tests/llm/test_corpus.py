"""Operators that relate documents to each other or to what they learn, against brute force."""

import importlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import components, ctw_lm, minhash_dedup
from loomgraph.llm.components import connected_components
from loomgraph.llm.minhash_dedup import Settings

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return (text or "").translate(LOWER).encode().split()


def near_texts(rng):
    """Singles, exact copies, chains of near copies, empty and short texts."""
    word = lambda: "w" + str(rng.randint(0, 5000))
    texts = [" ".join(word() for _ in range(rng.randint(3, 60))) for _ in range(60)]
    base = [word() for _ in range(80)]
    for _ in range(70):
        copy = list(base)
        for _ in range(rng.randint(0, 3)):
            copy[rng.randrange(80)] = word()
        texts.append(" ".join(copy))
        if rng.random() < 0.3:
            base = copy
    texts += [None, "", "  ", "a", "A", "a b", "a b", "a  B", texts[0], texts[0].upper(), texts[5] + "\n"]
    rng.shuffle(texts)
    return texts


def brute_components(texts, k, percent):
    sets = []
    for t in texts:
        w = split(t)
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set()))
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [(len(sets[i]), find(i)) for i in range(len(texts))]


@pytest.mark.parametrize(
    "settings", [Settings(shingle=3, percent=85, bands=32, rows=6), Settings(), Settings(block_docs=8), Settings(bands=64, rows=1, block_docs=8)]
)
def test_near_duplicates(spark, settings, monkeypatch):
    """Also with small blocks, with ties that chain unlike documents, and with hubs dealt out."""
    monkeypatch.setattr(components, "HOT_ROWS", 5 if settings.block_docs == 8 else 1000)
    texts = near_texts(random.Random(7))
    docs = spark.createDataFrame([(k, t, 1, "x") for k, t in enumerate(texts)], "doc_id long, text string, n long, component_id string")
    got = {r.doc_id: r for r in minhash_dedup.near_duplicates(docs, settings).collect()}
    want = brute_components(texts, settings.shingle, settings.percent)
    assert [(got[k].n_shingles, got[k].component_id) for k in range(len(texts))] == want
    assert all(got[k].kept == (c == k) for k, (_, c) in enumerate(want))
    assert settings.missed_by_bands() < 1e-5


def test_near_duplicates_odd_tables(spark):
    schema = "doc_id long, text string"
    assert minhash_dedup.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    long = " ".join(f"w{i}" for i in range(3000))
    rows = [(None, long), (None, "x"), (3, long), (3, long), (2, long + " z"), (5, "a b c d e f g"), (5, long), (9, "a b c d e f g"), (7, None)]
    docs = spark.createDataFrame(rows, schema)
    got = {r.doc_id: (r.component_id, r.kept) for r in minhash_dedup.near_duplicates(docs).collect()}
    assert got == {None: (None, True), 3: (2, False), 2: (2, True), 5: (2, False), 9: (2, False), 7: (7, True)}
    kept = minhash_dedup.keep_one_of_each(docs)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 2), (False, 7), (True, 0), (True, 0)]


def test_bayesian_bounds():
    steps = minhash_dedup.least_matches(85, 32, 192, 1e-6)
    assert steps[-1][0] == 192
    for h, m in steps:
        tail = lambda m, h=h: sum(math.comb(h + 1, i) * 0.85**i * 0.15 ** (h + 1 - i) for i in range(m + 1))
        assert tail(m) >= 1e-6 and (m == 0 or tail(m - 1) < 1e-6)


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    errors = []
    for share in (0.2, 0.5, 0.8, 0.9):
        for _ in range(20):
            n = 400
            both = rng.integers(0, 2**63, int(n * share), np.int64).astype(np.uint64)
            a, b = (np.unique(np.concatenate((both, rng.integers(0, 2**63, n - len(both), np.int64).astype(np.uint64)))) for _ in range(2))
            exact = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            errors.append(np.mean(minhash_dedup.signature(a, 192) == minhash_dedup.signature(b, 192)) - exact)
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.045


def test_connected_components(spark, monkeypatch):
    rng = random.Random(8)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 460)] + [(5, 5)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for u, v in edges:
        a, b = sorted((find(u), find(v)))
        root[b] = a
    edges += [(500, 600 + k) for k in range(50)] + [(700 + k, 650) for k in range(50)]
    for u, v in edges[-100:]:
        a, b = sorted((find(u), find(v)))
        root[b] = a
    monkeypatch.setattr(components, "HOT_ROWS", 10)
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def brute_ctw(trained, text):
    """Plain recursion over counts kept by (bit node, context)."""
    counts = Counter()
    for raw in trained:
        padded = b"\0\0" + raw
        for k in range(2, len(padded)):
            node = 1
            for bit in f"{padded[k]:08b}":
                for d in range(3):
                    counts[node, padded[k - d : k], int(bit)] += 1
                node = node * 2 + int(bit)

    def kt(node, context):
        a, b = counts[node, context, 0], counts[node, context, 1]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1) if a + b else 0.0

    children = {}
    for node, context, _ in list(counts):
        if context:
            children.setdefault((node, context[1:]), set()).add(context)

    def weighted(node, context):
        if len(context) == 2:
            return kt(node, context)
        below = sum(weighted(node, c) for c in children.get((node, context), ()))
        a, b = kt(node, context), below
        return math.log(0.5) + max(a, b) + math.log1p(math.exp(-abs(a - b)))

    def one(node, context):
        a, b = counts[node, context, 0], counts[node, context, 1]
        return (b + 0.5) / (a + b + 1)

    total, padded = 0.0, b"\0\0" + text
    for k in range(2, len(padded)):
        node = 1
        for bit in f"{padded[k]:08b}":
            p = one(node, padded[k - 2 : k])
            for d in (1, 0):
                context = padded[k - d : k]
                stop = math.exp(math.log(0.5) + kt(node, context) - weighted(node, context))
                p = stop * one(node, context) + (1 - stop) * p
            total += math.log10(p if bit == "1" else 1 - p)
            node = node * 2 + int(bit)
    return total


@pytest.mark.parametrize("block_words", [40, ctw_lm.BLOCK_WORDS])
def test_lm_scoring(spark, block_words):
    rng = random.Random(12)
    syllables = ["an", "the", "re", "é", "io", "X"]
    texts = ["".join(rng.choice(syllables) + rng.choice(["", " ", "\n"]) for _ in range(rng.randint(1, 40))) for _ in range(30)]
    texts += [None, "", "THE the", "\x00\xff", "long " * 500]
    rows = [(k, t, 1.5) for k, t in enumerate(texts)] + [(0, texts[0], 1.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double").repartition(3)
    frame = ctw_lm.score_corpus(docs, ctw_lm.fold_is(5, 1), block_words=block_words)
    found = frame.collect()
    assert len(found) == len(rows)
    got = {r.doc_id: r for r in found}
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    train = [t for k, t, _ in rows if not held(k)]
    counts = Counter(w for t in train for w in [*split(t), b" "])
    n, v = sum(counts.values()), len(counts)
    raw = [(t or "").encode() for t in train]
    for k, t in enumerate(texts):
        tokens = [*split(t), b" "]
        r = got[k]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(k), len(tokens), sum(counts[w] > 0 for w in tokens), n)
        assert abs(r.base_score - sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens)) < 1e-8
        if len(t or "") < 120:
            assert abs(r.score - brute_ctw(raw, (t or "").encode())) < 1e-6
    assert ctw_lm.score_corpus(docs.limit(0), ctw_lm.fold_is(5, 1)).count() == 0


def brute_deep_ctw(trained, text, depth):
    """As brute_ctw, to any depth; log10 of the probability."""
    counts, children = Counter(), {}
    for raw in trained:
        padded = b"\0" * depth + raw
        for k in range(depth, len(padded)):
            for j in range(8):
                node, bit = (256 | padded[k]) >> (8 - j), padded[k] >> (7 - j) & 1
                for d in range(depth + 1):
                    counts[node, padded[k - d : k], bit] += 1
                    if d:
                        children.setdefault((node, padded[k - d + 1 : k]), set()).add(padded[k - d : k])
    weights = {}

    def kt(node, context):
        a, b = counts[node, context, 0], counts[node, context, 1]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1) if a + b else 0.0

    def weighted(node, context):
        if (node, context) not in weights:
            own = kt(node, context)
            if len(context) < depth:
                own = np.logaddexp(own, sum(weighted(node, c) for c in children.get((node, context), ()))) + math.log(0.5)
            weights[node, context] = own
        return weights[node, context]

    def one(node, context):
        a, b = counts[node, context, 0], counts[node, context, 1]
        return (b + 0.5) / (a + b + 1)

    total, padded = 0.0, b"\0" * depth + text
    for k in range(depth, len(padded)):
        for j in range(8):
            node, bit = (256 | padded[k]) >> (8 - j), padded[k] >> (7 - j) & 1
            p = one(node, padded[k - depth : k])
            for d in range(depth - 1, -1, -1):
                context = padded[k - d : k]
                stop = math.exp(math.log(0.5) + kt(node, context) - weighted(node, context))
                p = stop * one(node, context) + (1 - stop) * p
            total += math.log10(p if bit else 1 - p)
    return total


@pytest.mark.parametrize("depth", [3, 4, 5, 6])
def test_lm_scoring_deeper(spark, depth, monkeypatch):
    # One three-byte context a run, so that runs are cut.
    monkeypatch.setattr(ctw_lm.gram_scores, "__defaults__", (1,))
    rng = random.Random(depth)
    texts = ["".join(rng.choice(["an", "the ", "re", "é", "io\n"]) for _ in range(rng.randint(1, 25))) for _ in range(25)]
    texts += [None, "", "\x00\xff", "never seen"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    train = [(t or "").encode() for k, t in enumerate(texts) if zlib.crc32(str(k).encode()) % 5 != 1]
    found = ctw_lm.score_corpus(docs, ctw_lm.fold_is(5, 1), block_words=9, depth=depth).collect()
    assert len(found) == len(texts)
    for r in found:
        assert abs(r.score - brute_deep_ctw(train, (texts[r.doc_id] or "").encode(), depth)) < 1e-6


def test_registered_lm_scoring_is_deep(spark):
    """The registered query mixes all depths to four bytes."""
    from loomgraph.llm import queries

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    deep = {r.doc_id: r.score for r in ctw_lm.score_corpus(docs, ctw_lm.fold_is(5, 1), depth=4).collect()}
    for r in queries.op9_ctw_lm_scoring(spark, sf).collect():
        assert abs(r.score - deep[r.doc_id]) < 1e-6 * (1 - r.score)


def test_untrained_model_is_uniform():
    tree = ctw_lm.Tree(np.zeros(0, np.int64), np.zeros(0, np.int64))
    assert abs(tree.score(b"ab") - 2 * math.log10(1 / 256)) < 1e-9
    trained = ctw_lm.Tree(*np.unique(ctw_lm.grams_of(b"abracadabra" * 9), return_counts=True))
    assert np.allclose((10**trained.table).sum(1), 1)


def test_pipeline_stages(spark, tmp_path):
    pipeline = importlib.import_module("corpus_pipeline")
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("score", F.lit("x"))
    columns = docs.columns
    for k, (_, stage) in enumerate(pipeline.STAGES):
        before = docs
        docs = stage(spark, docs, sf)
        docs.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        n, was = docs.count(), before.count()
        assert 0 < n <= was
        if k < len(pipeline.STAGES) - 1:
            assert docs.columns == columns and docs.join(before, columns, "left_anti").count() == 0
        if k == 2:
            kept = [r.text for r in docs.collect()]
            pool = [r.text for r in before.collect()]
            want = brute_components(pool, 5, 80)
            assert n == len({c for _, c in want}) and len(brute_components(kept, 5, 80)) == len({c for _, c in brute_components(kept, 5, 80)})
    assert docs.where("NOT exact").count() == 0 and docs.count() == n
    empty = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0
