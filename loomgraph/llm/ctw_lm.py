"""LM scoring by context-tree weighting over bytes, beside a unigram base score.

Model. Each byte is coded bit by bit (a binary tree of 255 nodes), and each node has a context tree
over the preceding bytes, of depth 0 to `depth` (2 to 6). A context keeps how often its node saw 0 and 1 and
estimates with Krichevsky-Trofimov; a context's weighted probability is half its own block
probability plus half the product of its children's. Learned weights then mix the estimates of all
depths into one probability for each bit, and a text's score is the sum over its bytes: log10 of
its probability, and its code length per byte. A text starts in the context of `depth` zero bytes.

A byte's log-probability depends on its gram alone: the byte and the `depth` bytes before it. Depths
0 to 2 have a proven size (at most 65,792 rows of 256 numbers; a row only for contexts that occur),
so their table may go to every executor. Deeper contexts grow with the corpus and stay distributed:
counts of grams are dealt out by their three nearest context bytes, each of which has all deeper
contexts under it (at most 2^16 grams at depth 4 and 2^24 at depth 5, whatever the corpus). A first pass weights them
upwards and sends up one sum for each node of a two-byte context; a second mixes downwards.

Counts. A word's or gram's count has to meet every document that has it, and neither side is
bounded. So documents are written in blocks of a few million words; each block asks once for each of
its distinct words and grams; counts are summed and joined by word and gram; and the answers go back
to their block, where they meet its documents again. What is shuffled is a row for each distinct word
or gram of a block, not for each of a document, and no task holds more than one block.

Distribution: hot words and grams combine before the shuffle (a row a block); blocks are bounded by words.
Defined cases: a null or empty text has the end token alone and a score of 0; a text without
training documents is scored by the untrained model; repeated rows each get a row and each count in
training; a null doc_id stays null and counts as the empty text in the split; other columns are
ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, crc_bucket, materialise, texts_as_bytes

#: Words in a block at most, but for a last document that goes beyond.
BLOCK_WORDS = 3_000_000
#: Context bytes of the registered query.
DEPTH = 4
#: The end token: no word has a blank.
END = b" "

#: Bytes of text that are packed together at most, but for a last document that goes beyond.
PACK_BYTES = 4_000_000

PARTS = "kind int, block long, packed binary, word binary, n long, gram long"
_PARTS = pa.schema(
    [
        ("kind", pa.int32()), ("block", pa.int64()), ("packed", pa.binary()), ("word", pa.binary()),
        ("n", pa.int64()), ("gram", pa.int64()),
    ]
)
DOCUMENT, WORD, GRAM = 0, 1, 2
_DOCUMENTS = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("text", pa.binary())])


# --- the model ------------------------------------------------------------------------------------


def grams_of(raw: bytes, depth: int = 2) -> np.ndarray:
    """For each byte, its predecessors, the nearest first, and itself as one number."""
    b = np.frombuffer(b"\0" * depth + raw, np.uint8).astype(np.int64)
    out = b[depth:].copy()
    for d in range(1, depth + 1):
        out |= b[depth - d : len(b) - d] << (8 * (depth - d + 1))
    return out


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after moving x up by 8, good to about 1e-13 for x > 0."""
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    z = x + 8
    w = 1 / (z * z)
    series = (1 / 12 - w * (1 / 360 - w * (1 / 1260 - w * (1 / 1680 - w / 1188)))) / z
    return (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + series - shift


def node_counts(bytes_seen: np.ndarray) -> np.ndarray:
    """From counts of next bytes [..., 256] to counts of the binary tree's places [..., 512]: node q
    has children 2q (bit 0) and 2q+1 (bit 1), and bytes are the leaves 256 to 511."""
    tree = np.zeros((*bytes_seen.shape[:-1], 512))
    tree[..., 256:] = bytes_seen
    for q in range(255, 0, -1):
        tree[..., q] = tree[..., 2 * q] + tree[..., 2 * q + 1]
    return tree


def log_kt(tree: np.ndarray) -> np.ndarray:
    """Log block probability by Krichevsky-Trofimov of each node's zeros and ones [..., 256]."""
    out = log_kt_of(tree[..., 0::2], tree[..., 1::2])
    out[..., 0] = 0.0
    return out


def log_kt_of(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    out = log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - np.log(np.pi) - log_gamma(zeros + ones + 1)
    return np.where(zeros + ones > 0, out, 0.0)


_HALF = np.log(0.5)


class Tree:
    """Depths 0 to 2, from counts of three-byte grams. Without deeper contexts: log10 probabilities of
    the next byte by context. With them (`below`: contexts, nodes and sums of the log weights under
    them): at each node a one has probability add + times * (what depth 3 gives)."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, below: tuple | None = None):
        order = np.argsort(grams)
        grams, counts = grams[order].astype(np.int64), counts[order].astype(float)
        contexts = np.unique(grams >> 8)
        by_one = np.zeros((256, 256))
        np.add.at(by_one, (grams >> 16, grams & 255), counts)
        tree1, tree0 = node_counts(by_one), node_counts(by_one.sum(0))
        kt1, kt0 = log_kt(tree1), log_kt(tree0)
        bounds = np.searchsorted(grams >> 8, contexts)
        bounds = np.append(bounds, len(grams))
        # Contexts of two bytes by their nearer byte: one group at a time is in memory as trees.
        under = [np.flatnonzero((contexts >> 8) == c) for c in range(256)]
        trees2 = lambda c: node_counts(self._bytes(grams, counts, bounds, under[c]))
        below1 = np.zeros((256, 256))
        if below is not None:
            below2 = np.zeros((len(contexts), 256))
            known = np.isin(below[0], contexts)
            np.add.at(below2, (np.searchsorted(contexts, below[0][known]), below[1][known]), below[2][known])
        for c in range(256):
            if len(under[c]):
                log_w2 = log_kt(trees2(c))
                if below is not None:
                    log_w2 = np.logaddexp(_HALF + log_w2, _HALF + below2[under[c]])
                below1[c] = log_w2.sum(0)
        log_w1 = np.logaddexp(_HALF + kt1, _HALF + below1)
        log_w0 = np.logaddexp(_HALF + kt0, _HALF + log_w1.sum(0))
        stop1, stop0 = np.exp(_HALF + kt1 - log_w1), np.exp(_HALF + kt0 - log_w0)
        one0, one1 = self._ones(tree0), self._ones(tree1)
        # Row r of the table: a context that occurs, then one row for each nearer byte without one.
        self.row_of = np.empty(65536, np.int32)
        self.row_of[:] = len(contexts) + (np.arange(65536) >> 8)
        self.row_of[contexts] = np.arange(len(contexts))
        self.table = np.empty((len(contexts) + 256, 256))
        self.times = None if below is None else np.empty_like(self.table)
        for c in range(256):
            rows = np.append(under[c], len(contexts) + c)
            one2, stop2 = np.full((len(rows), 256), 0.5), 1.0
            if below is not None:
                stop2 = np.full((len(rows), 256), 0.5)
            if len(under[c]):
                tree2 = trees2(c)
                one2[:-1] = self._ones(tree2)
                if below is not None:
                    kt2 = _HALF + log_kt(tree2)
                    stop2[:-1] = np.exp(kt2 - np.logaddexp(kt2, _HALF + below2[under[c]]))
            ones = stop0 * one0 + (1 - stop0) * (stop1[c] * one1[c] + (1 - stop1[c]) * stop2 * one2)
            if below is None:
                self.table[rows] = self._bytes_from_bits(ones)
            else:
                self.table[rows] = ones
                self.times[rows] = (1 - stop0) * (1 - stop1[c]) * (1 - stop2)

    @staticmethod
    def _bytes(grams, counts, bounds, rows) -> np.ndarray:
        out = np.zeros((len(rows), 256))
        for k, r in enumerate(rows):
            part = slice(bounds[r], bounds[r + 1])
            out[k, grams[part] & 255] = counts[part]
        return out

    @staticmethod
    def _ones(tree: np.ndarray) -> np.ndarray:
        """Estimate of a one at each node [..., 256]."""
        zeros, ones = tree[..., 0::2], tree[..., 1::2]
        zeros, ones = zeros.copy(), ones.copy()
        zeros[..., 0] = ones[..., 0] = 0
        return (ones + 0.5) / (zeros + ones + 1)

    @staticmethod
    def _bytes_from_bits(ones: np.ndarray) -> np.ndarray:
        """Log10 probability of each byte from the probability of a one at each node."""
        log = np.zeros((*ones.shape[:-1], 512))
        for q in range(1, 256):
            log[..., 2 * q] = log[..., q] + np.log10(1 - ones[..., q])
            log[..., 2 * q + 1] = log[..., q] + np.log10(ones[..., q])
        return log[..., 256:]

    def score(self, raw: bytes) -> float:
        """Log10 of the probability of these bytes."""
        g = grams_of(raw)
        return float(self.table.ravel()[self.row_of[g >> 8].astype(np.int64) * 256 + (g & 255)].sum())


def deep_contexts(grams: np.ndarray, counts: np.ndarray, depth: int, tree: Tree | None = None):
    """Depths 3 to `depth` of whole three-byte contexts, from sorted distinct grams. Without the tree
    above: (contexts of two bytes, nodes, sums of log weights under them). With it: the log10
    probability of each gram. A gram with count 0 is only asked for."""
    # Grams without their farther bytes, by depth; where each gram is among them, and the next depth.
    keys, at, up = {depth: grams}, {depth: np.arange(len(grams))}, {}
    for d in range(depth - 1, 2, -1):
        shorter = keys[d + 1] >> 16 << 8 | keys[d + 1] & 255
        keys[d], up[d + 1] = np.unique(shorter, return_inverse=True)
        at[d] = up[d + 1][at[d + 1]]
    seen = {d: np.bincount(at[d], counts, len(keys[d])) for d in keys}
    out = np.zeros(len(grams))
    sums: list[tuple] = []
    for j in range(8):
        group, one, stop = {}, {}, {}
        log_w = first = None
        for d in range(depth, 2, -1):
            node = keys[d] >> (8 - j)
            new = np.append(True, node[1:] != node[:-1]) if len(node) else np.zeros(0, bool)
            group[d], firsts = np.cumsum(new) - 1, np.flatnonzero(new)
            bit = keys[d] >> (7 - j) & 1
            ones = np.bincount(group[d], seen[d] * bit, len(firsts))
            zeros = np.bincount(group[d], seen[d] * (1 - bit), len(firsts))
            one[d] = (ones + 0.5) / (zeros + ones + 1)
            kt = log_kt_of(zeros, ones)
            if d == depth:
                log_w = kt
            else:
                below = np.bincount(group[d][up[d + 1][first]], log_w, len(firsts))
                log_w = np.logaddexp(_HALF + kt, _HALF + below)
                stop[d] = np.exp(_HALF + kt - log_w)
            first = firsts
        context, node = keys[3] >> 16, 1 << j | (keys[3] & 255) >> (8 - j)
        if tree is None:
            places, to = np.unique(context[first] << 8 | node[first], return_inverse=True)
            sums.append((places >> 8, places & 255, np.bincount(to, log_w, len(places))))
            continue
        p = one[depth][group[depth]]
        for d in range(depth - 1, 2, -1):
            g = group[d][at[d]]
            p = stop[d][g] * one[d][g] + (1 - stop[d][g]) * p
        place = tree.row_of[context[at[3]]].astype(np.int64), node[at[3]]
        p = tree.table[place] + tree.times[place] * p
        out += np.log10(np.where(grams >> (7 - j) & 1, p, 1 - p))
    return out if tree is not None else tuple(np.concatenate(x) for x in zip(*sums, strict=True))


# --- what is gathered from the corpus -------------------------------------------------------------


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(ASCII_LOWER).split()


def packed(ids: list, held: list, raws: list) -> bytes:
    """Documents as one compressed value, which is less to write and to shuffle than their texts."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _DOCUMENTS, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_batch(
            pa.RecordBatch.from_arrays(
                [pa.array(x, f.type) for x, f in zip((ids, held, raws), _DOCUMENTS, strict=True)], schema=_DOCUMENTS
            )
        )
    return sink.getvalue().to_pybytes()


def _take_apart(block_words: int, depth: int):
    """Documents with their block, and for each block its distinct words and grams with their
    training counts."""

    def batch_of(kind: int, rows: int, /, **columns) -> pa.RecordBatch:
        columns["kind"] = pa.array(np.full(rows, kind, np.int32))
        return pa.RecordBatch.from_arrays(
            [columns[f.name].cast(f.type) if f.name in columns else pa.nulls(rows, f.type) for f in _PARTS], schema=_PARTS
        )

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, number = TaskContext.get(), 0
        name = lambda: task.partitionId() << 32 | number
        trained: Counter = Counter()
        other: set = set()
        size, grams = 0, []
        pending: dict[bool, list] = {True: [], False: []}
        waiting = 0

        def block_rows() -> Iterator[pa.RecordBatch]:
            words = sorted(trained.keys() | other)
            for at in range(0, len(words), 100_000):
                part = words[at : at + 100_000]
                yield batch_of(
                    WORD, len(part), block=pa.array(np.full(len(part), name())), word=pa.array(part, pa.binary()),
                    n=pa.array([trained.get(w, 0) for w in part], pa.int64()),
                )
            count()
            merge()
            keys, counts = grams.pop()
            for at in range(0, len(keys), 200_000):
                part = keys[at : at + 200_000]
                yield batch_of(
                    GRAM, len(part), block=pa.array(np.full(len(part), name())), gram=pa.array(part),
                    n=pa.array(counts[at : at + 200_000]),
                )

        def count() -> None:
            for learned, texts in pending.items():
                if texts:
                    keys, counts = np.unique(np.concatenate(texts), return_counts=True)
                    grams.append((keys, counts * learned))
                    texts.clear()

        def merge() -> None:
            keys, counts = (np.concatenate(x) for x in zip(*grams, strict=True)) if grams else (np.zeros(0, np.int64),) * 2
            order = np.argsort(keys, kind="stable")
            keys, counts = keys[order], counts[order]
            first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
            grams[:] = [(keys[first], np.add.reduceat(counts, first) if len(first) else counts)]

        for batch in batches:
            ids, held = batch.column("doc_id").to_pylist(), batch.column("held_out").to_pylist()
            raws, at, texts = [], 0, 0
            for k, raw in enumerate(texts_as_bytes(batch.column("text"))):
                raws.append(raw)
                texts += len(raw)
                words = words_of(raw)
                if held[k]:
                    other.update(words)
                    other.add(END)
                else:
                    trained.update(words)
                    trained[END] += 1
                if raw:
                    pending[not held[k]].append(grams_of(raw, depth))
                    waiting += len(raw)
                    if waiting > 1_000_000:
                        count()
                        waiting = 0
                        if sum(len(keys) for keys, _ in grams[1:]) > 1_000_000:
                            merge()
                size += len(words) + 1
                if size >= block_words or texts >= PACK_BYTES or k == len(ids) - 1:
                    yield batch_of(
                        DOCUMENT, 1, block=pa.array([name()]),
                        packed=pa.array([packed(ids[at : k + 1], held[at : k + 1], raws)], pa.binary()),
                    )
                    raws, at, texts = [], k + 1, 0
                if size >= block_words:
                    yield from block_rows()
                    trained.clear()
                    other.clear()
                    size, waiting, number = 0, 0, number + 1
        if size:
            yield from block_rows()

    return apart


def gathered(
    docs: DataFrame, held_out: Column, text: str = "text", block_words: int = BLOCK_WORDS, depth: int = 2
) -> DataFrame:
    """PARTS of a corpus, written by kind. held_out says of each row whether it is not learned from."""
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text).alias("text"), held_out.alias("held_out")
    )
    return materialise(rows.mapInArrow(_take_apart(block_words, depth), PARTS), "lm-parts", "kind")


def _by_head(depth: int, rows_at_once: int, one):
    """Rows of sorted grams in runs of whole three-byte contexts, each run given to `one`."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            held.append((batch.column("gram").to_numpy(), batch.column("n").to_numpy()))
            size += batch.num_rows
            if size >= rows_at_once:
                grams, counts = (np.concatenate(x) for x in zip(*held, strict=True))
                head = grams >> (8 * (depth - 2))
                cut = int(np.searchsorted(head, head[-1]))
                if cut:
                    yield one(grams[:cut], counts[:cut])
                held, size = [(grams[cut:], counts[cut:])], len(grams) - cut
        if size:
            yield one(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return runs


def _sums_of(depth: int):
    def one(grams: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        columns = deep_contexts(grams, counts, depth)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["context", "node", "log_w"])

    return one


def _scores_of(depth: int, tree: Tree):
    def one(grams: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        scores = deep_contexts(grams, counts, depth, tree)
        return pa.RecordBatch.from_arrays([pa.array(grams), pa.array(scores)], names=["gram", "log_p"])

    return one


def _flat_scores(tree: Tree):
    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g = batch.column("gram").to_numpy()
            scores = tree.table[tree.row_of[g >> 8], g & 255]
            yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(scores)], names=["gram", "log_p"])

    return runs


def gram_scores(parts: DataFrame, depth: int, rows_at_once: int = 400_000) -> DataFrame:
    """gram and log_p of every gram that a block asks for. At most 2^24 sums reach the driver from
    three-byte grams and from nodes of two-byte contexts, in practice some ten thousand."""
    asked = parts.where(F.col("kind") == GRAM)
    counts = materialise(asked.groupBy("gram").agg(F.sum("n").alias("n")), "lm-grams")
    short = F.shiftright("gram", 8 * (depth - 1)) * 256 + F.col("gram").bitwiseAND(255)
    top = counts.where("n > 0").groupBy(short.alias("gram")).agg(F.sum("n").alias("n")).toArrow()
    top = top.column("gram").to_numpy(), top.column("n").to_numpy()
    if depth == 2:
        return counts.mapInArrow(_flat_scores(Tree(*top)), "gram long, log_p double")
    dealt = counts.repartition(F.shiftright("gram", 8 * (depth - 2))).sortWithinPartitions("gram")
    sums = dealt.mapInArrow(
        _by_head(depth, rows_at_once, _sums_of(depth)), "context long, node long, log_w double"
    )
    below = sums.groupBy("context", "node").agg(F.sum("log_w").alias("log_w")).toArrow()
    tree = Tree(*top, tuple(below.column(c).to_numpy() for c in ("context", "node", "log_w")))
    return dealt.mapInArrow(
        _by_head(depth, rows_at_once, _scores_of(depth, tree)), "gram long, log_p double"
    )


SCORED = {
    "doc_id": pa.int64(), "held_out": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(),
    "base_score": pa.float64(), "score": pa.float64(), "n_bytes": pa.int64(),
}


def _score_blocks(depth: int, total: int, distinct: int):
    unit = total + 0.5 * (distinct + 1)

    def scored(answers: pa.Table, docs: pa.Table) -> pa.Table:
        words = answers.filter(answers.column("word").is_valid())
        place = {w: k for k, w in enumerate(words.column("word").to_pylist())}
        counts = words.column("value").to_numpy()
        known, log_of = (counts > 0).astype(np.int64), np.log10((counts + 0.5) / unit)
        grams = answers.filter(answers.column("gram").is_valid())
        keys, log_p = grams.column("gram").to_numpy(), grams.column("value").to_numpy()
        order = np.argsort(keys)
        keys, log_p = keys[order], log_p[order]
        out: dict[str, list] = {f: [] for f in SCORED}
        for value in docs.column("packed"):
            for batch in pa.ipc.open_stream(value.as_buffer()):
                out["doc_id"] += batch.column("doc_id").to_pylist()
                out["held_out"] += batch.column("held_out").to_pylist()
                for text in batch.column("text"):
                    raw = text.as_py()
                    tokens = [*words_of(raw), END]
                    at = np.fromiter(map(place.__getitem__, tokens), np.int64, len(tokens))
                    out["n_tokens"].append(len(tokens))
                    out["n_known"].append(int(known[at].sum()))
                    out["base_score"].append(float(log_of[at].sum()))
                    # In order, neighbours are found near each other.
                    found = np.searchsorted(keys, np.sort(grams_of(raw, depth)))
                    out["score"].append(float(log_p[found].sum()))
                    out["n_bytes"].append(len(raw))
        return pa.table({f: pa.array(out[f], kind) for f, kind in SCORED.items()})

    return scored


def score_corpus(
    docs: DataFrame, held_out: Column, text: str = "text", block_words: int = BLOCK_WORDS, depth: int = 2
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte."""
    if not 2 <= depth <= 6:
        raise ValueError("depth must be from 2 to 6, as a gram is one long")
    parts = gathered(docs, held_out, text, block_words, depth)
    asked = parts.where(F.col("kind") == WORD).select("block", "word", "n")
    counts = materialise(asked.groupBy("word").agg(F.sum("n").alias("c")), "lm-counts")
    total, distinct = counts.where("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    words = asked.select(F.col("block").alias("asking"), F.col("word").alias("word")).join(counts, "word")
    grams = parts.where(F.col("kind") == GRAM).select(F.col("block").alias("asking"), F.col("gram").alias("gram"))
    grams = grams.join(gram_scores(parts, depth), "gram")
    # Counts are whole in a double.
    answers = words.select("asking", "word", F.lit(None).cast("long").alias("gram"), F.col("c").cast("double").alias("value"))
    answers = answers.union(grams.select("asking", F.lit(None).cast("binary"), "gram", "log_p"))
    documents = parts.where(F.col("kind") == DOCUMENT).select(
        F.col("block").alias("of_block"), F.col("packed").alias("packed")
    )
    scores = (
        answers.groupBy("asking")
        .cogroup(documents.groupBy("of_block"))
        .applyInArrow(
            _score_blocks(depth, int(total), int(distinct)),
            "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, n_bytes long",
        )
    )
    return scores.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(int(total)).cast("bigint").alias("train_tokens"),
        "base_score", "score",
        F.when(F.col("n_bytes") > 0, -F.col("score") / F.lit(float(np.log10(2))) / F.col("n_bytes")).alias("bits_per_byte"),
    )


def fold_is(n: int, held: int) -> Column:
    return crc_bucket("doc_id", n) == held
