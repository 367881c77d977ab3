"""Benchmark decontamination by greedy string tiling.

A document and a benchmark item that share a seed (a run of `tile` tokens) are tiled: by running
Karp-Rabin the longest common run of unmarked tokens is found and marked, again and again down to
runs of `tile` tokens, so that tiles never overlap and may stand in any order. An item's coverage is
the share of its tokens under tiles; a document whose coverage of some item reaches the threshold is
contaminated, also if it has the item's passages in another order. So is one that has a run of
`passage` tokens of an item, however long the item is. An item with fewer than `tile` tokens is its
own seed: a document that holds it whole is contaminated.

1. Seeds of all items are a table; a Bloom filter of them, of at most FILTER_BITS bits whatever the
   benchmark, is all that goes to every executor.
2. Documents are read once against the filter; a row goes on for each distinct seed of a text that
   may be an item's, and is joined with the table of seeds, which gives (text, item) pairs.
3. Texts of those pairs alone, copies once, meet their items by key and are tiled; one text at a time
   is in memory.
4. What was found returns to the documents by a join on the text's hash.

Neither items nor documents are gathered anywhere, and only texts that share a seed with an item are
shuffled. Tokens are runs of letters, digits and non-ASCII characters of the lower-cased text.

Defined cases: null and empty texts are clean; an item without tokens matches nothing; equal items
count each; repeated documents each get a row; an empty benchmark leaves all documents clean; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ALNUM_OR_SPACE, M2, materialise, mix, window_hashes, word_hashes

TILE = 5
COVERAGE = 0.6
#: Tokens in a row that contaminate a document whatever the item's length.
PASSAGE = 13
#: Most bits of the filter of seeds (16 MB), its bits for each seed below that, and probes for one.
FILTER_BITS, BITS_A_SEED, PROBES = 1 << 27, 32, 4

#: Primes and bases of the running hashes: products of two residues fit in 62 bits.
_FIELDS = ((2_147_483_629, 1_000_003), (2_147_483_587, 69_621))


def tokens_of(text: str) -> np.ndarray:
    """64-bit hashes of a text's tokens."""
    return word_hashes(text.lower().encode("utf-8", "surrogatepass").translate(ALNUM_OR_SPACE).split())


# --- tiling ---------------------------------------------------------------------------------------


@lru_cache(maxsize=64)
def _powers_to(doublings: int, prime: int, base: int) -> np.ndarray:
    out = np.ones(1, np.int64)
    for k in range(doublings):
        out = np.concatenate([out, out * pow(base, 1 << k, prime) % prime])
    return out


class _Running:
    """Karp-Rabin hashes of all windows of any one length, from running sums over the tokens.

    `span` is not below the length of any sequence that hashes are compared with."""

    def __init__(self, tokens: np.ndarray, span: int):
        self.n, self.fields = len(tokens), []
        for prime, base in _FIELDS:
            powers = _powers_to(span.bit_length(), prime, base)
            terms = (tokens % np.uint64(prime)).astype(np.int64) * powers[: self.n] % prime
            sums = np.concatenate([np.zeros(1, np.int64), np.cumsum(terms)])
            self.fields.append((prime, sums, powers[span - np.arange(self.n)]))

    def windows(self, starts: np.ndarray, length: int) -> np.ndarray:
        one, two = (
            (sums[starts + length] - sums[starts]) % prime * align[starts] % prime for prime, sums, align in self.fields
        )
        return one << 31 | two


def _free_ahead(free: np.ndarray) -> np.ndarray:
    """How many unmarked tokens follow in a row, from each place on."""
    n = len(free)
    stop = np.where(free, n, np.arange(n))
    return np.minimum.accumulate(stop[::-1])[::-1] - np.arange(n)


def tiles(item, doc, least: int, doc_free: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (start in item, start in doc, length), the longest first; of equally
    long matches those that start first in the item, then in the document.

    The search length only falls: each round finds the greatest length at which a window of unmarked
    tokens is common, by halving, and marks what matches at that length. So rounds are as many as
    tiles have different lengths, and a round is linear but for sorting, however repetitive the texts."""
    item, doc = np.asarray(item, np.uint64), np.asarray(doc, np.uint64)
    span = max(len(item), len(doc))
    free = [np.ones(len(item), bool), np.ones(len(doc), bool) if doc_free is None else doc_free.copy()]
    running = _Running(item, span), _Running(doc, span)
    found: list[tuple[int, int, int]] = []

    def common(length: int):
        """Starts in the item and in the doc of unmarked windows, and the keys of those of both."""
        starts = [np.flatnonzero(a >= length) for a in ahead]
        keys = [r.windows(s, length) for r, s in zip(running, starts, strict=True)]
        both = [np.isin(keys[0], keys[1]), None]
        if not both[0].any():
            return None
        both[1] = np.isin(keys[1], keys[0])
        return [(s[b], k[b]) for s, k, b in zip(starts, keys, both, strict=True)]

    longest = min(len(item), len(doc))
    while longest >= least:
        ahead = [_free_ahead(f) for f in free]
        low, high, hit = least - 1, min(longest, *(int(a.max(initial=0)) for a in ahead)), None
        length = high
        while low < high:
            now = common(length)
            if now is None:
                high = length - 1
            else:
                low, hit = length, now
            length = (low + high + 1) // 2
        if hit is None:
            break
        (item_at, item_keys), (doc_at, doc_keys) = hit
        order = np.argsort(doc_keys, kind="stable")
        doc_at, doc_keys = doc_at[order], doc_keys[order]
        # Of each key, the next window of the document to look at: a marked one stays marked.
        upto = np.searchsorted(doc_keys, item_keys, "right").tolist()
        first = dict(zip(item_keys.tolist(), np.searchsorted(doc_keys, item_keys).tolist(), strict=True))
        for i, key, end in zip(item_at.tolist(), item_keys.tolist(), upto, strict=True):
            if not free[0][i] or not free[0][i + low - 1]:
                continue
            at = first[key]
            while at < end:
                j = int(doc_at[at])
                # No tile of this round is shorter, so a window is unmarked if its ends are.
                if free[1][j] and free[1][j + low - 1] and np.array_equal(item[i : i + low], doc[j : j + low]):
                    free[0][i : i + low] = free[1][j : j + low] = False
                    found.append((i, j, low))
                    break
                at += 1
            first[key] = at
        longest = low - 1
    return found


def overlap(item: np.ndarray, doc: np.ndarray, tile: int) -> tuple[float, int]:
    """The share of an item's tokens under tiles, and the longest run, of hashed tokens."""
    width = min(tile, len(item))
    if not width:
        return 0.0, 0
    shared = np.flatnonzero(np.isin(window_hashes(doc, width), window_hashes(item, width)))
    if not len(shared):
        return 0.0, 0
    # Only tokens of a shared seed can lie under a tile; a marked place keeps the rest apart.
    under = np.unique((shared[:, None] + np.arange(width)).ravel())
    gaps = np.flatnonzero(np.diff(under) > 1) + 1
    near = np.insert(doc[under], gaps, 0)
    free = np.insert(np.ones(len(under), bool), gaps, False)
    lengths = [n for _, _, n in tiles(item, near, width, free)]
    return sum(lengths) / len(item), max(lengths, default=0)


# --- seeds ----------------------------------------------------------------------------------------


def _places(hashes: np.ndarray, probe: int, bits: int) -> np.ndarray:
    """The filter's place of each hash under one of its probes; bits: the logarithm of its size."""
    return (mix(hashes + np.uint64(probe * int(M2) % (1 << 64))) >> np.uint64(64 - bits)).astype(np.int64)


def _item_seeds(tile: int):
    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = tokens_of(text or "")
                width = min(tile, len(words))
                found = np.unique(window_hashes(words, width)) if width else np.zeros(0, np.uint64)
                for at in range(0, len(found), 100_000):
                    part = found[at : at + 100_000].view(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(part), key)), pa.array(np.full(len(part), width, np.int32)), pa.array(part)],
                        names=["item", "width", "seed"],
                    )

    return seeds


def _seed_places(bits: int):
    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seeds = batch.column(0).to_numpy().view(np.uint64)
            for probe in range(PROBES):
                # Bitmap functions count places from 1.
                yield pa.RecordBatch.from_arrays([pa.array(_places(seeds, probe, bits) + 1)], names=["place"])

    return places


def seed_filter(seeds: DataFrame) -> tuple[np.ndarray, int]:
    """A Bloom filter of the seeds as bytes, and the logarithm of its size in bits. What reaches the
    driver are its pages, together at most FILTER_BITS."""
    count = seeds.count()
    bits = min(FILTER_BITS, max(1 << 15, count * BITS_A_SEED)).bit_length() - 1
    pages = seeds.select("seed").mapInArrow(_seed_places(bits), "place long")
    pages = pages.groupBy(F.bitmap_bucket_number("place").alias("page")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bitmap")
    )
    out = np.zeros((1 << bits) // 8, np.uint8)
    for row in pages.toLocalIterator():
        page = np.frombuffer(bytes(row["bitmap"]), np.uint8)
        at = (row["page"] - 1) * len(page)
        out[at : at + len(page)] = page[: len(out) - at]
    return out, bits


def _text_seeds(widths: list[int], held, bits: int):
    """Distinct seeds of each text that pass the filter."""

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value
        for batch in batches:
            ones, twos, texts = (batch.column(k).to_pylist() for k in range(3))
            rows, hits = [], []
            for k, text in enumerate(texts):
                words = tokens_of(text or "")
                for width in widths:
                    left = window_hashes(words, width)
                    for probe in range(PROBES):
                        if not len(left):
                            break
                        at = _places(left, probe, bits)
                        left = left[known[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1]
                    if len(left):
                        left = np.unique(left)
                        rows += [k] * len(left)
                        hits.append(left)
            if hits:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ones[k] for k in rows], pa.int64()), pa.array([twos[k] for k in rows], pa.int64()),
                     pa.array(np.concatenate(hits).view(np.int64))],
                    names=["one", "two", "seed"],
                )

    return seeds


def _tiled(tile: int):
    """Rows sorted by text, each text before the items that it meets."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = words = None
        for batch in batches:
            out: list[tuple] = []
            for one, two, is_item, item_id, times, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not is_item:
                    key, words = (one, two), tokens_of(text or "")
                elif key == (one, two):
                    out.append((one, two, item_id, times, *overlap(tokens_of(text or ""), words, tile)))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)],
                    names=["one", "two", "item_id", "times", "coverage", "longest"],
                )

    return rows


# --- the operator ---------------------------------------------------------------------------------


def _text_key(text: Column) -> tuple[Column, Column]:
    """128 bits that stand for a text; copies have the same."""
    return F.xxhash64(text), F.xxhash64(F.lit(1), text)


def found_overlaps(docs: DataFrame, benchmark: DataFrame, tile: int = TILE, text: str = "text") -> DataFrame:
    """(one, two, item_id, times, coverage, longest) for each distinct text and item that share a seed;
    (one, two) is the text's key and times says how often the benchmark has the item."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").alias("text"))
    items = items.groupBy("item_id", "text").agg(F.count(F.lit(1)).alias("times"))
    items = materialise(items.select(F.xxhash64("item_id", "text").alias("item"), "item_id", "times", "text"), "items")
    seeds = materialise(items.select("item", "text").mapInArrow(_item_seeds(tile), "item long, width int, seed long"), "seeds")
    widths = sorted(r["width"] for r in seeds.select("width").distinct().collect())  # at most `tile` of them
    bitmap, bits = seed_filter(seeds)
    held = spark.sparkContext.broadcast(bitmap)
    one, two = _text_key(F.col(text))
    texts = docs.select(one.alias("one"), two.alias("two"), F.col(text).alias("text"))
    hits = texts.mapInArrow(_text_seeds(widths, held, bits), "one long, two long, seed long")
    pairs = materialise(hits.join(seeds.select("item", "seed"), "seed").select("one", "two", "item").distinct(), "pairs")
    asked = texts.join(pairs.select("one", "two").distinct(), ["one", "two"], "left_semi").dropDuplicates(["one", "two"])
    none = F.lit(None).cast("bigint")
    met = asked.select("one", "two", F.lit(0).alias("is_item"), none.alias("item_id"), none.alias("times"), "text").unionByName(
        pairs.join(items, "item").select("one", "two", F.lit(1).alias("is_item"), "item_id", "times", "text")
    )
    dealt = met.repartition("one", "two").sortWithinPartitions("one", "two", "is_item")
    return materialise(
        dealt.mapInArrow(_tiled(tile), "one long, two long, item_id long, times long, coverage double, longest long"), "overlaps"
    )


def _over(threshold: float, passage: int) -> Column:
    return (F.col("coverage") >= threshold) | (F.col("longest") >= passage)


def contamination(
    docs: DataFrame, benchmark: DataFrame, threshold: float = COVERAGE, tile: int = TILE, text: str = "text",
    passage: int = PASSAGE,
) -> DataFrame:
    """doc_id, contaminated, n_items, item_ids (that contaminate it) and max_coverage."""
    over = _over(threshold, passage)
    by_text = found_overlaps(docs, benchmark, tile, text).groupBy("one", "two").agg(
        F.sum(F.when(over, F.col("times")).otherwise(0)).alias("n_items"),
        F.array_sort(F.collect_set(F.when(over, F.col("item_id")))).alias("item_ids"),
        F.max("coverage").alias("max_coverage"),
    )
    one, two = _text_key(F.col(text))
    rows = docs.select(F.col("doc_id").alias("doc_id"), one.alias("one"), two.alias("two")).join(by_text, ["one", "two"], "left")
    n_items = F.coalesce("n_items", F.lit(0)).cast("bigint")
    return rows.select(
        "doc_id",
        (n_items > 0).alias("contaminated"),
        n_items.alias("n_items"),
        F.coalesce("item_ids", F.array().cast("array<bigint>")).alias("item_ids"),
        F.coalesce("max_coverage", F.lit(0.0)).alias("max_coverage"),
    )


def without_contaminated(
    docs: DataFrame, benchmark: DataFrame, threshold: float = COVERAGE, tile: int = TILE, text: str = "text",
    passage: int = PASSAGE,
) -> DataFrame:
    """The clean rows of docs with all their columns."""
    found = found_overlaps(docs, benchmark, tile, text).where(_over(threshold, passage))
    bad = found.select(F.col("one").alias("_one"), F.col("two").alias("_two")).distinct()
    one, two = _text_key(docs[text])
    return docs.join(bad, (one == F.col("_one")) & (two == F.col("_two")), "left_anti")
