"""MinHash near-dedup with sequential Bayesian verification.

1. Each text becomes its set of word shingles (64-bit hashes). Texts with equal sets form one
   class, represented by its smallest doc_id, so exact copies cost nothing further.
2. Each class representative gets a MinHash signature and one key for each band of it. A band's
   bucket is never gathered: each member is tied to the bucket's smallest member, found by a grouped
   minimum. So a bucket of any size gives as many ties as it has members.
3. Ties are joined to candidate groups (connected components). Every pair that shares a bucket lies
   inside one group, and groups only bound the search: they decide nothing.
4. Inside a group, representatives are searched breadth-first: one is compared with all that are
   not linked yet, first by batches of signature values. After each batch a pair is dropped once
   its posterior probability (uniform prior) of reaching the similarity falls below the chosen miss
   probability; survivors are verified exactly on their full sets. What is given out is a link for
   each newly linked member, never pairs.
5. A large group is cut into blocks, so no task holds more than two of them. First each block is
   searched by itself; then every block meets PIVOTS documents, of the largest components that blocks
   have; that mostly leaves one component and few documents outside it. Any link still missing has an
   end among those, and its ends share a bucket. So they are the query set: in parts, they meet the
   documents that share a bucket with one of the part, by block. Where ties chain many unlike
   documents to one group, that is as many as share buckets and not the whole group.
6. Links are joined to the final components.

Distribution: the shuffles carry band keys (8 bytes each), and then the texts of those documents
alone that share a band with another. Every stage is written to the shared folder.

Defined cases: null and empty texts have an empty set and are linked with nothing; with fewer words
than a shingle the whole sequence is the one shingle; rows that repeat a doc_id are one document
whose component is that of any of its texts; rows with a null doc_id count in
no link, give one row with a null component, and are kept; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import groupby, islice
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ASCII_LOWER, M1, materialise, mix, texts_as_bytes, window_hashes, word_hashes
from .components import connected_components, join_by_key

#: Documents of a large group that each of its blocks is compared with before any others.
PIVOTS = 16

@dataclass(frozen=True)
class Settings:
    """similarity is `percent` of 100; bands * rows values in a signature."""

    shingle: int = 5
    percent: int = 80
    bands: int = 32
    rows: int = 5
    batch: int = 32
    miss: float = 1e-6
    block_docs: int = 2048
    block_bytes: int = 1 << 24

    @property
    def hashes(self) -> int:
        return self.bands * self.rows

    def missed_by_bands(self) -> float:
        """Probability that a pair just at the similarity shares no band."""
        return (1 - (self.percent / 100) ** self.rows) ** self.bands


def shingle_set(raw: bytes, k: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text; words are what white space separates."""
    words = raw.translate(ASCII_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    return np.unique(window_hashes(word_hashes(words), min(k, len(words))))


@lru_cache(maxsize=4)
def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(0, 1 << 32, n, np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, n, np.uint32)


def signature(shingles: np.ndarray, n: int) -> np.ndarray:
    """MinHash values: the least of each of n permutations of the (already mixed) hashes."""
    a, b = _coefficients(n)
    low = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    out = np.full(n, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(low), 2048):
        x = low[None, at : at + 2048] * a[:, None] + b[:, None]
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        np.minimum(out, x.min(1), out=out)
    return out


def band_keys(sig: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key a band, different between bands."""
    rows = sig.reshape(bands, -1).astype(np.uint64)
    acc = np.arange(1, bands + 1, dtype=np.uint64) * M1
    for column in rows.T:
        acc = mix((acc + column) * M1)
    return acc.view(np.int64)


def _sketch(s: Settings) -> callable:
    @F.arrow_udf("struct<n:bigint,same:binary,keys:array<bigint>>")
    def sketch(texts: pa.Array) -> pa.Array:
        n, same, keys = [], [], []
        for raw in texts_as_bytes(texts):
            shingles = shingle_set(raw, s.shingle)
            n.append(len(shingles))
            same.append(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None)
            keys.append(band_keys(signature(shingles, s.hashes), s.bands) if len(shingles) else None)
        return pa.StructArray.from_arrays(
            [pa.array(n, pa.int64()), pa.array(same, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
            names=["n", "same", "keys"],
        )

    return sketch


@lru_cache(maxsize=8)
def least_matches(percent: int, batch: int, hashes: int, miss: float) -> tuple[tuple[int, int], ...]:
    """After each batch: (values seen, least matches with which a pair goes on).

    With a uniform prior, m matches in h values leave the similarity Beta(m+1, h-m+1), so the
    probability that it reaches t is that of at most m successes in h+1 trials of chance t.
    """
    t = percent / 100
    out = []
    for h in [*range(batch, hashes, batch), hashes]:
        tail, m = 0.0, 0
        while m <= h:
            tail += comb(h + 1, m) * t**m * (1 - t) ** (h + 1 - m)
            if tail >= miss:
                break
            m += 1
        out.append((h, m))
    return tuple(out)


def exact_intersections(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of one sorted set with each of the others (none empty)."""
    flat = np.concatenate(others)
    at = np.minimum(np.searchsorted(one, flat), len(one) - 1)
    starts = np.cumsum([0] + [len(o) for o in others[:-1]])
    return np.add.reduceat((one[at] == flat).astype(np.int64), starts)


def link_block(ids: np.ndarray, sets: list[np.ndarray], s: Settings) -> Iterator[tuple[int, int]]:
    """Links (id, an id of its component) that join just what is linked among these documents."""
    sigs = np.stack([signature(x, s.hashes) for x in sets])
    sizes = np.array([len(x) for x in sets])
    steps = least_matches(s.percent, s.batch, s.hashes, s.miss)
    left = np.argsort(ids, kind="stable")
    while len(left):
        root, left = left[0], left[1:]
        queue = [root]
        while queue and len(left):
            i = queue.pop()
            # A set much smaller or larger cannot reach the similarity.
            low, high = np.minimum(sizes[left], sizes[i]), np.maximum(sizes[left], sizes[i])
            on = np.flatnonzero(100 * low >= s.percent * high)
            matches, done = np.zeros(len(on), np.int64), 0
            for h, least in steps:
                if not len(on):
                    break
                matches += (sigs[left[on], done:h] == sigs[i, done:h]).sum(1)
                go = matches >= least
                on, matches, done = on[go], matches[go], h
            if not len(on):
                continue
            shared = exact_intersections(sets[i], [sets[j] for j in left[on]])
            union = sizes[i] + sizes[left[on]] - shared
            hit = on[100 * shared >= s.percent * union]
            if len(hit):
                for j in left[hit]:
                    yield int(ids[j]), int(ids[root])
                queue.extend(left[hit])
                left = np.delete(left, hit)


def _link_blocks(s: Settings):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(
                zip(*(batch.column(k).to_pylist() for k in ("grp", "a", "b")), strict=True),
                batch.column("doc_id").to_pylist(),
                texts_as_bytes(batch.column("text")),
                strict=True,
            )

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links() -> Iterator[tuple[int, int]]:
            for _, members in groupby(rows(batches), key=lambda r: r[0]):
                # A repeated row counts once; a doc_id with several texts is there with each.
                found = {(doc_id, hash(raw)): shingle_set(raw, s.shingle) for _, doc_id, raw in members}
                yield from link_block(np.array([d for d, _ in found], np.int64), list(found.values()), s)

        every = links()
        while part := list(islice(every, 65536)):
            u, v = zip(*part, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return linked


def _links_within(tasks: DataFrame, rows: DataFrame, s: Settings) -> DataFrame:
    """Links among the documents of each task; tasks: (doc_id, grp, a, b)."""
    texts = tasks.distinct().join(rows, "doc_id").select("doc_id", "grp", "a", "b", "text")
    dealt = texts.repartition("grp", "a", "b").sortWithinPartitions("grp", "a", "b")
    return materialise(dealt.mapInArrow(_link_blocks(s), "u long, v long"), "links")


def _all_links(placed: DataFrame, keyed: DataFrame, rows: DataFrame, s: Settings) -> DataFrame:
    """Links that join all that is linked within groups; placed: (doc_id, grp, blocks, own), keyed:
    (doc_id, key) with the buckets of each document."""
    links = _links_within(placed.select("doc_id", "grp", F.col("own").alias("a"), F.col("own").alias("b")), rows, s)
    large = placed.where("blocks > 1")
    if large.isEmpty():
        return links

    def with_root(links: DataFrame) -> DataFrame:
        found = connected_components(links).withColumnRenamed("node", "doc_id")
        return materialise(large.join(found, "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id")), "roots")

    def largest(rooted: DataFrame, *keys: str) -> DataFrame:
        sizes = rooted.groupBy(*keys, "root").agg(F.count(F.lit(1)).alias("n"))
        return sizes.groupBy(*keys).agg(
            F.max_by("root", F.struct("n", -F.col("root"))).alias("pivot"), F.max("n").alias("n")
        )

    rooted = with_root(links)
    first = F.row_number().over(W.partitionBy("grp").orderBy(F.desc("n"), "pivot"))
    pivots = largest(rooted, "grp", "own").withColumn("k", first).where(F.col("k") <= PIVOTS).select("grp", F.col("pivot").alias("doc_id"))
    places = large.select("grp", F.col("own").alias("a")).distinct()
    shown = pivots.join(places, "grp").unionByName(large.select("grp", "doc_id", F.col("own").alias("a")))
    links = links.unionByName(_links_within(shown.select("doc_id", "grp", "a", F.col("a").alias("b")), rows, s))
    rooted = with_root(links)
    most = largest(rooted, "grp").select("grp", "pivot")
    outside = materialise(rooted.join(most, "grp").where("root <> pivot").select("doc_id", "grp", "blocks"), "outside")
    if outside.isEmpty():
        return links
    count = outside.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / s.block_docs).cast("int").alias("parts"))
    asking = outside.join(count, "grp").select(
        "doc_id", "grp", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col("parts")).cast("int").alias("a")
    )
    # Whoever shares a bucket with a document of a part meets the part; a part's own documents go to
    # each block in which there is such a document.
    part_keys = asking.join(keyed, "doc_id").select("key", "grp", "a").distinct()
    mates = keyed.join(part_keys, "key").select("doc_id", "grp", "a").distinct()
    mates = materialise(mates.join(large.select("doc_id", F.col("own").alias("b")), "doc_id").select("doc_id", "grp", "a", "b"), "mates")
    asked = asking.join(mates.select("grp", "a", "b").distinct(), ["grp", "a"]).select("doc_id", "grp", "a", "b")
    return links.unionByName(_links_within(asked.unionByName(mates), rows, s))


def near_duplicates(docs: DataFrame, settings: Settings | None = None, text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept (doc_id = component_id), one row a document."""
    s = settings or Settings()
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    sketches = materialise(
        rows.select("doc_id", _sketch(s)("text").alias("x")).select("doc_id", "x.n", "x.same", "x.keys"), "sketches"
    )
    named = sketches.where(F.col("doc_id").isNotNull() & F.col("same").isNotNull())
    # Equal sets have equal keys; the smallest doc_id stands for them. Copies combine before the shuffle.
    classes = materialise(
        named.groupBy("same").agg(
            F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("keys").alias("keys")
        ),
        "classes",
    )
    keyed = classes.select(F.col("rep").alias("doc_id"), F.explode("keys").alias("key")).distinct()
    buckets = keyed.groupBy("key").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    ties = join_by_key(keyed, buckets, "key", "doc_id", classes.count() * s.bands).where(F.col("doc_id") != F.col("first"))
    groups = connected_components(ties.select(F.col("doc_id").alias("u"), F.col("first").alias("v")))
    members = groups.select("node", "root").unionByName(
        groups.select(F.col("root").alias("node"), "root").distinct()
    )
    sized = materialise(
        members.join(classes.groupBy(F.col("rep").alias("node")).agg(F.sum("n").alias("shingles")), "node"), "members"
    )
    weight = sized.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum("shingles").alias("total"))
    blocks = F.greatest(
        F.ceil(F.col("n") / s.block_docs), F.ceil(F.col("total") * 8 / s.block_bytes), F.lit(1)
    ).cast("int")
    placed = join_by_key(sized, weight, "root", "node", sized.count()).select(
        F.col("node").alias("doc_id"), F.col("root").alias("grp"), blocks.alias("blocks")
    ).withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    placed = materialise(placed, "placed")
    links = _all_links(placed, keyed, rows.where(F.col("doc_id").isNotNull()), s)
    # A doc_id that stands in several rows with unlike texts ties the classes of those texts.
    several = named.groupBy("doc_id").agg(F.min("same").alias("x"), F.max("same").alias("y")).where("x != y")
    extra = (
        named.join(several.select("doc_id"), "doc_id", "left_semi")
        .select("doc_id", "same")
        .distinct()
        .join(classes.select("same", "rep"), "same")
    )
    linked = links.unionByName(extra.select(F.col("doc_id").alias("u"), F.col("rep").alias("v")))
    final = connected_components(linked)
    by_class = classes.join(final, classes["rep"] == final["node"], "left").select(
        "same", F.coalesce("root", "rep").alias("component_id")
    )
    of_named = F.when(F.col("doc_id").isNotNull(), F.col("same")).alias("same")
    per_row = sketches.select("doc_id", "n", of_named).join(by_class, "same", "left")
    return per_row.groupBy("doc_id").agg(
        F.max("n").alias("n_shingles"), F.min(F.coalesce("component_id", "doc_id")).alias("component_id")
    ).select("*", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one_of_each(docs: DataFrame, settings: Settings | None = None, text: str = "text") -> DataFrame:
    """The rows of docs whose document stands for its component, with all their columns."""
    dropped = near_duplicates(docs, settings, text).where(~F.col("kept")).select(F.col("doc_id").alias("_dropped"))
    return docs.join(dropped, docs["doc_id"] == F.col("_dropped"), "left_anti")
