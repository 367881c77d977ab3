"""Language ID by rank-order profiles: a document's most frequent n-grams against each language's,
by out-of-place distance.

N-grams are one to three characters of the lower-cased text, in which every run of characters that
are no letters is one blank; n-grams with a blank inside are left out. A profile is the list of the
`size` most frequent ones, by count and then by code. The distance to a language adds, over the
document's profile, how far each n-gram is out of place (size if it is absent).

Distribution: training counts n-grams within a partition, sums them by (language, n-gram) in Spark
and ranks them there; what reaches the driver is size rows a language, and the number of languages
is checked. Prediction is a projection. Whole texts are used throughout.

Defined cases: a null text or one without a letter is `und` with score 0; rows without a language
take no part in training; ties between languages go to the first in order of name; without any
profile every document is `und`; repeated rows each get a row; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import crc_bucket, materialise

UNDETERMINED = "und"
SIZE = 300
#: Languages that a model may hold; beyond it, the profiles would be no small side any more.
MAX_LANGUAGES = 5000


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """By code point: itself if it is a letter, else a blank."""
    table = np.full(0x110000, 32, np.uint32)
    found = [c for c in range(0x110000) if chr(c).isalpha()]
    table[found] = found
    return table


def ngrams(text: str) -> np.ndarray:
    """Codes of all n-grams of a text, 21 bits a character."""
    codes = _letters()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 32) | (codes[:-1] != 32)
    codes = np.concatenate(([32], codes[keep], [32])).astype(np.uint64)
    blank = codes == 32
    two = codes[:-1] << np.uint64(21) | codes[1:]
    three = two[:-1] << np.uint64(21) | codes[2:]
    return np.concatenate((codes[~blank], two[~(blank[:-1] & blank[1:])], three[~blank[1:-1]]))


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(ngrams(text), return_counts=True)


def ranked(keys: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent keys; keys come ascending, so a stable sort settles ties by code."""
    return keys[np.argsort(-counts, kind="stable")[:size]]


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([c for _, c in parts]), len(keys)).astype(np.int64)


def _count_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list] = defaultdict(list)
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            held[lang].append(counted(text))
            if len(held[lang]) >= 256:
                held[lang] = [_merge(held[lang])]
    for lang, parts in held.items():
        keys, counts = _merge(parts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(counts)],
            names=["lang", "gram", "n"],
        )


def train(docs: DataFrame, size: int = SIZE, text: str = "text", lang: str = "lang") -> dict[str, np.ndarray]:
    """Each language's profile, from all rows of docs that have a language and a text."""
    rows = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where(
        F.col("lang").isNotNull() & F.col("text").isNotNull()
    )
    sums = rows.mapInArrow(_count_partition, "lang string, gram long, n long").groupBy("lang", "gram").agg(
        F.sum("n").alias("n")
    )
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    best = materialise(sums.withColumn("rank", rank).where(F.col("rank") <= size), "profiles")
    if best.select("lang").distinct().count() > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    profiles: dict[str, list] = defaultdict(list)
    for row in best.orderBy("lang", "rank").toLocalIterator():
        profiles[row["lang"]].append(row["gram"])
    return {name: np.array(grams, np.uint64) for name, grams in profiles.items()}


class Profiles:
    """The profiles as one table: a row for each known n-gram, a column for each language."""

    def __init__(self, profiles: dict[str, np.ndarray], size: int = SIZE):
        self.size, self.names = size, sorted(profiles)
        every = [profiles[name] for name in self.names]
        self.keys = np.unique(np.concatenate(every)) if every else np.zeros(0, np.uint64)
        self.ranks = np.full((len(self.keys) + 1, len(self.names)), -1, np.int32)
        for k, grams in enumerate(every):
            self.ranks[np.searchsorted(self.keys, grams), k] = np.arange(len(grams))

    def distances(self, top: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, top)
        known = self.keys[np.minimum(at, len(self.keys) - 1)] == top
        ranks = self.ranks[np.where(known, at, len(self.keys))]
        return np.where(ranks < 0, self.size, np.abs(ranks - np.arange(len(top))[:, None])).sum(0)

    def predict(self, text: str | None) -> tuple[str, float]:
        """The nearest language and 1 less its distance as a share of the largest possible one."""
        if not text or not self.names:
            return UNDETERMINED, 0.0
        keys, counts = counted(text)
        if not len(keys):
            return UNDETERMINED, 0.0
        top = ranked(keys, counts, self.size)
        far = self.distances(top)
        k = int(far.argmin())
        return self.names[k], float(1 - far[k] / (self.size * len(top)))


def predict(text: Column | str, profiles: Profiles) -> Column:
    """struct(lang, score) of a text column."""

    @F.arrow_udf("struct<lang:string,score:double>")
    def predicted(texts: pa.Array) -> pa.Array:
        found = [profiles.predict(t) for t in texts.to_pylist()]
        return pa.StructArray.from_arrays(
            [pa.array([x for x, _ in found], pa.string()), pa.array([y for _, y in found], pa.float64())],
            names=["lang", "score"],
        )

    return predicted(text)


def training_rows(docs: DataFrame, folds: int = 4, held_out: int = 2) -> DataFrame:
    return docs.where(crc_bucket("doc_id", folds) != held_out)


def identify(docs: DataFrame, size: int = SIZE, text: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred and score, one row for each row of docs."""
    profiles = Profiles(train(training_rows(docs), size, text), size)
    return docs.select(
        F.col("doc_id").alias("doc_id"),
        (crc_bucket("doc_id", 4) == 2).alias("held_out"),
        predict(F.col(text), profiles).alias("p"),
    ).select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), "p.score")
