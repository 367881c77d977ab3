"""Shared plumbing of the training-data operators: texts as bytes, hashes of words and ids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scratch import discard, materialise  # noqa: F401

#: bytes.translate table that lower-cases A-Z and leaves everything else alone.
ASCII_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

#: As ASCII_LOWER, and turns every ASCII byte that is neither a letter nor a digit into a space.
ALNUM_OR_SPACE = bytes(
    b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in ASCII_LOWER
)

#: The white space that separates words, as a Java regular expression.
SPACE_CLASS = r"[\x20\x09-\x0D]"


def texts_as_bytes(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 bytes of each text without decoding it; a null counts as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    for value in column.cast(kind):
        yield value.as_py() or b""


M1, M2, M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers after which each bit depends on all."""
    x = (x ^ (x >> np.uint64(30))) * M2
    x = (x ^ (x >> np.uint64(27))) * M3
    return x ^ (x >> np.uint64(31))


class _WordHashes(dict):
    """64-bit hash of each word, held up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_word_hashes = _WordHashes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_word_hashes.__getitem__, words), np.uint64, len(words))


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """64-bit hash of each window of `width` hashed words; other widths have other hashes."""
    n = max(0, len(words) - width + 1)
    acc = np.full(n, width, np.uint64)
    for i in range(width):
        acc = mix((acc + words[i : n + i]) * M1)
    return acc


def crc_bucket(doc_id: Column | str, n: int) -> Column:
    """crc32 of the id written as text, modulo n; a null id counts as the empty text."""
    id_ = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return (F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")) % n).cast("int")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
