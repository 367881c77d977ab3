"""Token-ID output: documents are tokenised, split without loss and packed into fixed-length rows.

Each document's ids end with the end-of-text id. A document longer than a row is cut into full rows
and a rest; rests are packed by best-fit decreasing: longest first, each into the row with the least
room that still holds it, found in a segment tree over capacities. Each row comes with cumulative
segment lengths and with positions that start again at 0 in every segment.

Distribution: documents are dealt out by a hash of id and text into groups of about `shard_tokens`
tokens (at four bytes each), so rows follow from the data and not from how the input is split. In a
group, in order of id, rests are gathered up to `shard_tokens` tokens, packed and given out, so memory
is bounded and only a group's last rows may be part-filled. `write_matrices` writes binary matrices through Spark's committed writer.

Defined cases: null and empty texts are the end-of-text id alone; repeated rows are packed each;
a null doc_id stays null; no documents give no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
END_OF_TEXT = 50256
ROW_TOKENS = 2048
SHARD_TOKENS = 4_000_000

#: The white space of the tokenizer's pattern (Unicode's White_Space, which unlike
#: Python's has no U+001C to U+001F), as the inside of a character class.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

#: White space before a word goes with it, one blank at most; longer runs stand alone. The
#: tokenizer's own pattern never crosses these bounds, so pieces can be encoded one by one. It gives
#: a run of white space out whole, so a run is merged at once without the pattern, whose backtracking
#: has no room for runs of a million.
_PIECE = re.compile(f" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
_ALL_SPACE = re.compile(f"[{_SPACE}]+")


#: Longer pieces are encoded each time, so that the table of pieces has a bounded size.
_HELD_CHARS = 100


class _Pieces(dict):
    """Ids of each piece as bytes of uint16, held up to a bound."""

    def __init__(self, path: str):
        super().__init__()
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.tokenizer = tiktoken.Encoding(
            path.rpartition("/")[2], pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )

    def encoded(self, piece: str) -> list[int]:
        if _ALL_SPACE.fullmatch(piece):
            return self.tokenizer._encode_single_piece(piece)
        return self.tokenizer.encode_ordinary(piece)

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(self.encoded(piece), np.uint16).tobytes()
        if len(piece) <= _HELD_CHARS:
            if len(self) > 400_000:
                self.clear()
            self[piece] = ids
        return ids


@lru_cache(maxsize=2)
def _pieces(path: str) -> _Pieces:
    return _Pieces(path)


def token_ids(text: str | None, path: str = VOCABULARY, end: int = END_OF_TEXT) -> np.ndarray:
    """Ids of a whole text and the end-of-text id."""
    spelled = b"".join(map(_pieces(path).__getitem__, _PIECE.findall(text or "")))
    return np.frombuffer(spelled + end.to_bytes(2, "little"), np.uint16)


class Capacities:
    """A segment tree over capacities 0..top: how many open rows have just that much room."""

    def __init__(self, top: int):
        self.leaves = 1
        while self.leaves <= top:
            self.leaves *= 2
        self.count = [0] * (2 * self.leaves)

    def add(self, capacity: int, n: int = 1) -> None:
        at = capacity + self.leaves
        while at:
            self.count[at] += n
            at //= 2

    def least_from(self, need: int) -> int | None:
        """The least capacity of at least `need` that some row has."""
        at = need + self.leaves
        if self.count[at]:
            return need
        while at > 1:
            if at % 2 == 0 and self.count[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.count[2 * at] else 2 * at + 1
                return at - self.leaves
            at //= 2
        return None


def best_fit_decreasing(lengths: list[int], top: int) -> list[list[int]]:
    """Rows as lists of places in `lengths`; each row's lengths add up to at most top."""
    tree, open_rows, rows = Capacities(top), [[] for _ in range(top + 1)], []
    for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        room = tree.least_from(lengths[k])
        if room is None:
            row = len(rows)
            rows.append([])
            room = top
        else:
            row = open_rows[room].pop()
            tree.add(room, -1)
        rows[row].append(k)
        rest = room - lengths[k]
        if rest:
            open_rows[rest].append(row)
            tree.add(rest)
    return rows


PACKED = (
    "first_doc long, first_offset long, n_tokens int, n_segments int, ids binary, positions binary, "
    "cu_seqlens array<int>, doc_ids array<long>, offsets array<long>"
)


def _pack(path: str, end: int, top: int, shard: int):
    def row(segments: list[tuple]) -> tuple:
        """segments: (doc_id, offset, ids)."""
        lengths = [len(s[2]) for s in segments]
        used = sum(lengths)
        ids = np.full(top, end, np.uint16)
        ids[:used] = np.concatenate([s[2] for s in segments])
        positions = np.zeros(top, np.uint16)
        positions[:used] = np.concatenate([np.arange(n, dtype=np.uint16) for n in lengths])
        return (
            segments[0][0], segments[0][1], used, len(segments), ids.tobytes(), positions.tobytes(),
            [0, *np.cumsum(lengths).tolist()], [s[0] for s in segments], [s[1] for s in segments],
        )

    kinds = [
        pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int32()),
        pa.list_(pa.int64()), pa.list_(pa.int64()),
    ]
    names = [part.split()[0] for part in PACKED.split(", ")]

    def given_out(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rests: list[tuple] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            rows = best_fit_decreasing([len(r[2]) for r in rests], top)
            for at in range(0, len(rows), 1024):
                yield given_out([row([rests[k] for k in r]) for r in rows[at : at + 1024]])

        for batch in batches:
            full: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = token_ids(text.as_py(), path, end)
                cut = len(ids) - len(ids) % top
                full.extend(row([(doc_id, at, ids[at : at + top])]) for at in range(0, cut, top))
                if len(ids) > cut:
                    rests.append((doc_id, cut, ids[cut:]))
                    size += len(ids) - cut
                if len(full) >= 1024:
                    yield given_out(full)
                    full = []
                if size >= shard:
                    yield from flush()
                    rests, size = [], 0
            if full:
                yield given_out(full)
        if rests:
            yield from flush()

    return packed


def pack_documents(
    docs: DataFrame,
    row_tokens: int = ROW_TOKENS,
    shard_tokens: int = SHARD_TOKENS,
    vocabulary: str = VOCABULARY,
    end_of_text: int = END_OF_TEXT,
    text: str = "text",
) -> DataFrame:
    """PACKED: one record a row of the matrices. ids and positions are little-endian uint16 of
    row_tokens places, filled up with end_of_text and 0; (first_doc, first_offset) names a row."""
    if not 0 < row_tokens <= 1 << 16:
        raise ValueError("row_tokens must be from 1 to 65536, as positions are uint16")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length(F.col("text").cast("binary"))), F.lit(0))).first()[0]
    groups = max(1, -(-int(size) // (4 * shard_tokens)))
    dealt = F.xxhash64("doc_id", "text")
    rows = rows.repartition(groups, dealt).sortWithinPartitions("doc_id", dealt)
    return rows.mapInArrow(_pack(vocabulary, end_of_text, row_tokens, shard_tokens), PACKED)


def write_matrices(packed: DataFrame, path: str, rows_a_file: int = 4096) -> None:
    """Writes rows as Parquet with binary matrix rows; a file holds rows_a_file rows at most, and
    Spark's committer leaves whole files only, whatever executors are lost."""
    packed.write.option("maxRecordsPerFile", rows_a_file).mode("errorifexists").parquet(path)


def read_matrices(rows: list, row_tokens: int = ROW_TOKENS) -> tuple[np.ndarray, np.ndarray]:
    """Collected rows of PACKED as two matrices: ids and positions."""
    ids = np.frombuffer(b"".join(bytes(r["ids"]) for r in rows), "<u2").reshape(-1, row_tokens)
    positions = np.frombuffer(b"".join(bytes(r["positions"]) for r in rows), "<u2").reshape(-1, row_tokens)
    return ids, positions
