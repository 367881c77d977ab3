"""SentencePiece encoding and decoding by a shared-prefix Viterbi search.

Text is marked as the model marks it (a blank before the text, blanks for the mark) and falls into
marked words, which no piece of the model crosses. The distinct words of a batch are sorted, which
lays out their trie; walking it depth-first means walking the sorted words, and each word keeps the
forward scores of the prefix that it shares with the one before and searches only the rest.

The forward step depends on the kind of model:

* unigram: the classic one, best[j] = max over pieces w[i:j] of best[i] + score.
* BPE: merge ranks are no additive scores, so a plain sum would not give the model's own ids. But
  a prefix of a word has exactly one last token, and a piece can follow it only if merging the two
  gives the two back. So best[j] is the one piece whose join with the token ending at i holds.
  Scores of pairs are cached; ids equal those of the model's own library.

Characters outside the vocabulary become byte pieces. A literal mark (U+2581) in a text is one of
them, so that decoding gives back the text exactly; the library would turn it into a blank.

Distribution: a projection without shuffle; memory is bounded by a batch of rows and a word cache
of fixed size. Defined cases: null and empty texts have no ids and decode to the empty text;
repeated rows each get a row; other columns are ignored. The model file's path is a parameter.
"""

from __future__ import annotations

import hashlib
import os.path
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, BYTE = 1, 2, 6

_WORD = re.compile(" *[^ ]+| +")
#: Below a word's best score by this much, as the library has it for characters without a piece.
_UNKNOWN_PENALTY = 10.0
#: Ids gathered at a time when the words of texts are put together.
_GATHER = 1 << 20


class _Places(dict):
    """Numbers keys in order of their first look-up."""

    def __missing__(self, key: str) -> int:
        place = self[key] = len(self)
        return place


class Codec:
    """A model file's vocabulary and the search over it."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        self.kind = model.trainer_spec.model_type
        norm = model.normalizer_spec
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError(f"{os.path.basename(path)}: neither a unigram nor a BPE model")
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix:
            raise ValueError(f"{os.path.basename(path)}: its normalizer changes texts, which can't be undone")
        self.pieces: list[bytes] = []
        self.ids: dict[str, int] = {}
        self.scores: list[float] = []
        self.byte_ids = [-1] * 256
        self.unknown_id = 0
        for i, p in enumerate(model.pieces):
            self.scores.append(p.score)
            self.pieces.append(p.piece.replace(MARK, " ").encode())
            if p.type == NORMAL:
                self.ids[p.piece.replace(MARK, " ")] = i
            elif p.type == BYTE:
                value = int(p.piece[3:5], 16)
                self.byte_ids[value] = i
                self.pieces[-1] = bytes([value])
            elif p.type == UNKNOWN:
                self.unknown_id = i
            else:
                self.pieces[-1] = b""
        if min(self.byte_ids) < 0:
            raise ValueError(f"{os.path.basename(path)}: no byte pieces, so some texts can't be encoded")
        self.whole = any(re.search("[^ ] ", piece) for piece in self.ids)
        self.unknown_score = min((self.scores[i] for i in self.ids.values()), default=0.0) - _UNKNOWN_PENALTY
        # Pieces backwards, to find all that end at a place: node = {character: node}, "" its id.
        self.backwards: dict = {}
        for piece, i in self.ids.items():
            node = self.backwards
            for c in reversed(piece):
                node = node.setdefault(c, {})
            node[""] = i
        self.text_of = {i: piece for piece, i in self.ids.items()}
        self.joins: dict[tuple[int, int], bool] = {}

    def words(self, text: str) -> list[str]:
        if not text:
            return []
        return [" " + text] if self.whole else _WORD.findall(" " + text)

    def merged(self, text: str) -> list[str]:
        """BPE by its definition: of all neighbours that join to a piece the best-scored, leftmost first."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.scores[i] > best):
                    best, at = self.scores[i], k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def joined(self, left: int, right: int) -> bool:
        """Whether token `right` can follow `left` (-1: a word's start or a character without piece)."""
        held = self.joins.get((left, right))
        if held is None:
            b = self.text_of[right]
            if left < 0:
                held = len(self.merged(b)) == 1
            else:
                a = self.text_of[left]
                held = self.merged(a + b) == [a, b]
            if len(self.joins) > 4_000_000:
                self.joins.clear()
            self.joins[left, right] = held
        return held

    def encode_sorted(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of ascending distinct words, end to end, and each word's number of ids."""
        forward = self._forward_bpe if self.kind == BPE else self._forward_unigram
        ids: list[int] = []
        counts: list[int] = []
        # By place in the word: best score, the piece that ends there (-1: none), where that begins.
        score, piece, start = [0.0], [-1], [0]
        previous = ""
        for word in words:
            shared = 0
            for a, b in zip(previous, word, strict=False):
                if a != b:
                    break
                shared += 1
            if shared < len(previous):
                del score[shared + 1 :], piece[shared + 1 :], start[shared + 1 :]
            forward(word, shared, score, piece, start)
            back, at = [], len(word)
            while at > 0:
                if piece[at] >= 0:
                    back.append(piece[at])
                else:
                    back.extend(self.byte_ids[b] for b in reversed(word[at - 1].encode("utf-8", "surrogatepass")))
                at = start[at]
            back.reverse()
            ids += back
            counts.append(len(back))
            previous = word
        return np.array(ids, np.int32), np.array(counts, np.int64)

    def _forward_unigram(self, word: str, shared: int, score: list, piece: list, start: list) -> None:
        for j in range(shared + 1, len(word) + 1):
            node, i, best, of, begin = self.backwards, j, None, -1, j - 1
            while i > 0 and (node := node.get(word[i - 1])) is not None:
                i -= 1
                if (t := node.get("")) is not None and (best is None or score[i] + self.scores[t] >= best):
                    best, of, begin = score[i] + self.scores[t], t, i
            if word[j - 1] not in self.ids:
                alone = score[j - 1] + self.unknown_score
                if best is None or alone > best:
                    best, of, begin = alone, -1, j - 1
            score.append(best)
            piece.append(of)
            start.append(begin)

    def _forward_bpe(self, word: str, shared: int, score: list, piece: list, start: list) -> None:
        backwards, joins = self.backwards, self.joins
        for j in range(shared + 1, len(word) + 1):
            node, i, of = backwards, j, -1
            while i:
                i -= 1
                node = node.get(word[i])
                if node is None:
                    break
                if "" in node:
                    t = node[""]
                    held = joins.get((piece[i], t))
                    if held is None:
                        held = self.joined(piece[i], t)
                    if held:
                        of = t
                        break
            piece.append(of)
            start.append(i if of >= 0 else j - 1)

    def encode_texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """Ids of the texts, end to end; the places (one more than texts) where each begins; words of each."""
        place = _Places()
        spelled: list[np.ndarray] = []
        for text in texts:
            found = self.words(text)
            spelled.append(np.fromiter(map(place.__getitem__, found), np.int32, len(found)))
        words = sorted(place)
        flat, counts = self.encode_sorted(words)
        begins = np.cumsum(counts) - counts
        order = np.array([place[w] for w in words], np.int64)
        begin_of, count_of = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        begin_of[order], count_of[order] = begins, counts
        sizes = np.array([int(count_of[s].sum()) if len(s) else 0 for s in spelled], np.int64)
        bounds = np.concatenate(([0], np.cumsum(sizes)))
        out = np.empty(int(bounds[-1]), np.int32)
        for k, s in enumerate(spelled):
            for a in range(0, len(s), _GATHER // 8):
                part = s[a : a + _GATHER // 8]
                n = count_of[part]
                ends = np.cumsum(n)
                at = int(bounds[k]) + (int(count_of[s[:a]].sum()) if a else 0)
                out[at : at + int(ends[-1])] = flat[np.repeat(begin_of[part] - (ends - n), n) + np.arange(ends[-1])]
        return out, bounds, [len(s) for s in spelled]

    def decode(self, ids) -> str:
        text = b"".join(map(self.pieces.__getitem__, ids))
        return (text[1:] if text[:1] == b" " else text).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)


def _strings(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def encode(text: Column | str, model: str = MODEL) -> Column:
    """Ids of a text as an array of int."""

    @F.arrow_udf("array<int>")
    def encoded(texts: pa.Array) -> pa.Array:
        ids, bounds, _ = codec(model).encode_texts(_strings(texts))
        return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids))

    return encoded(text)


def decode(ids: Column | str, model: str = MODEL) -> Column:
    """The text that an array of ids stands for; null gives the empty text."""

    @F.arrow_udf("string")
    def decoded(rows: pa.Array) -> pa.Array:
        return pa.array([codec(model).decode(x or ()) for x in rows.to_pylist()], pa.string())

    return decoded(ids)


def round_trip(text: Column | str, model: str = MODEL) -> Column:
    """struct(ids, decoded_sha256, exact): encoded, decoded again and compared, in one pass."""

    @F.arrow_udf("struct<ids:array<int>,n_words:bigint,decoded_sha256:string,exact:boolean>")
    def both(texts: pa.Array) -> pa.Array:
        c, given = codec(model), _strings(texts)
        ids, bounds, n_words = c.encode_texts(given)
        back = [c.decode(ids[bounds[k] : bounds[k + 1]].tolist()) for k in range(len(given))]
        return pa.StructArray.from_arrays(
            [
                pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids)),
                pa.array(n_words, pa.int64()),
                pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in back], pa.string()),
                pa.array([a == b for a, b in zip(given, back, strict=True)], pa.bool_()),
            ],
            names=["ids", "n_words", "decoded_sha256", "exact"],
        )

    return both(text)


def encode_documents(docs: DataFrame, model: str = MODEL, text: str = "text") -> DataFrame:
    """doc_id, n_words, n_tokens, ids, decoded_sha256 and exact, one row for each row of docs."""
    r = docs.select(F.col("doc_id").alias("doc_id"), round_trip(F.col(text), model).alias("r"))
    return r.select(
        "doc_id",
        "r.n_words",
        F.size("r.ids").cast("bigint").alias("n_tokens"),
        "r.ids",
        "r.decoded_sha256",
        "r.exact",
    )
