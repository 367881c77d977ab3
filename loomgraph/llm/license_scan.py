"""License scans: an Aho-Corasick automaton finds notice phrases and identifier tags, and a
shunting-yard parser evaluates the and/or/with expressions behind the tags.

A text is folded to its words (A-Z lower-cased; runs of ASCII letters, digits and all non-ASCII
characters), each between single blanks, so a phrase that begins and ends with a blank can only
match whole words. One pass over a text finds every phrase, overlapping ones too. The operator is
a projection: no shuffle, memory bounded by a batch of rows.

Defined cases: a null or empty text has no words, no places and score 0; repeated rows each get a
row; a null doc_id stays null; other columns are ignored; a malformed expression adds no labels but
is counted in n_bad_expressions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ALNUM_OR_SPACE, ASCII_LOWER, texts_as_bytes

#: The base phrases and their labels.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Further notice phrases of this method.
NOTICE_PHRASES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "isc license": "isc",
    "boost software license": "bsl",
    "creative commons attribution": "cc-by",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "public domain": "public-domain",
    "all rights reserved": "proprietary",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge": "mit",
}

TAG_WORDS = "spdx license identifier"
TAG = b"spdx-license-identifier"

#: How much a licence restricts, by the start of its identifier (longest first).
#: 0 permissive, 1 weak copyleft, 2 strong copyleft, 3 network copyleft, 4 restricted or unknown.
RESTRICTIVENESS = (
    ("agpl", 3), ("gpl", 2), ("lgpl", 1), ("mpl", 1), ("epl", 1), ("cddl", 1),
    ("mit", 0), ("apache", 0), ("bsd", 0), ("isc", 0), ("bsl", 0), ("zlib", 0), ("unlicense", 0),
    ("cc0", 0), ("0bsd", 0), ("public-domain", 0), ("cc-by-nc", 4), ("cc-by-nd", 4), ("cc-by-sa", 2),
    ("cc-by", 0), ("proprietary", 4),
)
UNKNOWN = 4

#: What a kind of evidence is worth.
TAG_SCORE, BASE_SCORE, NOTICE_SCORE, BAD_TAG_SCORE = 1.0, 0.9, 0.7, 0.5

_TOKEN = re.compile(rb"\s*([()]|[a-z0-9.+:-]+)")
_PRECEDENCE = {b"or": 1, b"and": 2, b"with": 3}


class BadExpression(ValueError):
    pass


@dataclass(frozen=True)
class Licence:
    """What an expression comes to: every licence in it and how much the best choice restricts."""

    labels: frozenset[str]
    restricts: int


def restrictiveness(identifier: str) -> int:
    return max(
        ((len(start), rank) for start, rank in RESTRICTIVENESS if identifier.startswith(start)), default=(0, UNKNOWN)
    )[1]


def to_postfix(expression: bytes) -> list[bytes]:
    """Shunting-yard: operands in order, operators by precedence (with, and, or), all left to right."""
    output: list[bytes] = []
    operators: list[bytes] = []
    at, operand_next = 0, True
    expression = expression.strip()
    while at < len(expression):
        match = _TOKEN.match(expression, at)
        if not match:
            raise BadExpression(expression)
        token, at = match[1], match.end()
        if token == b"(":
            if not operand_next:
                raise BadExpression(expression)
            operators.append(token)
        elif token == b")":
            while operators and operators[-1] != b"(":
                output.append(operators.pop())
            if operand_next or not operators:
                raise BadExpression(expression)
            operators.pop()
        elif token in _PRECEDENCE:
            if operand_next:
                raise BadExpression(expression)
            while operators and _PRECEDENCE.get(operators[-1], 0) >= _PRECEDENCE[token]:
                output.append(operators.pop())
            operators.append(token)
            operand_next = True
        else:
            if not operand_next:
                raise BadExpression(expression)
            output.append(token)
            operand_next = False
    if operand_next or b"(" in operators:
        raise BadExpression(expression)
    return output + operators[::-1]


def evaluate(expression: bytes) -> Licence:
    """or: the freer choice; and: the stricter one; with: an exception frees a copyleft by one."""
    stack: list[Licence] = []
    for token in to_postfix(expression):
        if token not in _PRECEDENCE:
            name = token.decode()
            stack.append(Licence(frozenset([name]), restrictiveness(name)))
            continue
        right, left = stack.pop(), stack.pop()
        if token == b"with":
            if len(right.labels) != 1:
                raise BadExpression(expression)
            rank = left.restricts - 1 if 0 < left.restricts < UNKNOWN else left.restricts
            stack.append(Licence(left.labels, rank))
        else:
            pick = min if token == b"or" else max
            stack.append(Licence(left.labels | right.labels, pick(left.restricts, right.restricts)))
    return stack[0]


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    phrases = {p: (label, 1) for p, label in NOTICE_PHRASES.items()}
    phrases |= {p: (label, 0) for p, label in BASE_PHRASES.items()}
    phrases |= {TAG_WORDS: ("", 2)}
    for phrase, (label, kind) in phrases.items():
        found.add_word(f" {phrase} ", (label, kind, len(phrase) + 2))
    found.make_automaton()
    return found


def _expressions(raw: bytes) -> Iterator[bytes]:
    """What stands behind each tag, up to the end of its line, a comment's end or the next tag."""
    lower = raw.translate(ASCII_LOWER)
    at = lower.find(TAG)
    while at >= 0:
        at += len(TAG)
        onward = lower.find(TAG, at)
        end = onward if onward >= 0 else len(lower)
        stop = lower.find(b"\n", at, end)
        line = lower[at : stop if stop >= 0 else end].lstrip(b" \t")
        if line[:1] == b":":
            yield re.split(rb"\*/|-->|[,;#\"']", line[1:], maxsplit=1)[0].strip().rstrip(b".")
        at = onward


def scan_text(raw: bytes) -> tuple:
    words = raw.translate(ALNUM_OR_SPACE).split()
    if not words:
        return 0, 0, None, None, "", "", 0.0, None, 0
    folded = b" " + b" ".join(words) + b" "
    base: list[int] = []
    base_labels, labels, score, tagged = set(), set(), 0.0, False
    for end, (label, kind, length) in _automaton().iter(folded.decode("latin-1")):
        if kind == 0:
            base.append(end - length + 1)
            base_labels.add(label)
            score = max(score, BASE_SCORE)
        elif kind == 1:
            labels.add(label)
            score = max(score, NOTICE_SCORE)
        else:
            tagged = True
    restricts = [restrictiveness(x) for x in base_labels | labels]
    bad = 0
    for expression in _expressions(raw) if tagged else ():
        try:
            licence = evaluate(expression)
        except BadExpression:
            bad += 1
            score = max(score, BAD_TAG_SCORE)
        else:
            labels |= licence.labels
            restricts.append(licence.restricts)
            score = TAG_SCORE
    word_at = lambda at: folded.count(b" ", 0, at)
    return (
        len(words), len(base),
        word_at(min(base)) if base else None, word_at(max(base)) if base else None,
        ",".join(sorted(base_labels)), ",".join(sorted(base_labels | labels)),
        score, max(restricts, default=None), bad,
    )


FOUND = (
    "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, "
    "labels string, score double, restrictiveness int, n_bad_expressions bigint"
)
_FOUND = pa.struct(
    [
        ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
        ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
        ("restrictiveness", pa.int32()), ("n_bad_expressions", pa.int64()),
    ]
)


def scan(text: Column | str) -> Column:
    """The struct FOUND for a text column."""

    @F.arrow_udf(f"struct<{FOUND.replace(' bigint', ':bigint').replace(' string', ':string').replace(' double', ':double').replace(' int', ':int')}>")
    def scanned(texts: pa.Array) -> pa.Array:
        rows = list(zip(*(scan_text(t) for t in texts_as_bytes(texts)), strict=True)) or [()] * len(_FOUND)
        return pa.StructArray.from_arrays(
            [pa.array(c, f.type) for c, f in zip(rows, _FOUND, strict=True)], fields=list(_FOUND)
        )

    return scanned(text)


def license_scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and the columns of FOUND, one row for each row of docs."""
    return docs.select(F.col("doc_id").alias("doc_id"), scan(F.col(text)).alias("found")).select("doc_id", "found.*")
