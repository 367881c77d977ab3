"""Operators that work row by row, against brute force; odd rows of every kind."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomgraph.llm import (
    chat_format,
    decontaminate,
    language_id,
    license_scan,
    quality_qda,
    quality_rules,
    sentencepiece_codec,
    token_packing,
)

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [None, "", "\x1cb\x1f'll \x1e\x1d x", "a\u2028\u3000 b\u180e\u200b", " ", "\n\t", "a", "ÉCOLE É", "x" * 5000, "the and " * 3000, "😀 ☃ 中文", "a\x00b \x85\xa0c d", "▁x ▁", "</s>[INST]"]


def documents(spark, texts, start=0):
    """Rows with clashing extra columns, a null id and a repeated row."""
    rows = [(start + k, t, "en", "s", len(t or ""), 0.5, "x", None) for k, t in enumerate(texts)]
    rows += [(None, "no id", None, None, None, None, None, None), rows[-1]]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, score double, kept string, labels string"
    )


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    vocabulary = ["the", "of", "and", "cc", "by", "mit", "license", "gnu", "general", "public", "apache", "Licensed", "under", "x1", "é", "word", "###"]
    glue = [" ", " ", " ", "\n", ", ", "-", "  ", "\t"]
    return [*ODD, *("".join(rng.choice(vocabulary) + rng.choice(glue) for _ in range(rng.randint(1, 300))) for _ in range(150))]


def by_id(frame):
    return {r["doc_id"]: r for r in frame.collect()}


def test_license_scan(spark, texts):
    texts = [*texts, "SPDX-License-Identifier: (MIT OR GPL-2.0-only WITH Classpath-exception-2.0) AND BSD-3-Clause\n", "spdx-license-identifier: MIT OR"]
    frame = license_scan.license_scan(documents(spark, texts))
    assert frame.count() == len(texts) + 2
    got = by_id(frame)
    for k, t in enumerate(texts):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
        places, labels = [], set()
        for phrase, label in license_scan.BASE_PHRASES.items():
            p = phrase.split()
            hits = [i for i in range(len(words)) if words[i : i + len(p)] == p]
            places += hits
            labels |= {label} if hits else set()
        r = got[k]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(places), min(places, default=None), max(places, default=None))
        assert r.base_labels == ",".join(sorted(labels)) and labels <= set(r.labels.split(",")) and 0 <= r.score <= 1
    spdx = got[len(texts) - 2]
    assert spdx.labels == "bsd-3-clause,gpl-2.0-only,mit" and spdx.score == 1.0 and spdx.restrictiveness == 0
    assert got[len(texts) - 1].n_bad_expressions == 1


def test_license_tags_of_long_texts():
    import time

    began = time.time()
    for between in (b"\n", b" ", b" or x\n"):
        assert license_scan.scan_text((b"SPDX-License-Identifier: MIT" + between) * 30_000)[-1] == 0
    assert license_scan.scan_text(b"SPDX-License-Identifier: " + b"MIT or " * 100_000)[-1] == 1
    assert time.time() - began < 20


def test_shunting_yard():
    assert license_scan.to_postfix(b"a or b and c with d") == [b"a", b"b", b"c", b"d", b"with", b"and", b"or"]
    assert license_scan.evaluate(b"(gpl-3.0 or mit) and agpl-3.0").restricts == 3
    for bad in (b"", b"a b", b"(a", b"a)", b"and a", b"a or", b"()", b"a ! b"):
        with pytest.raises(license_scan.BadExpression):
            license_scan.evaluate(bad)


def test_sentencepiece(spark, texts, tmp_path):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as proto

    rng = random.Random(5)
    texts = [*texts, *("".join(rng.choice("abcdeé  .,xyzABCthein☃中\n") for _ in range(rng.randint(1, 60))) for _ in range(300))]
    frame = sentencepiece_codec.encode_documents(documents(spark, texts))
    got = by_id(frame)
    model = proto.ModelProto()
    with open(sentencepiece_codec.MODEL, "rb") as file:
        model.ParseFromString(file.read())
    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
    for k, t in enumerate(texts):
        r = got[k]
        assert r.exact and r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest() and r.n_tokens == len(r.ids)
        if "▁" not in (t or ""):
            assert list(r.ids) == library.encode(t or "")
    # The same vocabulary as a unigram model: the classic Viterbi search. The library adds scores of a
    # whole text up in single precision, which is exact for short texts and moderate scores only.
    model.trainer_spec.model_type = sentencepiece_codec.UNIGRAM
    for piece in model.pieces:
        piece.score = max(piece.score, -40_000)
    path = tmp_path / "unigram.model"
    path.write_bytes(model.SerializeToString())
    ours, library = sentencepiece_codec.codec(str(path)), sentencepiece.SentencePieceProcessor(model_file=str(path))
    ids, bounds, _ = ours.encode_texts([t or "" for t in texts])
    for k, t in enumerate(texts):
        if "▁" not in (t or "") and len(t or "") < 300:
            assert ids[bounds[k] : bounds[k + 1]].tolist() == library.encode(t or "")
    back = documents(spark, texts[:20]).select("doc_id", sentencepiece_codec.decode(sentencepiece_codec.encode("text")).alias("back"))
    assert all(by_id(back)[k].back == (t or "") for k, t in enumerate(texts[:20]))


def test_token_packing(spark, texts):
    import base64

    import public_tokenizers
    import tiktoken

    with open(token_packing.VOCABULARY, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    packed = token_packing.pack_documents(documents(spark, texts), row_tokens=128, shard_tokens=5000).collect()
    parts, copies = {}, 0
    for r in packed:
        ids, positions = token_packing.read_matrices([r], 128)
        assert r.cu_seqlens[-1] == r.n_tokens <= 128 and len(r.cu_seqlens) == r.n_segments + 1
        for k in range(r.n_segments):
            a, b = r.cu_seqlens[k], r.cu_seqlens[k + 1]
            assert positions[0, a:b].tolist() == list(range(b - a)) and b > a
            copies += (r.doc_ids[k], r.offsets[k]) in parts
            parts[r.doc_ids[k], r.offsets[k]] = ids[0, a:b].tolist()
    for k, t in enumerate(texts):
        whole, at = [], 0
        while (k, at) in parts:
            whole += parts[k, at]
            at += len(parts[k, at])
        assert whole == [*library.encode_ordinary(t or ""), token_packing.END_OF_TEXT]
    assert copies and token_packing.pack_documents(documents(spark, texts).limit(0)).count() == 0


def test_token_ids_equal_the_tokenizers():
    library = token_packing._pieces(token_packing.VOCABULARY).tokenizer
    rng = random.Random(8)
    letters = "ab1's \u00e9 \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u180e\u2000\u200a\u200b\u2028\u2029\u202f\u205f\u2060\u3000\ufeff#.l'"
    for _ in range(5000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 20)))
        assert token_packing.token_ids(text).tolist() == [*library.encode_ordinary(text), token_packing.END_OF_TEXT]


def test_token_packing_of_long_runs(spark, tmp_path):
    texts = [" " * 5_000_000 + "x", "a" + "\n" * 2_000_000, "y" * 1_000_000]
    packed = token_packing.pack_documents(documents(spark, texts), row_tokens=65536)
    token_packing.write_matrices(packed, str(tmp_path / "rows"), rows_a_file=20)
    files = [f for f in (tmp_path / "rows").iterdir() if f.suffix == ".parquet"]
    rows = spark.read.parquet(str(tmp_path / "rows")).collect()
    ids, positions = token_packing.read_matrices(rows, 65536)
    assert len(files) >= len(rows) / 20 and ids.shape == positions.shape == (len(rows), 65536)
    parts = {(d, o): ids[k, r.cu_seqlens[j] : r.cu_seqlens[j + 1]] for k, r in enumerate(rows) for j, (d, o) in enumerate(zip(r.doc_ids, r.offsets, strict=True))}
    library = token_packing._pieces(token_packing.VOCABULARY).tokenizer
    for k, t in enumerate(texts):
        whole = [int(x) for (d, o) in sorted(x for x in parts if x[0] == k) for x in parts[d, o]]
        assert library.decode(whole[:-1]) == t and whole[-1] == token_packing.END_OF_TEXT


def test_token_packing_whatever_the_splits(spark, texts):
    docs = documents(spark, [t for t in texts if t] * 3)
    packs = [
        [(list(r.doc_ids), bytes(r.ids)) for r in token_packing.pack_documents(docs.repartition(n), row_tokens=256).collect()]
        for n in (1, 20)
    ]
    assert sorted(packs[0], key=str) == sorted(packs[1], key=str)


def test_best_fit_decreasing():
    rng = random.Random(1)
    for _ in range(30):
        lengths = [rng.randint(1, 64) for _ in range(rng.randint(0, 80))]
        rooms, rows = [], []
        for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
            fits = [r for r in range(len(rooms)) if rooms[r] >= lengths[k]]
            if not fits:
                rooms.append(64)
                rows.append([])
                fits = [len(rooms) - 1]
            r = min(fits, key=lambda r: rooms[r])
            rooms[r] -= lengths[k]
            rows[r].append(k)
        got = token_packing.best_fit_decreasing(lengths, 64)
        assert sorted(k for row in got for k in row) == list(range(len(lengths)))
        assert sorted(sum(lengths[k] for k in row) for row in got) == sorted(sum(lengths[k] for k in row) for row in rows)


def test_quality_rules(spark, texts):
    rng = random.Random(9)
    texts = [*texts, *(" ".join(rng.choice("abc") for _ in range(n)) for n in (3, 4, 5, 9, 60, 400)), "a b c d a b c", "same\nsame\n\nother\nsame \n", "w " * 70]
    frame = quality_rules.quality_rules(documents(spark, texts))
    assert frame.count() == len(texts) + 2
    got = by_id(frame)
    for k, t in enumerate(texts):
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        often = Counter(windows)
        covered = {i + j for i, w in enumerate(windows) if often[w] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(words) < 50 or 100 * len(covered) > 50 * len(words))
        assert not (r.base_failed and r.kept)
    assert quality_rules.quality_rules(documents(spark, texts).limit(0)).count() == 0


def test_chat_format(spark):
    said = "</s>[INST] & &amp; <s>[user] ok [/INST]"
    rows = [
        (1, 0, "system", "be"), (1, 2, "assistant", said), (1, 1, "user", None), (1, 3, None, "x"), (1, 4, "assistant", "é😀"),
        (2, 5, "assistant", ""), (2, 5, "assistant", ""), (2, None, "us]er", "a"), (None, 0, "user", "n"),
    ]
    frame = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    back = {r.conv_id: r for r in chat_format.read_back(chat_format.format_chats(frame)).collect()}
    assert [(t.role, t.text) for t in back[1].turns] == [("system", "be"), ("user", ""), ("assistant", said), ("", "x"), ("assistant", "é😀")]
    assert back[1].loss_text == said + "é😀"
    assert [(t.role, t.text) for t in back[2].turns] == [("us]er", "a"), ("assistant", ""), ("assistant", "")]
    assert [(t.role, t.text) for t in back[None].turns] == [("user", "n")]
    assert back[1].formatted.count("</s>") == 5
    assert chat_format.format_chats(frame.limit(0)).count() == 0


def fold_by_hand(rows):
    """Events one by one; without a target the latest message that is still there is meant."""
    messages, n = {}, 0
    for _, kind, target, role, text in sorted(rows, key=lambda r: (r[0], r[1])):
        if kind == "message":
            n += 1
            messages[n] = [role, text]
            continue
        m = target if target is not None else max(messages, default=None)
        if m not in messages:
            continue
        if kind == "delta":
            messages[m][1] += text
        elif kind in ("edit", "regenerate"):
            messages[m][1] = text
            if kind == "regenerate":
                messages = {k: v for k, v in messages.items() if k <= m}
    return [tuple(messages[k]) for k in sorted(messages)]


EVENTS = "conv_id long, seq long, kind string, target long, role string, text string"


def test_chat_events(spark):
    rng = random.Random(11)
    logs = {}
    for conv in range(150):
        rows, n = [], 0
        for seq in range(rng.randint(1, 30)):
            kind = rng.choice(["message", "message", "delta", "delta", "edit", "regenerate", "regenerate"]) if n else rng.choice(["message", "message", "delta", "other"])
            n += kind == "message"
            target = None if kind == "message" or rng.random() < 0.4 else rng.randint(0, n + 1)
            rows.append((seq, kind, target, rng.choice(["user", "assistant"]), f"t{seq} "))
        logs[conv] = rows
    frame = spark.createDataFrame([(c, *r) for c, rows in logs.items() for r in rows], EVENTS)
    got = {}
    for r in chat_format.fold_events(frame.repartition(3)).orderBy("conv_id", "message_no").collect():
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    want = {c: fold_by_hand(rows) for c, rows in logs.items()}
    assert got == {c: rows for c, rows in want.items() if rows}
    # An earlier message regenerated: what came after it goes, what comes later stays, and a delta
    # without a target goes to the message regenerated.
    rows = [(0, "message", None, "user", "q"), (1, "message", None, "assistant", "a"), (2, "message", None, "user", "more"),
            (3, "regenerate", 2, "assistant", "b"), (4, "delta", None, "assistant", "c"), (5, "message", None, "user", "next")]
    one = spark.createDataFrame([(1, *r) for r in rows], EVENTS)
    assert [(r.role, r.text) for r in chat_format.fold_events(one).orderBy("message_no").collect()] == [("user", "q"), ("assistant", "bc"), ("user", "next")]
    assert chat_format.fold_events(one.limit(0)).count() == 0


def test_chat_long_conversation(spark):
    """A hundred thousand turns, with regenerations that go back, folded and read back."""
    rng = random.Random(12)
    rows, n = [], 0
    while n < 100_000:
        n += 1
        rows.append((len(rows), "message", None, rng.choice(["user", "assistant"]), f"t{n} <&"))
        if rng.random() < 0.05:
            rows.append((len(rows), "regenerate", n - rng.randint(0, 3), "assistant", f"again {n}"))
            rows.append((len(rows), "delta", None, "assistant", " and on"))
    frame = spark.createDataFrame([(1, *r) for r in rows], EVENTS).coalesce(1)
    back = chat_format.read_back(chat_format.render(chat_format.fold_events(frame))).collect()
    want = fold_by_hand_fast(rows)
    assert [(t.role, t.text) for t in back[0].turns] == want
    assert back[0].loss_text == "".join(text for role, text in want if role == "assistant")


def fold_by_hand_fast(rows):
    """As fold_by_hand, for logs whose messages are only dropped from the end."""
    stack, n = [], 0
    for _, kind, target, role, text in rows:
        if kind == "message":
            n += 1
            stack.append([n, role, text])
        elif kind == "delta":
            stack[-1][2] += text
        else:
            at = next((k for k in range(len(stack) - 1, max(-1, len(stack) - 10), -1) if stack[k][0] == target), None)
            if at is not None:
                del stack[at + 1 :]
                stack[at][2] = text
    return [(role, text) for _, role, text in stack]


def test_decontamination(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    words = item.split()
    texts = [
        item, "Noise before. " + item.upper().replace(" ", ", ") + " and noise after", " ".join(words[6:] + ["xx"] + words[:6]),
        " ".join(words[:5]) + " other words here", "nothing alike at all in this text", None, "", " ".join(words[::-1]), (item + " pad ") * 200,
    ]
    bench = spark.createDataFrame([(7, item, "x"), (8, None, "x"), (9, "too short", "x"), (7, item, "x")], "item_id long, text string, doc_id string")
    got = by_id(decontaminate.contamination(documents(spark, texts), bench))
    assert [got[k].contaminated for k in range(len(texts))] == [True, True, True, False, False, False, False, False, True]
    assert got[0].item_ids == [7] and got[2].max_coverage == 1.0 and 0.4 < got[3].max_coverage < 0.45
    clean = decontaminate.without_contaminated(documents(spark, texts), bench)
    assert {r.doc_id for r in clean.collect()} == {3, 4, 5, 6, 7, None} and clean.columns == documents(spark, texts).columns
    assert not any(r.contaminated for r in decontaminate.contamination(documents(spark, texts), bench.limit(0)).collect())


def test_decontamination_by_passage_and_short_items(spark):
    item = [f"w{k}" for k in range(59)]
    long = [f"v{k}" for k in range(1000)]
    texts = [
        "before " + " ".join(item[10:40]) + " after", " ".join(long[200:700]), " ".join(item[:12]) + " other", " ".join(item[:13]),
        " ".join(item[:12] + ["x"] + item[20:32]), "so it is Forty two, he said", "two forty", "forty and two", None,
    ]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(long)), (3, "forty two"), (4, ""), (5, None)], "item_id long, text string")
    got = by_id(decontaminate.contamination(documents(spark, texts), bench))
    assert [got[k].item_ids for k in range(len(texts))] == [[1], [2], [], [1], [], [3], [], [], []]
    assert got[1].max_coverage == 0.5 and got[5].max_coverage == 1.0
    clean = decontaminate.without_contaminated(documents(spark, texts), bench)
    assert {r.doc_id for r in clean.collect()} - {None} == {2, 4, 6, 7, 8}


def tiles_by_hand(a, b, least):
    """Greedy string tiling by comparing all places with all."""
    free_a, free_b, found = [True] * len(a), [True] * len(b), []
    while True:
        best, matches = least, []
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and free_a[i + n] and free_b[j + n]:
                    n += 1
                if n > best:
                    best, matches = n, [(i, j)]
                elif n == best:
                    matches.append((i, j))
        if not matches:
            return found
        for i, j in matches:
            if all(free_a[i : i + best]) and all(free_b[j : j + best]):
                free_a[i : i + best] = free_b[j : j + best] = [False] * best
                found.append((i, j, best))


def test_decontamination_by_brute_force(spark):
    rng = random.Random(13)
    some = lambda n, k: [f"{rng.choice('abc')}{rng.randint(0, k)}" for _ in range(n)]
    items = {k: some(rng.choice([1, 3, 6, 15, 40]), rng.choice([1, 5, 30])) for k in range(25)}
    texts = []
    for _ in range(150):
        words = some(rng.randint(0, 40), rng.choice([1, 5, 30]))
        for _ in range(rng.randint(0, 3)):
            item = rng.choice(list(items.values()))
            a, b = sorted((rng.randint(0, len(item)), rng.randint(0, len(item))))
            at = rng.randint(0, len(words))
            words[at:at] = item[a:b] * rng.choice([1, 1, 3])
        texts.append(", ".join(words).upper())
    texts += texts[:10]
    bench = spark.createDataFrame([(k, " ".join(v)) for k, v in items.items()] + [(3, " ".join(items[3]))], "item_id long, text string")
    got = by_id(decontaminate.contamination(documents(spark, texts).repartition(7), bench.repartition(3)))
    held = 0
    for k, text in enumerate(texts):
        words, over, most = text.lower().replace(",", "").split(), [], 0.0
        for item_id, item in items.items():
            lengths = [n for *_, n in tiles_by_hand(item, words, min(decontaminate.TILE, len(item)))]
            most = max(most, sum(lengths) / len(item))
            if sum(lengths) / len(item) >= decontaminate.COVERAGE or max(lengths, default=0) >= decontaminate.PASSAGE:
                over.append(item_id)
        assert (got[k].contaminated, got[k].item_ids, got[k].n_items) == (bool(over), over, len(over) + (3 in over))
        assert abs(got[k].max_coverage - most) < 1e-12
        held += bool(over)
    assert 20 < held < len(texts)


def test_tiling_of_long_repetitive_texts():
    import time

    began = time.time()
    item, doc = [1, 2] * 50, [1, 2, 1, 2, 3] * 20_000 + [1, 2] * 30_000
    found = decontaminate.tiles(item, doc, 5)
    assert sum(n for *_, n in found) == 100 and found[0][2] == 100
    assert len(decontaminate.tiles([1] * 997, [1] * 500 + [2] + [1] * 300_000, 5)) == 1
    assert len(decontaminate.tiles([1] * 10_000, ([1] * 7 + [2]) * 5000, 5)) == 1428
    assert time.time() - began < 20


def test_tiling_is_greedy_and_disjoint():
    rng = random.Random(2)
    for _ in range(200):
        a = [rng.randint(0, 3) for _ in range(rng.randint(0, 25))]
        b = [rng.randint(0, 3) for _ in range(rng.randint(0, 40))]
        found = decontaminate.tiles(a, b, 3)
        assert found == tiles_by_hand(a, b, 3)
        used_a = [k for i, _, n in found for k in range(i, i + n)]
        used_b = [k for _, j, n in found for k in range(j, j + n)]
        assert len(used_a) == len(set(used_a)) and len(used_b) == len(set(used_b))
        assert all(a[i : i + n] == b[j : j + n] and n >= 3 for i, j, n in found)
        assert [n for *_, n in found] == sorted((n for *_, n in found), reverse=True)
        best = max((n for i in range(len(a)) for j in range(len(b)) for n in range(1, 26) if a[i : i + n] == b[j : j + n] and i + n <= len(a) and j + n <= len(b)), default=0)
        assert (found[0][2] if found else 0) == (best if best >= 3 else 0)
        free_a = ["x" if k in used_a else v for k, v in enumerate(a)]
        free_b = ["y" if k in used_b else v for k, v in enumerate(b)]
        assert not any(free_a[i : i + 3] == free_b[j : j + 3] for i in range(len(a) - 2) for j in range(len(b) - 2))


def test_language_id_by_brute_force(spark):
    def grams(text):
        t = re.sub(" +", " ", " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " ")
        out = Counter()
        for n in (1, 2, 3):
            for i in range(len(t) - n + 1):
                g = t[i : i + n]
                if " " not in g[1:-1] and g.strip():
                    out[g] += 1
        return out

    def code(g):
        return sum(ord(c) << (21 * (len(g) - 1 - k)) for k, c in enumerate(g))

    def profile(counts, size):
        return sorted(counts, key=lambda g: (-counts[g], code(g)))[:size]

    sentences = {"en": "the quick brown fox and the lazy dog", "de": "der schnelle fuchs und die müde hündin", "fr": "le renard brun et la chienne fatiguée"}
    rng = random.Random(4)
    rows = []
    for k in range(120):
        lang = rng.choice(list(sentences))
        words = sentences[lang].split()
        rows.append((k, " ".join(rng.choice(words) for _ in range(rng.randint(3, 30))), None if k % 17 == 0 else lang))
    rows += [(200, None, "en"), (201, "", "en"), (202, "12 34 !", "en"), (203, "Der Fuchs", None)]
    frame = spark.createDataFrame([(*r, 0.1) for r in rows], "doc_id long, text string, lang string, score double")
    import zlib

    train = {}
    for i, t, lang in rows:
        if lang and t is not None and zlib.crc32(str(i).encode()) % 4 != 2:
            train.setdefault(lang, Counter()).update(grams(t))
    profiles = {lang: profile(c, 300) for lang, c in train.items()}
    got = by_id(language_id.identify(frame))
    for i, t, _ in rows:
        top = profile(grams(t or ""), 300)
        if not top:
            want = ("und", 0.0)
        else:
            far = {lang: sum(abs(r - p.index(g)) if g in p else 300 for r, g in enumerate(top)) for lang, p in profiles.items()}
            best = min(sorted(far), key=far.get)
            want = (best, 1 - far[best] / (300 * len(top)))
        assert (got[i].lang_pred, round(got[i].score, 9)) == (want[0], round(want[1], 9))
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
    assert {r.lang_pred for r in language_id.identify(frame.where("lang = 'xx'").unionByName(frame.limit(0))).collect()} == set()
    assert {r.lang_pred for r in language_id.identify(frame.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_quality_by_brute_force(spark):
    import numpy as np

    rng = random.Random(6)
    rows, labels = [], []
    for k in range(300):
        good = rng.random() < 0.7
        n = rng.randint(20, 200)
        text = " ".join(rng.choice(["the", "of", "plain", "words", "here", "and"]) + ("." if rng.random() < 0.1 else "") for _ in range(n)) if good else " ".join("###" + rng.choice("abc") for _ in range(n))
        rows.append((k, text))
        if k % 3:
            labels.append((k, int(good), 0))
    rows += [(900, None), (901, "")]
    labels += [(900, None, None), (None, 1, 0), (1, 1, 0), (5000, 0, 0)]
    docs = spark.createDataFrame([(*r, 9, "z") for r in rows], "doc_id long, text string, quality int, score string")
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = by_id(quality_qda.quality_scores(docs, frame))
    import zlib

    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    lowest = {}
    for i, q, _ in labels:
        if i is not None and q is not None:
            lowest[i] = min(q, lowest.get(i, 1))
    x = {i: quality_qda.features_of((t or "").encode()) for i, t in rows}
    sets = [np.array([x[i] for i, q in lowest.items() if q == k and i in x and not held(i)]) for k in (0, 1)]
    n = np.array([len(s) for s in sets])
    pooled = sum((s - s.mean(0)).T @ (s - s.mean(0)) for s in sets) / (n.sum() - 2)

    def log_density(v, k):
        own = 0.8 * np.cov(sets[k].T) + 0.2 * pooled
        own = 0.9 * own + 0.1 * np.diag(np.diag(own)) + 1e-6 * np.eye(len(v))
        d = v - sets[k].mean(0)
        return -0.5 * (d @ np.linalg.solve(own, d) + np.linalg.slogdet(own)[1]) + np.log(n[k] / n.sum())

    for i, _ in rows:
        gap = np.clip(log_density(np.array(x[i]), 1) - log_density(np.array(x[i]), 0), -500, 500)
        assert abs(got[i].score - 1 / (1 + np.exp(-gap))) < 1e-5
        assert got[i].predicted == int(got[i].score >= 0.7) and got[i].held_out == held(i)
    right = [got[i].predicted == q for i, q in lowest.items() if i in got and held(i)]
    assert sum(right) / len(right) > 0.95
    assert {r.score for r in quality_qda.quality_scores(docs, frame.limit(0)).collect()} == {0.5}
