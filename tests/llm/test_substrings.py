import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from weft.llm import substrings
from weft.llm.windows import pieces


def brute(rows, length=200):
    seen = Counter()
    texts = [(i, (t or "").encode()) for i, t in rows]
    for _, t in texts:
        seen.update(t[s : s + length] for s in range(len(t) - length + 1))
    out = []
    for i, t in texts:
        covered = bytearray(len(t))
        for s in range(len(t) - length + 1):
            if seen[t[s : s + length]] > 1:
                covered[s : s + length] = b"\1" * length
        kept = bytes(c for c, m in zip(t, covered) if not m)
        spans = sum(1 for a, b in zip(b"\0" + bytes(covered), covered) if b and not a)
        out.append((i, len(t), sum(covered), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def made(seed=5):
    r = random.Random(seed)
    words = lambda n: "".join(r.choice("abcdefgh é\n") for _ in range(n))
    line, passage = words(150), words(260)
    rows = [(1, None), (2, ""), (3, "a" * 700), (4, "ab" * 300), (None, words(300)), (5, passage), (5, passage), (None, passage + words(50)), (6, "a" * 199), (7, words(5) + "a" * 230)]
    for i in range(40):
        rows.append((100 + i, words(r.randrange(120)) + line + words(r.randrange(120)) + (passage[: r.randrange(180, 260)] if i % 3 else "") + words(30)))
    return rows


@pytest.mark.parametrize("heavy", [1000, 3])
def test_digests_against_brute_force(spark, monkeypatch, heavy):
    monkeypatch.setattr(substrings, "HEAVY", heavy)
    rows = made()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, row long, runs string")
    assert sorted(map(tuple, substrings.substring_digests(df).collect()), key=repr) == brute(rows)


def test_very_long_texts_are_sliced(spark, monkeypatch):
    monkeypatch.setattr(substrings, "_SLICE", 500)
    rows = made(6)
    rows.append((900, rows[20][1] * 3 + "".join(t or "" for _, t in rows[10:30])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, substrings.substring_digests(df).collect()), key=repr) == brute(rows)


def test_removal_keeps_rows_and_columns(spark):
    passage = "".join(random.Random(1).choice("abcdefghij ") for _ in range(300))
    df = spark.createDataFrame([(1, f"ä{passage}ö", "k", 9), (2, passage, "k", 9), (3, None, "k", 9), (4, "short", "k", 9)], "doc_id long, text string, key string, n_chars long")
    out = {r["doc_id"]: r for r in substrings.remove_repeated(df).collect()}
    assert [out[i]["text"] for i in (1, 2, 3, 4)] == ["äö", "", None, "short"] and out[1]["n_chars"] == 2 and out[1]["key"] == "k"
    assert substrings.remove_repeated(df.limit(0)).columns == df.columns and substrings.substring_digests(df.limit(0)).count() == 0


def test_each_window_lies_in_one_piece_and_equal_windows_share_keys():
    r = random.Random(8)
    texts = [bytes(r.choice(b"ab") for _ in range(n)) for n in (0, 5, 40, 90)] + [b"a" * 70]
    data, bounds = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    keys = {}
    covered = Counter()
    for text, first, starts, key, _, anchor in zip(*(c.tolist() for c in pieces(data, bounds, 20, 8))):
        for s in range(first, first + starts):
            covered[text, s] += 1
            assert keys.setdefault(texts[text][s : s + 20], (key, anchor + first - s)) == (key, anchor + first - s)
    assert covered == Counter((i, s) for i, t in enumerate(texts) for s in range(len(t) - 19))
