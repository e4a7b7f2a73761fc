"""Trigrams of the whole vocabulary against plain Python."""

import math
import random
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest

from weft.llm.ngram import ADDED, PRIOR, _ordered, counts, encoder, score, tokens
from weft.llm.query_ngram import RANK_FILE

PATH = P.path(RANK_FILE)


def test_trigram_scores_and_a_table_that_grows(spark):
    r = random.Random(4)
    rows = [(i, " ".join(r.choice(["international", "understanding", "cat", "the", "Ünder"]) for _ in range(r.randint(0, 15))), i % 3 == 0) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, is_target boolean")
    ids = [np.frombuffer(encoder(PATH, P.PATTERN).encode(t), "<u4").tolist() for _, t, _ in rows]
    size = len(encoder_ranks())
    assert max(max(i, default=0) for i in ids) >= 2048

    def model(which):
        c = [Counter() for _ in range(4)]
        h = [Counter() for _ in range(4)]
        for i in which:
            padded = [size, size, *i]
            for k in (1, 2, 3):
                for at in range(2, len(padded)):
                    g = tuple(padded[at - k + 1 : at + 1])
                    c[k][g] += 1
                    h[k][g[:-1]] += 1
        total = sum(c[1].values()) + ADDED * size

        def p(g):
            if len(g) == 1:
                return (c[1][g] + ADDED) / total
            return (c[len(g)][g] + PRIOR * p(g[1:])) / (h[len(g)][g[:-1]] + PRIOR)

        return lambda i: -sum(math.log(p(tuple([size, size, *i][k : k + 3]))) for k in range(len(i))) / len(i)

    a, b = model([i for i, row in zip(ids, rows) if row[2]]), model(ids)
    for x in score(df, PATH, P.PATTERN, order=3).collect():
        i = ids[x["doc_id"]]
        assert x["n_tokens"] == len(i)
        if i:
            assert x["target_loss"] == pytest.approx(a(i)) and x["background_loss"] == pytest.approx(b(i)) and x["difference"] == pytest.approx(a(i) - b(i))
    half = counts(tokens(df.where("doc_id < 10"), PATH, P.PATTERN), size, 3).count()
    assert half < counts(tokens(df, PATH, P.PATTERN), size, 3).count()


def encoder_ranks():
    from weft.llm.bpe import read_ranks

    return read_ranks(PATH)


def test_leaving_a_documents_own_counts_out(spark):
    """Against models that are counted anew without each document; chunks of a few documents."""
    from weft.llm import ngram

    r = random.Random(9)
    rows = [(i, " ".join(r.choice(["one", "two", "three", "of", "Straße"]) for _ in range(r.randint(0, 12)))) for i in range(24)] + [(24, "one two three"), (25, "one two three"), (26, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    targets = spark.createDataFrame([(i,) for i in (1, 3, 3, 4, 7, 24, 99)] + [(None,)], "doc_id long")
    ids = {i: np.frombuffer(encoder(PATH, P.PATTERN).encode(t or ""), "<u4").tolist() for i, t in rows}
    size = len(encoder_ranks())

    def loss(text, which):
        c, h = Counter(), Counter()
        for i in which:
            padded = [size, size, *ids[i]]
            for at in range(2, len(padded)):
                for k in (1, 2, 3):
                    c[tuple(padded[at - k + 1 : at + 1])] += 1
                    h[tuple(padded[at - k + 1 : at]), k] += 1
        total = sum(len(ids[i]) for i in which) + ADDED * size

        def p(g):
            return (c[g] + ADDED) / total if len(g) == 1 else (c[g] + PRIOR * p(g[1:])) / (h[g[:-1], len(g)] + PRIOR)

        return -sum(math.log(p(tuple([size, size, *text][k : k + 3]))) for k in range(len(text))) / len(text)

    before, ngram.CHUNK = ngram.CHUNK, 40
    try:
        out = {x["doc_id"]: x for x in score(df, PATH, P.PATTERN, order=3, targets=targets, leave_out=True).collect()}
    finally:
        ngram.CHUNK = before
    good = {1, 3, 4, 7, 24}
    assert sorted(out) == sorted(ids)
    for i, text in ids.items():
        if text:
            assert out[i]["target_loss"] == pytest.approx(loss(text, good - {i})) and out[i]["background_loss"] == pytest.approx(loss(text, set(ids) - {i}))
        else:
            assert out[i]["difference"] is None


@pytest.mark.parametrize("bits", [16, 32, 60])
def test_values_are_ordered_with_their_places(bits):
    r = np.random.default_rng(bits)
    for n in (0, 1, 5, 3000):
        values = r.integers(0, 1 << bits, max(1, n // 3))[r.integers(0, max(1, n // 3), n)]
        keys, order = _ordered(values, bits)
        assert order.tolist() == np.argsort(values, kind="stable").tolist() and keys.tolist() == sorted(values.tolist())
