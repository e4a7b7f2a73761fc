import math
import random

import numpy as np
import public_tokenizers as P
from pyspark.sql import functions as F

from weft.llm.ngram import ADDED, PRIOR, encoder, losses, score
from weft.llm.query_ngram import RANK_FILE

PATH = P.path(RANK_FILE)


def test_losses_are_distributions():
    size, r = 5, np.random.default_rng(1)
    bigrams = r.choice(30, 12, replace=False)
    n = r.integers(1, 9, 12)
    assert np.allclose(np.exp(-losses(bigrams, n, size)).sum(1), 1)


def test_scores_against_plain_python(spark):
    r = random.Random(1)
    rows = [(i, " ".join(r.choice(["the", "cat", "dog", "zebra", "ünder"]) for _ in range(r.randint(0, 20))), r.choice([True, False, None]), "x") for i in range(60)] + [(90, None, True, "x"), (91, "", None, "x"), (5, "the cat", True, "x"), (None, "the dog", False, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, is_target boolean, ids string")
    size = 512
    own = encoder(PATH, P.PATTERN, size)
    ids = [np.frombuffer(own.encode(t or ""), "<u4").tolist() for _, t, _, _ in rows]
    assert all(x < size for i in ids for x in i)

    def model(which):
        pairs, context, single = {}, {}, {}
        for i in which:
            for h, w in zip([size, *i], i):
                pairs[h, w] = pairs.get((h, w), 0) + 1
                context[h] = context.get(h, 0) + 1
                single[w] = single.get(w, 0) + 1
        total = sum(single.values()) + ADDED * size
        return lambda h, w: -math.log((pairs.get((h, w), 0) + PRIOR * (single.get(w, 0) + ADDED) / total) / (context.get(h, 0) + PRIOR))

    a, b = model([i for i, row in zip(ids, rows) if row[2]]), model(ids)
    out = sorted(((x["doc_id"], x["n_tokens"], x["difference"]) for x in score(df, PATH, P.PATTERN, size).collect()), key=repr)
    want = sorted(((row[0], len(i), sum(a(h, w) - b(h, w) for h, w in zip([size, *i], i)) / len(i) if i else None) for row, i in zip(rows, ids)), key=repr)
    assert [x[:2] for x in out] == [x[:2] for x in want]
    assert all((x[2] is None) == (y[2] is None) and (x[2] is None or abs(x[2] - y[2]) < 1e-4) for x, y in zip(out, want))
    assert score(df.limit(0), PATH, P.PATTERN, size).count() == 0


def test_held_out_labels(spark):
    """Trained on the labels of even documents, the score ranks odd documents of good quality as nearer to the target."""
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    marks = labels.where("doc_id % 2 = 0").select("doc_id", (F.col("quality") == 1).alias("is_target"))
    out = score(docs.join(marks, "doc_id", "left"), PATH, P.PATTERN).join(labels.where("doc_id % 2 = 1"), "doc_id").select("difference", "quality").collect()
    good, bad = [x[0] for x in out if x[1] == 1], [x[0] for x in out if x[1] == 0]
    assert sum(g < b for g in good for b in bad) / (len(good) * len(bad)) > 0.9
