"""Near copies by similarity, held against the Jaccard similarity of all pairs."""

import random

import corpus_pipeline
from weft.llm.simhash import first_of_near_copies


def shingles(text, width=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def kept(texts):
    """The smallest index of every group that links of similarity 0.8 connect."""
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return sorted({find(i) for i in range(len(texts))})


def documents():
    r = random.Random(2)
    word = [f"w{i}" for i in range(3000)]
    texts = [None, "", "one two", "One  two", "one three"]
    for _ in range(40):
        base = [r.choice(word) for _ in range(r.randint(80, 300))]
        texts += [" ".join(base), " ".join(base)]
        for _ in range(4):  # the number of changed words goes beyond the similarity
            copy = list(base)
            for k in r.sample(range(len(copy)), max(1, int(len(copy) * r.choice([0.005, 0.012, 0.05])))):
                copy[k] = r.choice(word)
            texts.append(" ".join(copy))
    base = [r.choice(word) for _ in range(200)]
    texts += [" ".join([*base[:k], f"x{k}", *base[k + 1 :]]) for k in range(150)]
    return texts


def test_stage_drops_near_copies(spark):
    texts = documents()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = corpus_pipeline.simhash_dedup(spark, df, "")
    assert out.columns == df.columns and sorted(r["doc_id"] for r in out.collect()) == kept(texts)


def test_equal_texts_and_null_ids(spark):
    df = spark.createDataFrame([(None, "a b", 1), (3, "a b", 2), (2, "A b", 3), (2, "a b", 4), (9, None, 5), (8, " ", 6)], "doc_id long, text string, fp long")
    assert sorted(r["doc_id"] for r in first_of_near_copies(df).collect()) == [2, 8]
    assert first_of_near_copies(df.limit(0)).count() == 0
