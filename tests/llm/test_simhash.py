import random

import pytest
import xxhash

from weft.llm import simhash


def plain(text, width=3):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(values, budget=2):
    """The smallest index that each value reaches."""
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= budget:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def documents():
    r = random.Random(3)
    base = [" ".join(r.choice(["alpha", "Beta", "gamma", "délta", "eps", "zeta"]) for _ in range(r.randint(1, 200))) for _ in range(60)]
    texts = base + [b + " tail" for b in base[:30]] + base[:10] + [None, "", "one", "ONE", "two words", " \t\n"]
    r.shuffle(texts)
    return [(i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("heavy", [1000, 0])
def test_against_brute_force(spark, monkeypatch, heavy):
    monkeypatch.setattr(simhash, "HEAVY", heavy)
    rows = documents()
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, fp long")
    out = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(df).collect()}
    values = [plain(t) for _, t in rows]
    assert out == {i: (f"{v:016x}", g) for (i, _), v, g in zip(rows, values, groups(values))}


def test_links_of_dense_fingerprints(spark):
    r = random.Random(7)
    values = set()
    for _ in range(12):
        centre = r.getrandbits(64)
        values |= {centre ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 5))) for _ in range(40)}
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    edges = simhash.near_edges(spark.createDataFrame([(v,) for v in signed], "fp long")).collect()
    index = {v: i for i, v in enumerate(signed)}
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for u, v in edges:
        assert ((u ^ v) & (1 << 64) - 1).bit_count() or u == v
        a, b = sorted((find(index[u]), find(index[v])))
        root[b] = a
    assert [find(i) for i in range(len(values))] == groups(values)


def test_one_of_each_stays_with_null_and_repeated_ids(spark):
    rows = [(None, "same text here now", "a"), (4, "same text here now", "b"), (2, "same text here now", "c"), (2, "same text here now", "d"), (9, None, "e"), (8, "", "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, place string")
    out = simhash.first_of_each(df).collect()
    assert sorted(r["doc_id"] for r in out) == [2, 8] and set(out[0].asDict()) == {"doc_id", "text", "place"}
    assert simhash.first_of_each(df.limit(0)).count() == 0 and simhash.near_duplicates(df.limit(0)).count() == 0
    assert {r["component_id"] for r in simhash.near_duplicates(df.where("doc_id is null")).collect()} == {None}


def test_components(spark):
    from weft.llm.components import components

    edges = [(i, i + 1) for i in range(1, 30)] + [(50, 40), (40, 50), (7, 7), (None, 3), (60, 61), (60, 62)]
    out = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).where("node != component").collect()}
    assert out == {i: 1 for i in range(2, 31)} | {50: 40, 61: 60, 62: 60}
