import random
import re

import duckdb
import pytest

from weft.llm.mixing import mix, mixed_sizes, oracle

KIND = "doc_id long, text string, source string, key long, size string"


def documents(seed=1, n=400):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        source = r.choice(["big"] * 8 + ["a", "b", "Ä", None])
        rows.append((i, " ".join(["w"] * r.randint(0, 60)), source, 1, "x"))
    return [*rows, (n, None, "a", 1, "x"), (n + 1, "", "empty", 1, "x"), (n + 2, " \t\x0b\n", "empty", 1, "x"), (n + 3, "w " * 500, "b", 1, "x"), (None, "w w", "a", 1, "x"), (3, "w w w", "a", 1, "x"), (3, "w w w", "a", 1, "x")]


def filled(sizes, weights, epochs=3):
    """Water-filling by the definition: clamp, share the excess by weight, until none is above."""
    total, cap = sum(sizes), [epochs * s for s in sizes]
    target, fixed = [0.0] * len(sizes), set()
    while True:
        left = total - sum(cap[i] for i in fixed)
        free = [i for i in range(len(sizes)) if i not in fixed]
        share = sum(weights[i] for i in free)
        for i in free:
            target[i] = left * weights[i] / share
        over = [i for i in free if target[i] > cap[i] + 1e-9]
        if not over:
            return [cap[i] if i in fixed else target[i] for i in range(len(sizes))]
        fixed |= set(over)


@pytest.mark.parametrize("seed", [1, 2])
def test_targets_and_taken_words(spark, seed):
    rows = documents(seed)
    df = spark.createDataFrame(rows, KIND)
    out = mixed_sizes(df).collect()
    assert len(out) == len(rows)
    by = {}
    for _, text, source, _, _ in rows:
        by[source] = by.get(source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    names = sorted([s for s in by if s is not None], key=lambda s: s.encode()) + [None]
    wanted = filled([by[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))])
    got = {}
    for r in out:
        assert r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
        got.setdefault((r["source_size"], round(r["target"], 6)), []).append(r["taken"])
    for s, t in zip(names, wanted):
        assert (by[s], round(t, 6)) in got
        assert abs(sum(got[by[s], round(t, 6)]) - t) <= max(60, 0.08 * t)
    assert sorted(map(tuple, mixed_sizes(df).collect()), key=repr) == sorted(map(tuple, out), key=repr)


def test_equals_plain_sql(spark):
    rows = documents(5)
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?, ?)", [r[:3] for r in rows])
    found = c.execute(oracle())
    names = [d[0] for d in found.description]
    out = mixed_sizes(spark.createDataFrame(rows, KIND)).select(*names).collect()
    assert sorted(map(tuple, out), key=repr) == sorted(found.fetchall(), key=repr)


def test_the_mix_repeats_rows_with_all_their_columns(spark):
    rows = documents(3, 60)
    df = spark.createDataFrame(rows, KIND)
    want = {}
    for r in mixed_sizes(df).where("size > 0").collect():
        if r["copies"]:
            want[r["doc_id"]] = want.get(r["doc_id"], 0) + r["copies"]
    got = {}
    mixed = mix(df)
    assert mixed.columns == df.columns
    for r in mixed.collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
    assert got == want


def test_empty_and_wordless(spark):
    empty = spark.createDataFrame([], KIND)
    assert mixed_sizes(empty).count() == 0 and mix(empty).count() == 0
    none = spark.createDataFrame([(1, None, "a", 1, "x"), (2, "", None, 1, "x")], KIND)
    assert [(r["target"], r["taken"]) for r in mixed_sizes(none).collect()] == [(0.0, 0), (0.0, 0)]


def test_plan_is_native(spark):
    plan = mixed_sizes(spark.createDataFrame(documents(1, 20), KIND))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_long_documents_leave_no_gap(spark):
    """A very long document at the cut of the order: those behind it fill the target all the same."""
    r = random.Random(8)
    for seed in ("s1", "s2", "s3"):
        rows = [(i, r.randint(50, 500), "big") for i in range(1500)] + [(9000 + i, 60_000, "big") for i in range(3)] + [(10_000 + i, 40, f"x{i}") for i in range(4)]
        df = spark.createDataFrame([(i, "w " * n, s) for i, n, s in rows], "doc_id long, text string, source string")
        out = mixed_sizes(df, seed=seed).where("source_size > 1000").collect()
        assert abs(sum(x["taken"] for x in out) - out[0]["target"]) < 0.001 * out[0]["target"]
