"""The stages one after another, each held against what it is given."""

import random

import tiktoken
import public_tokenizers as P

import corpus_pipeline
from weft.llm.bpe import read_ranks
from weft.llm.common import written
from weft.llm.divergence import judged
from weft.llm.mixing import mixed_sizes
from weft.llm.substrings import substring_digests

from .test_near_copies import kept

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality rules", "SimHash near-dedup", "suffix-array dedup", "mixing to target weights", "byte-level BPE"]
    one = written(stages["quality rules"](spark, docs, SF), "t1")
    assert {r["doc_id"] for r in one.collect()} == {r["doc_id"] for r in judged(docs).where("kept").collect()} and one.columns == docs.columns
    two = written(stages["SimHash near-dedup"](spark, one, SF), "t2")
    before = one.orderBy("doc_id").collect()  # near copies of 5-word shingles at 0.8, by all pairs
    assert sorted(r["doc_id"] for r in two.collect()) == [before[i]["doc_id"] for i in kept([r["text"] for r in before])]
    three = written(stages["suffix-array dedup"](spark, two, SF), "t3")
    removed = {r["doc_id"]: (r["n_bytes"], r["n_removed"]) for r in substring_digests(two).collect()}
    for r in three.collect():
        n, gone = removed[r["doc_id"]]
        assert n - gone - 8 * 4 * 8 <= len(r["text"].encode()) <= n - gone and r["n_chars"] == len(r["text"])
    four = written(stages["mixing to target weights"](spark, three, SF), "t4")
    want = sorted(d for r in mixed_sizes(three).where("size > 0").collect() for d in [r["doc_id"]] * r["copies"])
    assert sorted(r["doc_id"] for r in four.collect()) == want and four.columns == docs.columns
    five = stages["byte-level BPE"](spark, four, SF)
    encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(P.path(corpus_pipeline.RANK_FILE)), special_tokens={})
    text = {r["doc_id"]: r["text"] for r in four.collect()}
    for r in five.collect():
        assert list(r["ids"]) == encoding.encode_ordinary(text[r["doc_id"]]) and bytes(r["decoded"]).decode() == text[r["doc_id"]]


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "ids", "decoded"] and out.count() > 50


def test_stages_take_any_rows(spark):
    """Null, empty and very long texts, null and repeated ids, ties, repeated rows, clashing names and empty tables in every stage."""
    r = random.Random(5)
    word = ["the", "of", "and", "to", "in", *(f"w{i}" for i in range(300))]
    prose = lambda n: " ".join(r.choice(word) for _ in range(n))
    long, base = prose(30_000), prose(120)
    texts = [None, "", "  \n", "word", long, base, base, base.replace("w1 ", "w2 "), prose(200), prose(90)]
    rows = [(i if i not in (3, 8) else None, t, "en" if i % 3 else None, "s1" if i % 2 else None, len(t or ""), "a", "b", 1.5, [i], {"k": i}, "_p") for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], rows[0], rows[8]]
    kind = "doc_id long, text string, lang string, source string, n_chars long, file string, at string, size double, runs array<long>, doc map<string,long>, pad string"
    df = spark.createDataFrame(rows, kind)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, "")
        assert out.schema.simpleString() == df.schema.simpleString(), name
        got = out.collect()
        if name in ("quality rules", "SimHash near-dedup"):
            assert {(x["doc_id"], x["text"]) for x in got} <= {(x[0], x[1]) for x in rows}
        if name == "SimHash near-dedup":
            assert sum(x["text"] == base for x in got) == 1 and sum(not (x["text"] or "").split() for x in got) == 1
        if name == "suffix-array dedup":
            assert len(got) == len(rows) and {x["doc"]["k"] for x in got} == set(range(10)) and all(x["text"] is None for x in got if x["doc_id"] == 0)
        if name == "mixing to target weights":
            assert all((x["text"] or "").split() for x in got)
        assert stage(spark, df.limit(0), "").collect() == [], name
    out = corpus_pipeline.byte_bpe(spark, df, "").collect()
    assert len(out) == len(rows) and corpus_pipeline.byte_bpe(spark, df.limit(0), "").count() == 0
