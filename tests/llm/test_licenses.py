import math
import random
from collections import Counter

import pytest

from weft.llm.licenses import FILES, HEADERS, _TERM, Templates, license_scan, scan


def cosine(templates, text, k):
    def vector(bag):
        return {t: (1 + math.log(c)) * templates.idf.get(t, templates.unknown) for t, c in bag.items()}

    a = vector(Counter(_TERM.findall(text)))
    b = vector(Counter(_TERM.findall((HEADERS + FILES)[k][1].lower().encode())))
    norm = math.sqrt(sum(x * x for x in a.values())) * math.sqrt(sum(x * x for x in b.values()))
    return sum(x * b.get(t, 0) for t, x in a.items()) / norm if norm else 0.0


def test_no_match_is_lost_by_strong_terms():
    templates, r = Templates(HEADERS), random.Random(1)
    words = b" ".join(t.lower().encode() for _, t in HEADERS).split() + [b"other", b"words"]
    for _ in range(3000):
        text = b" ".join(r.choice(words) for _ in range(r.randint(1, 12)))
        all_of = [cosine(templates, text, k) for k in range(len(HEADERS))]
        found = templates.best(text)
        if found is None:
            assert max(all_of) < templates.threshold + 1e-9
        else:
            assert found[1] == pytest.approx(max(all_of))


FILES_KIND = "id long, path string, text string, license string, folder string"


def test_inheritance(spark):
    mit = "x\nReleased under the MIT License.\ncode"
    rows = [
        (1, "a/LICENSE", FILES[0][1]), (2, "a/b/c/file.py", "code"), (3, "a/b/COPYING", HEADERS[8][1]), (4, "a/b/c/d/file.py", mit), (5, "a/file.py", None), (6, "other/file.py", ""), (7, None, mit), (8, None, "code"),
        (9, "file.py", "code"), (10, "a/b/c/d/file2.py", "code " * 50_000), (6, "other/file.py", ""),
    ]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], FILES_KIND)
    out = sorted(((r["id"], r["license"], r["inherited_from"]) for r in license_scan(df).collect()), key=repr)
    want = [(1, "MIT", None), (2, "GPL-3.0", "a/b"), (3, "GPL-3.0", None), (4, "MIT", None), (5, "MIT", "a"), (6, None, None), (6, None, None), (7, "MIT", None), (8, None, None), (9, None, None), (10, "GPL-3.0", "a/b")]
    assert out == sorted(want, key=repr)
    assert license_scan(df.limit(0)).count() == 0


def test_root_licence_and_ties(spark):
    rows = [(1, "LICENSE", HEADERS[0][1]), (2, "x/y.txt", ""), (3, "d/LICENSE", HEADERS[0][1]), (4, "d/COPYING", HEADERS[3][1]), (5, "d/f", "")]
    df = spark.createDataFrame([(*r, "c", "c") for r in rows], FILES_KIND)
    out = {r["id"]: (r["license"], r["inherited_from"]) for r in license_scan(df).collect()}
    assert out[2] == ("MIT", "") and out[5] == ("Apache-2.0", "d")


def test_lines(spark):
    text = "intro\nThis work is licensed under the GNU General Public License, version 3.\nLicensed under CC BY-NC 4.0.\nthe license of this file is under discussion in the public forum"
    df = spark.createDataFrame([(1, "p", text, "c", "c")], FILES_KIND)
    r = scan(df, "id", "path", "text").first()
    assert (r["own_license"], r["line"]) == ("GPL-3.0", 1) and r["score"] == pytest.approx(1)


def test_whole_licence_files(spark):
    """Whole licences with other names in them, and what is installed on this machine as far as there is any."""
    texts = [(name, text.replace("<year>", "2021").replace("<copyright holders>", "Some Body")) for name, text in FILES]
    rows = [(i, f"d{i}/LICENSE.txt", f"Some Project\n\n{t}\nWith thanks to all.", "c", "c") for i, (_, t) in enumerate(texts)]
    out = {r["id"]: r["own_license"] for r in scan(spark.createDataFrame(rows, FILES_KIND), "id", "path", "text").collect()}
    assert [out[i] for i in range(len(texts))] == [name for name, _ in texts]


def test_wrapped_notices(spark):
    text = "# code\n# Licensed under the Apache License,\n# Version 2.0 (the \"License\"); you may not use this\n# file except in compliance with the License.\nx = 1\n"
    r = scan(spark.createDataFrame([(1, "p", text, "c", "c")], FILES_KIND), "id", "path", "text").first()
    assert (r["own_license"], r["line"]) == ("Apache-2.0", 1) and r["score"] > 0.95


def test_inheritance_by_walking_up(spark):
    r = random.Random(4)
    paths = ["/".join(r.choice("ab") for _ in range(r.randint(0, 4))) for _ in range(120)]
    rows = [(i, f"{p}/{n}" if p else n, t, "c", "c") for i, (p, (n, t)) in enumerate((p, r.choice([("LICENSE", r.choice(HEADERS)[1]), ("f.py", "x"), ("g.py", "")])) for p in paths)]
    df = spark.createDataFrame(rows, FILES_KIND)
    own = {x["id"]: x["own_license"] for x in scan(df, "id", "path", "text").collect()}
    votes = {}
    for i, p, _, _, _ in rows:
        if p.endswith("LICENSE"):
            votes.setdefault(p[: -len("LICENSE")].rstrip("/"), Counter())[own[i]] += 1
    for x in license_scan(df).collect():
        at, want = x["path"].rpartition("/")[0], own[x["id"]]
        while want is None:
            if at in votes:
                want = min(votes[at].items(), key=lambda v: (-v[1], v[0]))[0]
                break
            if not at:
                break
            at = at.rpartition("/")[0]
        assert x["license"] == want, x


def test_recall_on_planted_notices(spark):
    import re

    from weft.llm.query_licenses import op1_licenses

    sf = "/root/testdata/sf0.01"
    planted = re.compile(r"(?im)^(released|licensed|this work is licensed) under .*(license|cc by|public)")
    has = {r["doc_id"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if planted.search(r["text"] or "")}
    found = {r["doc_id"] for r in op1_licenses(spark, sf).collect() if r["own_license"]}
    assert len(has) > 5 and len(has & found) >= 0.9 * len(has) and len(found - has) <= 0.1 * len(has)


def test_every_header_has_a_key():
    from weft.llm.licenses import KEYS

    assert all(not KEYS.isdisjoint(_TERM.findall(text.lower().encode())) for _, text in HEADERS)
