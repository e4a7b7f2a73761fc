import math
import random
from collections import Counter

from weft.llm.divergence import COMMON_WORDS, N_CLASSES, Rules, counts, judged, kept_documents

KIND = "doc_id long, text string, lang string, classes string, doc string"


def prose(r, lang, n):
    return " ".join(r.choice(COMMON_WORDS[lang]) if r.random() < 0.5 else "".join(r.choice("abcdefgé") for _ in range(r.randint(2, 9))) for _ in range(n)).capitalize() + "."


def plain(text):
    """The base counts by their definitions."""
    import re

    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    threes = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(threes)
    covered = {j for i, t in enumerate(threes) if seen[t] > 1 for j in range(i, i + 3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered)


def odd():
    return [None, "", " \t\x0b\n", "a", "a b", "a b c a b c", "ab\nab\n\nab \nab", "x " * 80, "Éa # [b] 漢字 🙂\x85q\x1cz", "a b c d a b c e a b c", "l\n" * 5]


def test_base_counts():
    r = random.Random(1)
    texts = odd() + [" ".join(r.choice("ab") for _ in range(r.randint(0, 30))) for _ in range(200)]
    for t in texts:
        assert counts((t or "").encode(), {})[:5] == plain(t), t


def jsd(p, q):
    a, b = sum(p), sum(q)
    out = 0.0
    for x, y in zip(p, q):
        x, y = x / a, y / b
        m = (x + y) / 2
        out += ((x * math.log2(x / m) if x else 0) + (y * math.log2(y / m) if y else 0)) / 2
    return math.sqrt(max(out, 0))


def test_verdicts_against_plain_python(spark):
    r = random.Random(2)
    rows = [(i, prose(r, lang, r.randint(40, 300)), lang) for i, lang in enumerate(["en", "de", "fr", "es"] * 20)]
    rows += [(1000 + i, t, "en") for i, t in enumerate(odd())]
    rows += [(2000, " ".join(w + "###" for w in prose(r, "en", 200).split()), "en"), (2001, prose(r, "en", 200).upper() + "!!", "en"), (2002, " | ".join("".join(r.choice("abcde") for _ in range(6)) for _ in range(150)), "en"), (2003, prose(r, "en", 120), None), (2003, prose(r, "en", 120), None), (2004, prose(r, "en", 120), "xx")]
    df = spark.createDataFrame([(*x, "c", "d") for x in rows], KIND)
    rules = Rules()
    found = [(i, lang, counts((t or "").encode(), {w.encode(): k for k, w in enumerate(COMMON_WORDS.get(lang, [])[:30])})) for i, t, lang in rows]
    failed = lambda c: c[0] < 50 or 100 * c[4] > 50 * c[0]
    refs = {}
    for _, lang, c in found:
        if not failed(c):
            old = refs.get(lang, ([0] * N_CLASSES, [0] * 31))
            refs[lang] = ([a + b for a, b in zip(old[0], c[5])], [a + b for a, b in zip(old[1], c[6])])
    want = []
    for i, lang, c in found:
        keep = not failed(c)
        if keep:
            keep = not (c[1] >= rules.min_class_chars and jsd(c[5], refs[lang][0]) > rules.max_class_distance) and not (c[0] >= rules.min_common_words and jsd(c[6], refs[lang][1]) > rules.max_word_distance)
        want.append((i, *c[:5], failed(c), keep))
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    assert sorted(map(tuple, judged(df).select(*names).collect())) == sorted(want)
    kept = {x[0] for x in want if x[-1]}
    assert {2000, 2001, 2002}.isdisjoint(kept) and len(kept) > 60
    stay = kept_documents(df)
    assert stay.columns == df.columns and sorted(x["doc_id"] for x in stay.collect()) == sorted(x[0] for x in want if x[-1])


def test_empty(spark):
    empty = spark.createDataFrame([], KIND)
    assert judged(empty).count() == 0 and kept_documents(empty).count() == 0
