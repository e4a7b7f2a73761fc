"""Quality rules by distribution divergence.

Each document gives two histograms: characters by class, and words by the common words of its language with one bin for all
others. Both are compared with the reference of the language, which is gathered from all documents of that language that
pass the base rules, by the Jensen-Shannon distance (square root of the divergence in bits, 0 to 1). A document far from
its reference is rejected. Distances of short texts are noisy, so each test has a minimum length: below it the test has no say.

Counting runs in one pass over whole texts; what is left of a document is a short row, and distances are DataFrame functions.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, map_batches, row_of, texts, written

# Frequent function words of the languages, in natural order of frequency lists.
COMMON_WORDS = {
    "en": "the of and to in a is that for it was on are as with be by this at from or not but which they his have an were their".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec aux ou son".split(),
    "es": "de la que el en y a los del se las por un para con no una su al lo como más es o pero sus le ha me si".split(),
}
#: Bins of the word histogram: so many words, and one for the others.
N_WORDS = 30

#: Classes of characters. Bytes inside a multi-byte character count with its first byte.
LOWER, UPPER, DIGIT, SPACE, BREAK, POINT, SYMBOL, OTHER, WIDE = range(9)
N_CLASSES = 9
_SKIP = 9
_POINTS = b".,;:!?'\"()-"


def _class_table() -> bytes:
    def of(b: int) -> int:
        c = bytes([b])
        if b >= 0xC0:
            return WIDE
        if b >= 0x80:
            return _SKIP
        if c.islower():
            return LOWER
        if c.isupper():
            return UPPER
        if c.isdigit():
            return DIGIT
        if b == 0x20:
            return SPACE
        if 9 <= b <= 13:
            return BREAK
        if c in _POINTS:
            return POINT
        return SYMBOL if 0x20 < b < 0x7F else OTHER

    return bytes(map(of, range(256)))


_CLASSES = _class_table()
_SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Rules:
    """Limits of the rules. Distances are Jensen-Shannon distances to the language's reference."""

    min_words: int = 50
    max_repeated_percent: int = 50
    #: Characters outside white space that the class test needs, and its limit.
    min_class_chars: int = 200
    max_class_distance: float = 0.28
    #: Words that the common-word test needs, and its limit.
    min_common_words: int = 80
    max_word_distance: float = 0.325


def counts(raw: bytes, common: dict[bytes, int]) -> tuple:
    """Base counts and the histograms of a whole text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, classes, words."""
    words = raw.split()
    classes = np.bincount(np.frombuffer(raw.translate(_CLASSES), np.uint8), minlength=_SKIP + 1)[:N_CLASSES]
    symbols = sum(map(raw.count, (bytes([b]) for b in _SYMBOLS)))
    lines = [x for x in raw.split(b"\n") if x.strip(SPACES)]
    repeated = 0
    threes = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(threes)) < len(threes):
        seen, last = Counter(threes), -1
        for i, t in enumerate(threes):
            if seen[t] > 1:
                repeated += i + 2 - max(i - 1, last)
                last = i + 2
    bins = [0] * (N_WORDS + 1)
    get = common.get
    for w, n in Counter(raw.lower().split()).items():
        bins[get(w, N_WORDS)] += n
    return len(words), int(classes.sum() - classes[SPACE] - classes[BREAK]), symbols, len(lines) - len(set(lines)), repeated, classes.tolist(), bins


FEATURES = (
    "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, classes array<long>, words array<long>"
)


def features(docs: DataFrame, carried: bool = False) -> DataFrame:
    """:func:`counts` of every whole text of ``docs`` (doc_id, text, lang), with its id and language, and if ``carried`` the row itself as ``doc``."""
    index = {lang: {w.encode(): i for i, w in enumerate(words[:N_WORDS])} for lang, words in COMMON_WORDS.items()}
    kinds = [pa.int64()] * 5 + [pa.list_(pa.int64())] * 2
    names = [c.split()[0] for c in FEATURES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(1).to_pylist()
            made = [counts(raw, index.get(lang, {})) for raw, lang in zip(texts(batch.column(2)), langs, strict=True)]
            columns = list(zip(*made, strict=True)) or [()] * len(kinds)
            own = [batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))]
            yield pa.RecordBatch.from_arrays([*own, batch.column(3)] if carried else own, names=[*names, "doc"] if carried else names)

    source = docs.select(docs["doc_id"].cast("long"), docs["lang"].cast("string"), docs["text"].cast("string"), *([row_of(docs).alias("doc")] if carried else []))
    return map_batches(source, run, f"{FEATURES}, doc {source.schema['doc'].dataType.simpleString()}" if carried else FEATURES)


def _summed(column: str, n: int) -> Column:
    return F.array(*(F.sum(F.col(column)[i]) for i in range(n)))


def references(found: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Histograms of each language (null is one) over all its documents that pass the base rules: ``lang``, ``ref_classes``, ``ref_words``."""
    usable = found.where(~base_failed(rules))
    return usable.groupBy("lang").agg(_summed("classes", N_CLASSES).alias("ref_classes"), _summed("words", N_WORDS + 1).alias("ref_words"))


def base_failed(rules: Rules = Rules()) -> Column:
    return (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeated_percent * F.col("n_words"))


def distance(a: str, b: str, n: int) -> Column:
    """Jensen-Shannon distance of two histograms of ``n`` bins; null if either is empty or null."""

    def total(column: str) -> Column:
        return sum((F.col(column)[i] for i in range(1, n)), F.col(column)[0]).cast("double")

    def part(p: Column, m: Column) -> Column:
        return F.when(p > 0, p * F.log2(p / m)).otherwise(0.0)

    def of(x: Column) -> Column:
        p, q = x["p"], x["q"]
        m = (p + q) / 2
        return (part(p, m) + part(q, m)) / 2

    shares = F.zip_with(F.col(a), F.col(b), lambda x, y: F.struct((x / F.col(f"_n_{a}")).alias("p"), (y / F.col(f"_n_{b}")).alias("q")))
    summed = F.aggregate(shares, F.lit(0.0), lambda acc, x: acc + of(x))
    return F.when((total(a) > 0) & (total(b) > 0), F.sqrt(F.greatest(summed, F.lit(0.0))))


def kept_documents(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The documents that :func:`judged` keeps, with their columns; rows are judged each, so ids needn't be unique."""
    return judged(docs, rules, carried=True).where("kept").select("doc.*")


def judged(docs: DataFrame, rules: Rules = Rules(), carried: bool = False) -> DataFrame:
    """The verdict on every document: ``doc_id``, the base counts, ``base_failed``, both distances and ``kept``.

    Null texts have no words and fail the base rules. Documents of a null or unknown language are compared with the documents of
    the same; as no common words are known for it, all its words are in one bin and only the class test can reject.
    Where no document of a language passes the base rules there is no reference, and distances are null. A null distance or a text below a
    test's minimum length never rejects. Repeated rows are judged each; an empty table gives no rows.
    """
    found = written(features(docs, carried), "features")
    ref = written(references(found, rules), "references")  # a few rows: Spark broadcasts them if they are small
    both = found.join(ref.withColumnRenamed("lang", "_lang"), F.col("lang").eqNullSafe(F.col("_lang")), "left")
    for c in ("classes", "words", "ref_classes", "ref_words"):
        both = both.withColumn(f"_n_{c}", F.nullif(F.aggregate(F.col(c), F.lit(0).cast("long"), lambda a, x: a + x).cast("double"), F.lit(0.0)))
    both = both.select(
        "*", distance("classes", "ref_classes", N_CLASSES).alias("class_distance"), distance("words", "ref_words", N_WORDS + 1).alias("word_distance")
    )
    class_far = (F.col("word_chars") >= rules.min_class_chars) & (F.col("class_distance") > rules.max_class_distance)
    words_far = (F.col("n_words") >= rules.min_common_words) & (F.col("word_distance") > rules.max_word_distance)
    far = F.coalesce(class_far, F.lit(False)) | F.coalesce(words_far, F.lit(False))
    failed = base_failed(rules)
    return both.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~far).alias("kept"), "class_distance", "word_distance",
        *(["doc"] if carried else []),
    )


def oracle(table: str = "documents", rules: Rules = Rules()) -> str:
    """DuckDB SQL for the columns of :func:`judged` but the distances."""
    words = ", ".join(f"('{lang}', '{w}', {i})" for lang, many in COMMON_WORDS.items() for i, w in enumerate(many[:N_WORDS]))
    classes = ["[a-z]", "[A-Z]", "[0-9]", r"\x20", r"[\x09-\x0D]", r"""[.,;:!?''"()\-]""", r"""[#$%&*+/<=>@\[\\\]^_`{|}~]""", r"[\x00-\x08\x0E-\x1F\x7F]", r"[^\x00-\x7F]"]
    counted = ", ".join(f"length(text) - length(regexp_replace(text, '{c}', '', 'g'))" for c in classes)

    def js(mine: str, ref: str) -> str:
        part = "CASE WHEN {0} > 0 THEN {0} * log2({0} / (({0} + {1}) / 2)) ELSE 0 END"
        return f"sqrt(greatest(sum(({part.format(mine, ref)} + {part.format(ref, mine)}) / 2), 0))"

    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, CAST(doc_id AS BIGINT) AS doc_id, coalesce(text, '') AS text, lang FROM {table}),
split AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words FROM docs),
word AS (SELECT r, lang, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM split),
three AS (
  SELECT r, i, w, lead(w) OVER s AS w2, lead(w, 2) OVER s AS w3 FROM word WINDOW s AS (PARTITION BY r ORDER BY i)),
often AS (SELECT r, unnest(list(i)) AS i FROM three WHERE w3 IS NOT NULL GROUP BY r, w, w2, w3 HAVING count(*) > 1),
repeated AS (SELECT r, count(DISTINCT i + k) AS n FROM often, range(3) t(k) GROUP BY r),
line AS (SELECT r, unnest(string_split(text, chr(10))) AS l FROM docs),
dup AS (SELECT r, count(*) - count(DISTINCT l) AS n FROM line WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY r),
base AS (
  SELECT s.r, s.doc_id, s.lang, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(d.n, 0) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(p.n, 0) AS BIGINT) AS n_repeat_words, [{counted}] AS classes
  FROM split s LEFT JOIN dup d USING (r) LEFT JOIN repeated p USING (r)),
judged AS (SELECT *, n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeated_percent} * n_words AS base_failed FROM base),
common(lang, w, bin) AS (VALUES {words}),
bins AS (
  SELECT x.r, coalesce(c.bin, {N_WORDS}) AS bin, count(*) AS n
  FROM word x LEFT JOIN common c ON c.lang = x.lang AND c.w = translate(x.w, '{upper}', '{lower}') GROUP BY x.r, coalesce(c.bin, {N_WORDS})),
hist AS (
  SELECT 'c' AS kind, r, k AS bin, CAST(classes[k + 1] AS DOUBLE) AS n FROM judged, range({N_CLASSES}) t(k)
  UNION ALL
  SELECT 'w', j.r, k, CAST(coalesce(b.n, 0) AS DOUBLE) FROM judged j CROSS JOIN range({N_WORDS + 1}) t(k) LEFT JOIN bins b ON b.r = j.r AND b.bin = k),
ref AS (SELECT kind, lang, bin, sum(n) AS n FROM hist JOIN judged USING (r) WHERE NOT base_failed GROUP BY kind, lang, bin),
mine AS (SELECT kind, r, bin, n / nullif(sum(n) OVER (PARTITION BY kind, r), 0) AS p FROM hist),
theirs AS (SELECT kind, lang, bin, n / nullif(sum(n) OVER (PARTITION BY kind, lang), 0) AS q FROM ref),
distance AS (
  SELECT m.kind, m.r, {js("p", "q")} AS d
  FROM mine m JOIN judged j USING (r) JOIN theirs t ON t.kind = m.kind AND t.lang IS NOT DISTINCT FROM j.lang AND t.bin = m.bin GROUP BY m.kind, m.r)
SELECT j.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(word_chars >= {rules.min_class_chars} AND c.d > {rules.max_class_distance}, false)
         AND NOT coalesce(n_words >= {rules.min_common_words} AND w.d > {rules.max_word_distance}, false) AS kept
FROM judged j LEFT JOIN distance c ON c.r = j.r AND c.kind = 'c' LEFT JOIN distance w ON w.r = j.r AND w.kind = 'w'
"""
