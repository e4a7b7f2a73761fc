"""Mixing sources to target weights: capped water-filling and seeded whole and fractional repetitions.

Each source has a weight and a size in words. The mix has as many words as all sources together. A source's target is its
share by weight, but at most ``epochs`` times its own size; what is cut off is shared by weight among the others
until no target is above its cap. With the sources in the order of cap over weight, the level
(target over weight) of those below their cap has a closed form, so no loop is needed.

A target is met by whole repetitions of all documents of the source and a sample for the rest: documents are ordered by
a seeded digest of their id and taken while their words fit in what is left. Where one doesn't fit it is passed over, and the order goes on with those that do
fit in what is missing, and so on: ``ROUNDS`` times. What is then still missing, less than a document as a rule, is filled with
further documents, the largest first, out of one per size class and digest group: some hundred candidates per source at most. The
place where the order is cut is found in two steps, words by digest prefix and then documents of a single prefix, so that no source
is ever sorted as a whole.

DataFrame functions only; the documents themselves are never shuffled, only one row per source meets them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, column_name, row_of, written

WEIGHTS = (5, 2, 1)
EPOCHS = 3
SEED = "mix-1"
#: Digest prefixes have so many hexadecimal digits: 65,536 of them.
PREFIX = 4
#: How often the order of a source goes on behind a document that doesn't fit.
ROUNDS = 4


def word_count(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def document_key(doc_id: Column, seed: str) -> Column:
    """The digest that orders documents."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """``source``, ``source_size``, ``weight``, ``target`` from rows of ``source`` and ``size``: one row per source, null as one of them."""
    total = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weighted = total.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("double"))
    capped = weighted.withColumn("cap", (epochs * F.col("source_size")).cast("double")).withColumn("ratio", F.col("cap") / F.col("weight"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    left = (F.sum("source_size").over(everything) - F.coalesce(epochs * F.sum("source_size").over(before), F.lit(0))).cast("double")
    stepped = capped.withColumn("step", F.row_number().over(order)).withColumn("level", left / F.sum("weight").over(onward))
    # the first step whose level leaves all that follow at or below their caps
    met = stepped.withColumn("first", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("step", "level"))).over(everything))
    filled = F.when(F.col("step") < F.col("first.step"), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("first.level") * F.col("weight")))
    return met.select("source", "source_size", F.col("weight").cast("long").alias("weight"), F.coalesce(filled, F.col("cap")).alias("target"))


def mix_parameters(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """One row per source: ``source``, ``source_size``, ``target``, ``whole`` repetitions, and which documents are sampled on top.

    ``sized`` has ``doc_id``, ``source``, ``size`` and ``key``. Sampled are documents that a round takes (:func:`sampled`) and those whose
    (key, doc_id, size) is among ``extra``.
    """
    base = source_targets(sized, weights, epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    base = base.withColumn("whole", whole).withColumn("missing", F.col("target") - F.col("whole") * F.col("source_size"))
    base = written(base.select("source", "source_size", "target", "whole", "missing"), "targets")
    keyed = sized.where("size > 0").withColumn("prefix", F.substring("key", 1, PREFIX))
    for r in range(ROUNDS):
        base = _round(keyed, base, r)
    left = _with_source(keyed, base).where(~sampled(ROUNDS) & (F.col("size") <= F.col("missing")))
    candidates = left.groupBy("source", size_class().alias("class"), F.substring("key", 32, 1).alias("group")).agg(F.min(F.struct("key", "doc_id", "size")).alias("c"), F.first("missing").alias("missing"))
    listed = candidates.groupBy("source").agg(F.first("missing").alias("missing"), F.array_sort(F.collect_list(F.struct((-F.col("c.size")).alias("order"), "c.key", "c.doc_id", "c.size"))).alias("all"))
    none = F.filter("all", lambda x: F.lit(False))
    picked = F.aggregate(
        "all", F.struct(F.col("missing").alias("missing"), none.alias("picked")),
        lambda acc, x: F.when(x["size"] <= acc["missing"], F.struct((acc["missing"] - x["size"]).alias("missing"), F.concat(acc["picked"], F.array(x)).alias("picked"))).otherwise(acc),
        lambda acc: acc["picked"],
    )
    extra = listed.select("source", picked.alias("extra"))
    base = base.join(extra.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left")
    return written(base.select("source", "source_size", "target", "whole", *_of_rounds(ROUNDS), "extra"), "mix")


def _of_rounds(n: int) -> list[str]:
    return [f"{c}{r}" for r in range(n) for c in ("most", "cut", "last")]


def _round(keyed: DataFrame, base: DataFrame, r: int) -> DataFrame:
    """``base`` after one more round, which takes documents of at most ``missing`` words that no round before took, in the order of their digests while they fit.

    ``most`` is the size that fits, ``cut`` the digest prefix in which the words run out, and ``last`` the last document of that prefix that is taken.
    """
    open_ = _with_source(keyed, base).where(~sampled(r) & (F.col("size") <= F.col("missing")))
    steps = open_.groupBy("source", "prefix").agg(F.sum("size").alias("words"), F.first("missing").alias("missing"))
    rising = steps.withColumn("upto", F.sum("words").over(Window.partitionBy("source").orderBy("prefix")))
    over = F.col("upto") > F.col("missing")
    found = rising.groupBy(F.col("source").alias("s")).agg(F.min(F.when(over, F.col("prefix"))).alias("cut"), F.max(F.when(~over, F.col("upto"))).alias("before"))
    named = base.join(found, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    # "~" is behind all prefixes: everything fits
    named = named.select(*base.columns, F.col("missing").alias(f"most{r}"), F.coalesce("cut", F.lit("~")).alias(f"cut{r}"), F.coalesce("before", F.lit(0)).alias("before"))
    named = written(named, "cuts")
    # documents of that prefix; rows that share key and id are taken together
    inside = _with_source(keyed, named).where((F.col("prefix") == F.col(f"cut{r}")) & ~sampled(r) & (F.col("size") <= F.col("missing")))
    upto = F.col("before") + F.sum("size").over(Window.partitionBy("source").orderBy("key", "doc_id"))
    last = inside.withColumn("upto", upto).where(F.col("upto") <= F.col("missing")).groupBy("source").agg(F.max(F.struct("upto", "key", "doc_id")).alias(f"last{r}"))
    met = named.join(last.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    missing = F.col("missing") - F.coalesce(F.col(f"last{r}.upto"), F.col("before"))
    return written(met.withColumn("missing", missing).drop("before"), "rounds")


def _with_source(rows: DataFrame, base: DataFrame) -> DataFrame:
    """Rows with what ``base`` has of their source; ``base`` has one row per source and is broadcast only if Spark finds it small."""
    of = base.withColumnRenamed("source", "_source")
    return rows.join(of, rows["source"].eqNullSafe(of["_source"])).drop("_source")


def size_class() -> Column:
    """Sizes by number of digits and first digit."""
    digits = F.col("size").cast("string")
    return F.concat(F.length(digits).cast("string"), F.substring(digits, 1, 1))


def sampled(rounds: int) -> Column:
    """Whether one of the first rounds takes a document; needs ``prefix``, ``key``, ``doc_id`` and ``size``."""
    first = F.lit(-(1 << 63))
    taken = F.lit(False)
    for r in range(rounds):
        last, cut = F.col(f"last{r}"), F.col(f"cut{r}")
        inside = (F.col("key") < last["key"]) | ((F.col("key") == last["key"]) & (F.coalesce(F.col("doc_id"), first) <= F.coalesce(last["doc_id"], first)))
        within = F.coalesce((F.col("prefix") < cut) | ((F.col("prefix") == cut) & inside), F.lit(False))
        taken = taken | (within & (F.col("size") <= F.col(f"most{r}")))
    return taken & (F.col("size") > 0)


def copies() -> Column:
    """How often the mix takes a document, by the columns of :func:`mix_parameters` and ``prefix``, ``key``, ``doc_id`` and ``size``."""
    is_extra = F.exists("extra", lambda e: (F.col("key") == e["key"]) & F.col("doc_id").eqNullSafe(e["doc_id"]) & (F.col("size") == e["size"]))
    return F.col("whole") + F.when(sampled(ROUNDS) | F.coalesce(is_extra, F.lit(False)), 1).otherwise(0)


def sizes(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """``doc_id``, ``source``, ``size`` and ``key`` of documents."""
    doc_id = F.col("doc_id").cast("long")
    return docs.select(doc_id.alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), document_key(doc_id, seed).alias("key"))


def mixed_sizes(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, seed: str = SEED) -> DataFrame:
    """``doc_id``, ``size``, ``source_size``, ``target``, ``taken`` (words that the mix takes of it) and ``copies`` of every document.

    Null texts have no words; a null source is a source, last in order; null and repeated ids are taken like others, equal (id,
    source, size) together. Sources without words have a target of 0. An empty table gives no rows. Other columns are
    not read.
    """
    sized = written(sizes(docs, seed), "sizes")
    rows = _with_source(sized, mix_parameters(sized, weights, epochs)).withColumn("prefix", F.substring("key", 1, PREFIX)).withColumn("copies", copies())
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, seed: str = SEED) -> DataFrame:
    """The mix itself: every document as many times as it is taken, with all its columns.

    Documents without words are not taken: no target counts them.
    """
    parameters = mix_parameters(written(sizes(docs, seed), "sizes"), weights, epochs)
    row = column_name(docs, "mix_row")
    doc_id = F.col(f"{row}.doc_id").cast("long")
    packed = docs.select(row_of(docs).alias(row))
    keyed = packed.select(
        row, doc_id.alias("doc_id"), F.col(f"{row}.source").cast("string").alias("source"), word_count(F.col(f"{row}.text")).alias("size"), document_key(doc_id, seed).alias("key")
    ).withColumn("prefix", F.substring("key", 1, PREFIX))
    taken = _with_source(keyed.where("size > 0"), parameters).withColumn("copies", copies()).where("copies > 0")
    repeated = taken.select(row, F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    return repeated.select(f"{row}.*")


def oracle(table: str = "documents", weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, seed: str = SEED) -> str:
    """DuckDB SQL for :func:`mixed_sizes`, with plain windows over whole sources."""
    cases = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(weights))
    rounds = "\n".join(f"""risen{r} AS (
  SELECT *, sum(CASE WHEN taken OR size > missing THEN 0 ELSE size END) OVER (PARTITION BY source ORDER BY key, doc_id) AS upto FROM round{r}),
round{r + 1} AS (
  SELECT doc_id, size, key, source, source_size, target, whole,
         missing - max(CASE WHEN upto <= missing THEN upto ELSE 0 END) OVER (PARTITION BY source) AS missing, taken OR (size > 0 AND size <= missing AND upto <= missing) AS taken
  FROM risen{r}),""" for r in range(ROUNDS))
    return f"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key
  FROM {table}),
total AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighted AS (
  SELECT *, CAST(CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % {len(weights)} {cases} END AS DOUBLE) AS weight FROM total),
capped AS (SELECT *, CAST({epochs} * source_size AS DOUBLE) AS cap, CAST({epochs} * source_size AS DOUBLE) / weight AS ratio FROM weighted),
stepped AS (
  SELECT *, row_number() OVER o AS step,
         CAST(sum(source_size) OVER () - coalesce({epochs} * sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
           / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM capped WINDOW o AS (ORDER BY ratio, source ASC NULLS LAST)),
met AS (SELECT min(step) AS step, arg_min(level, step) AS level FROM stepped WHERE level <= ratio),
target AS (
  SELECT s.source, s.source_size, coalesce(CASE WHEN s.step < m.step THEN s.cap ELSE least(s.cap, m.level * s.weight) END, s.cap) AS target
  FROM stepped s, met m),
base AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM target),
round0 AS (
  SELECT d.doc_id, d.size, d.key, b.*, b.target - b.whole * b.source_size AS missing, false AS taken
  FROM sized d JOIN base b ON d.source IS NOT DISTINCT FROM b.source),
{rounds}
candidate AS (
  SELECT source, any_value(missing) AS missing, min(struct_pack(k := key, i := doc_id, z := size)) AS c
  FROM round{ROUNDS} WHERE NOT taken AND size > 0 AND size <= missing
  GROUP BY source, length(CAST(size AS VARCHAR)) || substr(CAST(size AS VARCHAR), 1, 1), substr(key, 32, 1)),
listed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY c.z DESC, c.k, c.i NULLS FIRST) AS n FROM candidate),
filled(source, n, missing, picked, c) AS (
  SELECT source, CAST(0 AS BIGINT), missing, false, c FROM listed WHERE n = 1
  UNION ALL
  SELECT l.source, l.n, CASE WHEN l.c.z <= f.missing THEN f.missing - l.c.z ELSE f.missing END, l.c.z <= f.missing, l.c
  FROM filled f JOIN listed l ON l.source IS NOT DISTINCT FROM f.source AND l.n = f.n + 1),
extra AS (SELECT source, c FROM filled WHERE picked),
marked AS (
  SELECT c.*, c.whole + CASE WHEN c.source_size > 0 AND (c.taken OR e.c IS NOT NULL) THEN 1 ELSE 0 END AS times
  FROM round{ROUNDS} c LEFT JOIN extra e ON c.source IS NOT DISTINCT FROM e.source AND c.key = e.c.k AND c.doc_id IS NOT DISTINCT FROM e.c.i AND c.size = e.c.z)
SELECT doc_id, size, source_size, target, CAST(size * times AS BIGINT) AS taken, CAST(times AS BIGINT) AS copies FROM marked
"""
