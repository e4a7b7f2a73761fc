"""SimHash near-duplicates by a self-join of binary tries.

A fingerprint has a bit for each bit of the shingles' XXH64 values, set if more than half the shingles have it set. Two
fingerprints are linked if they differ in at most ``budget`` bits.

Distinct fingerprints are cut into ``budget`` + 1 runs of bits; two linked ones agree in at least one run. For each run
they are dealt out by its value, rotated so that it comes first, and sorted: a sorted array is a binary trie whose nodes are
ranges. Node pairs are traversed together, starting with each run value against itself: a pair has up to four pairs of
children, those of unequal bits cost one of the budget, and a pair beyond it is dropped with all below. Links
are joined to forests inside the task, so a task never gives more edges than it has fingerprints.

A run value with very many fingerprints is dealt out once more, by pairs of the trie's nodes some levels below that are within
the budget: the same traversal, started at those pairs.

Near copies by similarity (:func:`first_of_near_copies`) differ in more bits than a short fingerprint can be cut for. They have one of some
hundred bits, cut into so many runs that near copies agree in at least one of them (all but a share of ``MISSED`` of those that are just similar enough);
who agrees in one meets in a trie of 64 more bits. What links there is joined to clouds, whose texts alone are compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Side, map_batches, texts, with_places, without_places, written
from .components import components

BITS = 64
SEED = 42
#: A run value with more fingerprints than this, and than eight times the mean, is dealt out by node pairs.
HEAVY = 1000
#: Levels below a heavy run value at which its node pairs are dealt out.
LEVELS = 6
_CHUNK = 1 << 16
_PRODUCTS = 1 << 20


# --- fingerprints ----------------------------------------------------------------------------------------------


def shingle_hashes(raw: bytes, width: int) -> list[int]:
    """XXH64 of every shingle of ``width`` words, A-Z in lower case; fewer words make one shingle, none none."""
    words = raw.lower().split()
    if not words:
        return []
    digest = xxhash.xxh64_intdigest
    line = b" ".join(words)
    if len(words) <= width:
        return [digest(line, SEED)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    return [digest(line[a:b], SEED) for a, b in zip(starts[: 1 - width].tolist(), (ends[width - 1 :] - 1).tolist(), strict=True)]


def fingerprint(raw: bytes, width: int = 3) -> int:
    """The fingerprint of a text, unsigned; 0 without words."""
    hashes = np.array(shingle_hashes(raw, width), "<u8")
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 4096):
        bits = np.unpackbits(hashes[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """``doc_id`` and ``fp`` (the fingerprint as a signed long) of every whole text; a null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(raw, width) for raw in texts(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return map_batches(docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")), run, "doc_id long, fp long")


# --- trie self-join --------------------------------------------------------------------------------------------


def _runs(budget: int) -> list[tuple[int, int]]:
    """Where each run of bits begins, counted from the highest, and its length."""
    cuts = [i * BITS // (budget + 1) for i in range(budget + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _split(codes: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """For ranges of sorted codes that share the bits above ``depth``, where the bit there turns from 0 to 1."""
    bit = (np.uint64(1) << (np.uint64(BITS - 1) - depth.astype(np.uint64))).astype(np.uint64)
    edge = (codes[lo] | bit) & ~(bit - np.uint64(1))  # the least code of the node's second child
    lo, hi = lo.copy(), hi.copy()
    while (todo := lo < hi).any():  # a binary search in all ranges at once
        mid = (lo + hi) >> 1
        up = todo & (codes[np.minimum(mid, len(codes) - 1)] < edge)
        lo = np.where(up, mid + 1, lo)
        hi = np.where(todo & ~up, mid, hi)
    return lo


def _ends(labels: np.ndarray) -> np.ndarray:
    """For each place the end of the stretch of equal labels that it lies in."""
    last = np.flatnonzero(np.concatenate([labels[1:] != labels[:-1], [True]])) + 1
    return np.repeat(last, np.diff(np.concatenate([[0], last])))


def _products(alo: np.ndarray, ahi: np.ndarray, blo: np.ndarray, bhi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All index pairs of each pair of ranges, of a range with itself each once."""
    width = bhi - blo
    n = (ahi - alo) * width
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    wide = np.repeat(width, n)
    up = at // wide
    i, j = np.repeat(alo, n) + up, np.repeat(blo, n) + at - up * wide
    once = np.repeat(alo != blo, n) | (i < j)
    return i[once], j[once]


def near_links(codes: np.ndarray, pairs: np.ndarray, budget: int, leaf: int = 1, labels: np.ndarray | None = None) -> Iterator[np.ndarray]:
    """Index pairs of sorted ``codes`` that differ in at most ``budget`` bits, below given pairs of nodes.

    ``pairs`` has columns (a from, a to, b from, b to, depth, errors): ranges of codes that share their first ``depth`` bits, and the bits
    in which these differ. A node paired with itself gives each link once. Pairs wait on a stack in chunks, so
    memory is bounded by the depth of the trie. Nodes of at most ``leaf`` codes are leaves; equal codes are given if they share a leaf. If there are
    ``labels``, which whoever takes the links may change, a pair of nodes that hold one label alone is dropped with all below.
    """
    stack = [pairs[i : i + _CHUNK] for i in range(0, len(pairs), _CHUNK)]
    while stack:
        p = stack.pop()
        if labels is not None and len(p):
            ends = _ends(labels)
            alo, ahi, blo, bhi = p[:, 0], p[:, 1], p[:, 2], p[:, 3]
            p = p[~((labels[alo] == labels[blo]) & (ends[alo] >= ahi) & (ends[blo] >= bhi))]
        alo, ahi, blo, bhi, depth, err = p.T
        small = ((ahi - alo <= leaf) & (bhi - blo <= leaf)) | (depth >= BITS)
        if small.any():
            todo = p[small]
            cost = np.cumsum((todo[:, 1] - todo[:, 0]) * (todo[:, 3] - todo[:, 2]))
            for part in np.split(todo, np.searchsorted(cost, np.arange(_PRODUCTS, cost[-1], _PRODUCTS))):
                if len(part):
                    i, j = _products(*part.T[:4])
                    ok = np.bitwise_count(codes[i] ^ codes[j]) <= budget
                    if ok.any():
                        yield np.stack([i[ok], j[ok]], 1)
            p = p[~small]
        if not len(p):
            continue
        alo, ahi, blo, bhi, depth, err = p.T
        amid, bmid = _split(codes, alo, ahi, depth), _split(codes, blo, bhi, depth)
        same = alo == blo
        below, more = depth + 1, err + 1
        children = np.concatenate([
            np.stack([alo, amid, blo, bmid, below, err], 1),
            np.stack([amid, ahi, bmid, bhi, below, err], 1),
            np.stack([alo, amid, bmid, bhi, below, more], 1),
            np.stack([amid, ahi, blo, bmid, below, more], 1)[~same],  # of a node with itself the mirror image
        ])
        live = (children[:, 0] < children[:, 1]) & (children[:, 2] < children[:, 3]) & (children[:, 5] <= budget)
        live &= ~((children[:, 0] == children[:, 2]) & (children[:, 1] - children[:, 0] == 1))  # a leaf with itself
        children = children[live]
        stack += [children[i : i + _CHUNK] for i in range(0, len(children), _CHUNK)]


def join_labels(labels: np.ndarray, links: np.ndarray) -> np.ndarray:
    """Labels (the smallest index that is linked) after more links."""
    i, j = links.T
    while True:
        a, b = labels[i], labels[j]
        apart = a != b
        if not apart.any():
            return labels
        np.minimum.at(labels, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (nearer := labels[labels]).tobytes() != labels.tobytes():
            labels = nearer


def _forest(rows: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what is linked among dealt-out rows (run, value, node a, node b, code).

    Rows of one (run, value, a, b) form a trie; a and b are -1 for a whole one.
    """
    rows = rows[np.lexsort((rows["code"], rows["b"], rows["a"], rows["value"], rows["run"]))]
    keys = rows[["run", "value", "a", "b"]]
    edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
    lo, hi = edge[:-1], edge[1:]
    wide = hi - lo > 1
    lo, hi = lo[wide], hi[wide]
    if not len(lo):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    codes = rows["code"]
    lengths = np.array([n for _, n in _runs(budget)])
    depth = lengths[rows["run"][lo]]
    a, b = rows["a"][lo], rows["b"][lo]
    err = np.bitwise_count((a ^ b).astype(np.uint16)).astype(np.int64)
    tile = a != b
    alo, ahi, blo, bhi, below = lo.copy(), hi.copy(), lo.copy(), hi.copy(), depth.copy()
    for t in np.flatnonzero(tile):  # rows of both nodes, a first
        cut = lo[t] + int(np.searchsorted(_node(codes[lo[t] : hi[t]], int(depth[t])), b[t]))
        ahi[t], blo[t], below[t] = cut, cut, depth[t] + LEVELS
    pairs = np.stack([alo, ahi, blo, bhi, below, np.where(tile, err, 0)], 1).astype(np.int64)
    pairs = pairs[(pairs[:, 0] < pairs[:, 1]) & (pairs[:, 2] < pairs[:, 3])]
    labels = np.arange(len(rows))
    for links in near_links(codes, pairs, budget):
        labels = join_labels(labels, links)
    moved = np.flatnonzero(labels != np.arange(len(rows)))
    fp = _rotated(codes, np.array([BITS - s for s, _ in _runs(budget)])[rows["run"]])
    return fp[moved].view(np.int64), fp[labels[moved]].view(np.int64)


def _node(codes: np.ndarray, depth: int) -> np.ndarray:
    return (codes >> np.uint64(BITS - depth - LEVELS)) & np.uint64((1 << LEVELS) - 1)


def _rotated(codes: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Codes rotated to the left by so many bits each."""
    left = (left % BITS).astype(np.uint64)
    back = (np.uint64(BITS) - left) % np.uint64(BITS)
    return np.where(left == 0, codes, (codes << left) | (codes >> back))


_ROW = np.dtype([("run", "<i2"), ("value", "<i8"), ("a", "<i2"), ("b", "<i2"), ("code", "<u8")])


def near_edges(distinct: DataFrame, budget: int = 2) -> DataFrame:
    """Edges (u, v) that connect all fingerprints within ``budget`` bits; ``distinct`` has one column ``fp`` of distinct signed longs."""
    runs = _runs(budget)

    def rotate(start: int):
        if start == 0:
            return F.col("fp")
        return F.shiftleft("fp", start).bitwiseOR(F.shiftrightunsigned("fp", BITS - start))

    dealt = F.array(*(
        F.struct(F.lit(k).cast("short").alias("run"), F.shiftrightunsigned(rotate(s), BITS - n).alias("value"), rotate(s).alias("code"))
        for k, (s, n) in enumerate(runs)
    ))
    rows = written(distinct.select(F.explode(dealt).alias("r")).select("r.*"), "runs")
    sizes = rows.groupBy("run", "value").agg(F.count("*").alias("n")).where(F.col("n") > HEAVY)
    mean = 8 * rows.count() / max(1, rows.select("run", "value").distinct().count())
    heavy = sizes.where(F.col("n") > mean).select("run", "value", F.lit(True).alias("heavy"))
    length = F.element_at(F.array(*(F.lit(n) for _, n in runs)), F.col("run") + 1)
    node = F.expr(f"cast(shiftrightunsigned(code, {BITS} - _len - {LEVELS}) & {(1 << LEVELS) - 1} as short)")
    tiles = F.transform(
        F.filter(F.array(*(F.lit(i).cast("short") for i in range(1 << LEVELS))), lambda x: F.bit_count(x.bitwiseXOR(F.col("_node"))) <= budget),
        lambda x: F.struct(F.least(x, F.col("_node")).alias("a"), F.greatest(x, F.col("_node")).alias("b")),
    )
    whole = F.array(F.struct(F.lit(-1).cast("short").alias("a"), F.lit(-1).cast("short").alias("b")))
    split = rows.join(heavy, ["run", "value"], "left").withColumn("_len", length).withColumn("_node", node)
    split = split.withColumn("_t", F.explode(F.when(F.col("heavy"), tiles).otherwise(whole))).select("run", "value", "_t.a", "_t.b", "code")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for batch in batches:
            part = np.empty(batch.num_rows, _ROW)
            for name, column in zip(_ROW.names, batch.columns, strict=True):
                values = column.to_numpy(zero_copy_only=False)
                part[name] = values.view(np.uint64) if name == "code" else values
            parts.append(part)
        if parts:
            u, v = _forest(np.concatenate(parts), budget)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return map_batches(split.repartition("run", "value", "a", "b"), run, "u long, v long")


def _component_ids(found: DataFrame, budget: int) -> DataFrame:
    """``fp``, ``root`` (the least fingerprint of its component) and ``component_id`` of every fingerprint in ``found``."""
    first = written(found.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    near = components(near_edges(first.select("fp"), budget))
    rooted = written(first.join(near.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("root")), "roots")
    least = written(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "least-ids")
    return written(rooted.join(least, "root").select("fp", "root", "component_id"), "component-ids")


def near_duplicates(docs: DataFrame, width: int = 3, budget: int = 2) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 lower-case hexadecimal digits) and ``component_id`` of every document.

    ``component_id`` is the smallest id that can be reached over links, the document's own included; null if it has only null
    ids. Null and empty texts have fingerprint zero and are linked like any other. Equal fingerprints meet once: rows with the same one
    are grouped first. Repeated rows stay; an empty table gives no rows; other columns are not read.
    """
    found = written(fingerprints(docs, width), "fingerprints")
    of = _component_ids(found, budget)
    return found.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def first_of_each(docs: DataFrame, width: int = 3, budget: int = 2) -> DataFrame:
    """One document of each component, with its columns: that of the smallest id (null last), of repeated ids any one row.

    Null and empty texts are one component, with what is linked to fingerprint zero; an empty table gives no rows; columns may have any names.
    """
    placed = with_places(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(raw, width) for raw in texts(batch.column(3))], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found.view(np.int64))], names=["file", "at", "doc_id", "fp"])

    found = written(map_batches(_narrow(placed), run, "file long, at long, doc_id long, fp long"), "fingerprints")
    of = _component_ids(found.select("doc_id", "fp"), budget)
    return _first_of_each_root(placed, found.join(of, "fp").select("file", "at", "doc_id", "root"))


def _narrow(placed: DataFrame) -> DataFrame:
    return placed.select("file", "at", F.col("doc.doc_id").cast("long").alias("doc_id"), F.col("doc.text").cast("string").alias("text"))


def _first_of_each_root(placed: DataFrame, found: DataFrame) -> DataFrame:
    """The documents without all but the first of each ``root``; ``found`` has place, ``doc_id`` and ``root``. Only what goes is dealt out, as places."""
    found = written(found, "rooted")
    first = found.groupBy(F.col("root").alias("_root")).agg(F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "file", "at")).alias("c"), F.count("*").alias("n"))
    first = first.where("n > 1").select("_root", "c")
    gone = found.join(first, F.col("root") == F.col("_root")).where((F.col("file") != F.col("c.file")) | (F.col("at") != F.col("c.at"))).select("file", "at")
    return without_places(placed, Side(gone, "gone", found.count()))


# --- near copies by similarity ---------------------------------------------------------------------------------

#: Near copies: words of a shingle and least Jaccard similarity of the sets of shingles.
SHINGLE, SIMILARITY = 5, 0.8
#: Share of the pairs of just that similarity that agree in none of the runs.
MISSED = 0.001
#: Bits in which the tries' codes, and these with a second word, differ at most. At a similarity of 0.8 the means are 9.7 of 64 and 19.4 of 128 bits, the
#: deviations 2.9 and 4.1; of unrelated texts 32 and 64, 4 and 5.7.
NEAR_BITS, NEAR_BITS_BOTH = 20, 36
#: Texts that meet in a task: larger run values and clouds are dealt out by pairs of blocks.
BLOCK = 4096
_LEAF = 24


def runs_for(n: int, similarity: float = SIMILARITY, missed: float = MISSED) -> tuple[int, int]:
    """Bits of a run and number of runs for ``n`` texts: some hundred texts have a run value by chance, whatever ``n`` is, and at most ``missed`` of the pairs agree in no run."""
    bits = min(32, max(8, n.bit_length() - 7))
    apart = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return bits, int(np.ceil(np.log(missed) / np.log1p(-((1 - apart) ** bits))))


def _shingle_set(raw: bytes, width: int) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(raw, width), "<u8"))


def _mixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """The k-th independent hash of each hash."""
    x = hashes + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def long_fingerprint(own: np.ndarray, n_words: int) -> np.ndarray:
    """A fingerprint of so many 64-bit words of a set of shingle hashes; zero if it is empty."""
    ones = np.zeros(n_words * BITS, np.int64)
    for i in range(0, len(own), 2048):
        part = own[i : i + 2048]
        words = np.stack([_mixed(part, k) for k in range(n_words)], 1)
        ones += np.unpackbits(words.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(own), bitorder="little").view("<u8")


def run_values(fingerprint: np.ndarray, bits: int, runs: int) -> np.ndarray:
    """The values of the runs that follow the first two words; each has its number in the upper half."""
    bit = np.unpackbits(fingerprint[2:].view(np.uint8), bitorder="little")[: bits * runs].reshape(runs, bits)
    return (bit.astype(np.int64) << np.arange(bits)).sum(1) | np.arange(runs, dtype=np.int64) << 32


_SKETCH = "file long, at long, doc_id long, node long, n long, a long, b long, runs array<long>"


def _sketches(placed: DataFrame, width: int, bits: int, runs: int) -> DataFrame:
    """Place and id of every document, the digest (``node``) and size of its set of shingles, and its fingerprint: two words and the values of the runs."""
    n_words = 2 + -(-bits * runs // BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, values = np.empty((batch.num_rows, 4), np.int64), np.empty((batch.num_rows, runs), np.int64)
            for k, raw in enumerate(texts(batch.column(3))):
                own = _shingle_set(raw, width)
                fp = long_fingerprint(own, n_words)
                made[k] = np.array([xxhash.xxh64_intdigest(own.tobytes(), SEED), len(own), *fp[:2]], np.uint64).view(np.int64)
                values[k] = run_values(fp, bits, runs)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, runs), pa.int32()), pa.array(values.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(made[:, k]) for k in range(4)), lists], names=[c.split()[0] for c in _SKETCH.split(", ")])

    return map_batches(_narrow(placed), run, _SKETCH)


def _in_blocks(rows: DataFrame, block: int, name: str) -> DataFrame:
    """Rows with columns ``x``, ``y`` and ``own``: those of a ``key`` with more than ``block`` rows are dealt to all pairs (x, y) with their own block of texts."""
    heavy = written(rows.groupBy(F.col("key").alias("_key")).agg(F.count("*").alias("_n")).where(F.col("_n") > block), name)
    zero = F.lit(0).cast("int")
    if heavy.isEmpty():
        return rows.select("*", zero.alias("x"), zero.alias("y"), zero.alias("own"))
    blocks = F.ceil(F.coalesce("_n", F.lit(1)) / block).cast("int")
    dealt = rows.join(heavy, F.col("key") == F.col("_key"), "left").withColumn("_blocks", blocks).withColumn("own", F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int"))
    dealt = dealt.withColumn("_other", F.explode(F.sequence(zero, F.col("_blocks") - 1)))
    return dealt.select(*rows.columns, F.least("own", "_other").alias("x"), F.greatest("own", "_other").alias("y"), "own")


_MET = np.dtype([("key", "<i8"), ("x", "<i4"), ("y", "<i4"), ("own", "<i4"), ("node", "<i8"), ("n", "<i8"), ("a", "<u8"), ("b", "<u8")])


def _linked(rows: np.ndarray, sets: list[bytes] | None, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, node) that connect what is linked among rows that meet by ``key``, ``x`` and ``y``; by exact similarity if there are ``sets`` of shingle hashes."""
    order = np.lexsort((rows["a"], rows["own"], rows["y"], rows["x"], rows["key"]))
    rows = rows[order]
    group = rows[["key", "x", "y"]]
    edge = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))
    lo, hi = edge[:-1], edge[1:]
    inner = np.flatnonzero((rows["own"][1:] != rows["own"][:-1]) & (group[1:] == group[:-1])) + 1  # where a group's second block begins
    cut = hi.copy()
    cut[np.searchsorted(lo, inner, "right") - 1] = inner
    crossed = rows["x"][lo] != rows["y"][lo]
    pairs = np.stack([lo, np.where(crossed, cut, hi), np.where(crossed, cut, lo), hi, np.zeros(len(lo), np.int64), np.zeros(len(lo), np.int64)], 1)
    pairs = pairs[(pairs[:, 0] < pairs[:, 1]) & (pairs[:, 2] < pairs[:, 3]) & (pairs[:, 3] - pairs[:, 0] > 1)]
    codes, second, sizes = rows["a"], rows["b"], rows["n"]
    first = {}
    labels = np.array([first.setdefault(v, i) for i, v in enumerate(rows["node"].tolist())], np.int64)
    known: dict[int, frozenset] = {}

    def members(i: int) -> frozenset:
        if i not in known:
            known[i] = frozenset(np.frombuffer(sets[order[i]], "<u8").tolist())
        return known[i]

    def near(links: np.ndarray) -> np.ndarray:
        i, j = links.T
        bits = np.bitwise_count(codes[i] ^ codes[j]).astype(np.int64) + np.bitwise_count(second[i] ^ second[j])
        ok = (labels[i] != labels[j]) & (bits <= NEAR_BITS_BOTH) & (np.minimum(sizes[i], sizes[j]) >= similarity * np.maximum(sizes[i], sizes[j]))
        if sets is None or not ok.any():
            return links[ok]
        links = links[ok][np.argsort(bits[ok], kind="stable")]
        root: dict[int, int] = {}

        def find(k: int) -> int:
            while k in root:
                k = root[k]
            return k

        kept = []
        for i, j in links.tolist():
            u, v = find(int(labels[i])), find(int(labels[j]))
            if u != v:
                p, q = members(i), members(j)
                both = len(p & q)
                if both >= similarity * (len(p) + len(q) - both):
                    root[max(u, v)] = min(u, v)
                    kept.append((i, j))
        return np.array(kept, np.int64).reshape(-1, 2)

    beside = np.flatnonzero(group[1:] == group[:-1])
    beside = beside[np.bitwise_count(codes[beside] ^ codes[beside + 1]) <= NEAR_BITS]
    found = near(np.stack([beside, beside + 1], 1)) if len(beside) else np.empty((0, 2), np.int64)
    if len(found):
        labels[:] = join_labels(labels, found)
    for links in near_links(codes, pairs, NEAR_BITS, _LEAF, labels):
        if len(found := near(links)):
            labels[:] = join_labels(labels, found)
    moved = np.flatnonzero(rows["node"] != rows["node"][labels])
    edges = np.unique(np.stack([rows["node"][moved], rows["node"][labels[moved]]], 1), axis=0) if len(moved) else np.empty((0, 2), np.int64)
    return edges[:, 0], edges[:, 1]


def _edges(met: DataFrame, similarity: float, exact: bool) -> DataFrame:
    """Edges ``u``, ``v`` among the rows of :func:`_in_blocks`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, sets = [], []
        for batch in batches:
            part = np.empty(batch.num_rows, _MET)
            for k, name in enumerate(_MET.names):
                part[name] = batch.column(k).to_numpy(zero_copy_only=False).view(np.uint64 if name in "ab" else batch.column(k).type.to_pandas_dtype())
            parts.append(part)
            if exact:
                sets += batch.column(len(_MET.names)).to_pylist()
        if parts:
            u, v = _linked(np.concatenate(parts), sets if exact else None, similarity)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return map_batches(met.select(*_MET.names, *["shingles"] * exact).repartition("key", "x", "y"), run, "u long, v long")


def _with_sets(placed: DataFrame, wanted: Side, width: int) -> DataFrame:
    """``key``, ``node``, ``n``, ``a``, ``b`` and the ``shingles`` of the wanted places."""
    names = ["key", "node", "n", "a", "b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, side, lo, hi in wanted.beside(batches):
            mine = np.flatnonzero(lo < hi)
            if len(mine):
                own = [_shingle_set(raw, width).tobytes() for raw in texts(batch.column(2).take(pa.array(mine)))]
                yield pa.RecordBatch.from_arrays([*(side.column(c).take(pa.array(lo[mine])).combine_chunks() for c in names), pa.array(own, pa.binary())], names=[*names, "shingles"])

    return map_batches(_narrow(placed).drop("doc_id"), run, "key long, node long, n long, a long, b long, shingles binary")


def near_copy_groups(docs: DataFrame, width: int = SHINGLE, similarity: float = SIMILARITY, missed: float = MISSED, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """The documents with their places, and ``file``, ``at``, ``doc_id`` and ``root`` of each: equal roots belong to one group of near copies.

    Near copies have a Jaccard similarity of at least ``similarity`` of their sets of shingles, and groups are what such links connect. Equal sets meet
    once; null and empty texts are one set. A pair of just that similarity isn't compared with a probability of ``missed`` and some 1e-4 for the bits of the tries, a more similar one with far less;
    every pair that is compared is decided by its texts. Texts that are compared are those of clouds alone, once for each pair of blocks that a cloud of more than ``block``
    texts is cut into.
    """
    placed = with_places(docs)
    bits, runs = runs_for(placed.select("file").count(), similarity, missed)
    found = written(_sketches(placed, width, bits, runs), "sketches")
    nodes = written(found.groupBy("node").agg(F.min(F.struct("file", "at")).alias("c"), *(F.first(c).alias(c) for c in ("n", "a", "b", "runs"))).select("node", "c.file", "c.at", "n", "a", "b", "runs"), "nodes")
    met = _in_blocks(nodes.select(F.explode("runs").alias("key"), "node", "n", "a", "b"), block * 16, "heavy-runs")
    others = components(_edges(met, similarity, False)).select("node", F.col("component").alias("key"))
    clouds = written(others.unionByName(others.select(F.col("key").alias("node"), "key").distinct()), "clouds")
    of_cloud = nodes.drop("runs").join(clouds, "node")
    wanted = Side(of_cloud.select("file", "at", "key", "node", "n", "a", "b"), "cloud-places", clouds.count())
    sets = written(_with_sets(placed, wanted, width), "cloud-sets")
    near = components(_edges(_in_blocks(sets, block, "heavy-clouds"), similarity, True))
    joined = found.select("file", "at", "doc_id", "node").join(near.select(F.col("node").alias("_node"), "component"), F.col("node") == F.col("_node"), "left")
    return placed, joined.select("file", "at", "doc_id", F.coalesce("component", "node").alias("root"))


def first_of_near_copies(docs: DataFrame, width: int = SHINGLE, similarity: float = SIMILARITY, missed: float = MISSED, block: int = BLOCK) -> DataFrame:
    """One document of each group of :func:`near_copy_groups`, with its columns: that of the smallest id (null last), of repeated ids any one row.

    An empty table gives no rows; columns may have any names.
    """
    return _first_of_each_root(*near_copy_groups(docs, width, similarity, missed, block))
