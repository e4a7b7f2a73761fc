"""Removing repeated substrings, exactly and across all documents, by column-wise Burrows-Wheeler construction.

A byte goes if it lies in a string of ``length`` bytes that starts at another place too, in the same or another document.

1. Texts are cut into pieces at content-defined anchors (:mod:`.windows`): equal strings of ``length`` bytes lie in pieces of one
   key. Keys that occur once need nothing more, and where all pieces of a key hold the same bytes all their
   strings are repeated.
2. Keys whose pieces differ, as near edits and at the ends of shared passages, keep one piece of each kind and are split by where
   their strings lie around the anchor: a string reaches at least half of the free bytes to the left or else to the right, which
   adds those bytes to the key. Halves that are alone under their key hold nothing repeated. A key that still has very many
   kinds is halved again, until groups are small or the key is the whole string.
3. The rest goes to the construction (:mod:`.bcr`). A task takes whole keys, some thousand pieces at a time, and inserts one
   symbol of each per round; neighbours in the final order that share ``length`` bytes are repeated strings.

What meets in a task is bounded in this way; counting and grouping are aggregations. Every step is a table in the shared folder. No
text is shuffled: pieces carry the place of their text (:func:`.common.with_places`), and what was found of them is read beside the texts again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bcr import repeated_starts
from .common import Side, column_name, drop, map_batches, texts, with_places, written
from .windows import pieces

LENGTH = 200
#: Bytes of the substrings whose hashes choose anchors.
GRAM = 80
#: A key with more kinds of pieces than this is split.
HEAVY = 1000
#: Pieces whose columns are constructed together, but for a key that has more.
TOGETHER = 4000
#: Window starts of a text that are hashed at a time.
_SLICE = 1 << 18
#: Pieces that are made into rows at a time.
_ROWS = 4096


def _cut(many: list[bytes], length: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """The pieces of texts: number of the text, first start, starts, key, hash of the bytes, anchor."""
    together: list[int] = []
    total = 0

    def flush():
        data = np.frombuffer(b"".join(many[i] for i in together), np.uint8)
        bounds = np.concatenate([[0], np.cumsum([len(many[i]) for i in together])])
        text, *rest = pieces(data, bounds, length, gram)
        return (np.array(together, np.int64)[text], *rest)

    for i, raw in enumerate(many):
        if len(raw) < length:
            continue
        if len(raw) > _SLICE:  # the starts of a very long text in slices
            for at in range(0, len(raw) - length + 1, _SLICE):
                part = np.frombuffer(raw, np.uint8, min(_SLICE + length - 1, len(raw) - at), at)
                text, first, *rest = pieces(part, np.array([0, len(part)]), length, gram)
                yield (text + i, first + at, *rest)
            continue
        if total + len(raw) > _SLICE:
            yield flush()
            together, total = [], 0
        together.append(i)
        total += len(raw)
    if together:
        yield flush()


def _all_pieces(rows: DataFrame, length: int, gram: int) -> DataFrame:
    names = ["key", "kind", "file", "at", "first", "span"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            file, at = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for text, first, starts, key, kind, anchor in _cut(texts(batch.column(2)), length, gram):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c) for c in (key.view(np.int64), kind.view(np.int64), file[text], at[text], first, (starts << 16 | anchor).astype(np.int32))], names=names
                )

    return map_batches(rows, run, "key long, kind long, file long, at long, first long, span int")


_PIECE = "key long, low int, high int, copies long, file long, at long, first long, starts int, anchor int, bytes binary"
_PIECE_KINDS = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
_PIECE_NAMES = [c.split()[0] for c in _PIECE.split(", ")]


def _halves(p: tuple, length: int, gram: int) -> Iterator[tuple]:
    """A piece in the columns of ``_PIECE``, split by where its strings lie around the anchor.

    The key of a half has the stretch that all its strings share: the anchor, and the free bytes that each of them reaches at least.
    """
    key, low, high, copies, file, at, first, starts, anchor, raw = p
    middle = (low + high + 1) // 2
    for lo, hi in ((low, middle - 1), (middle, high)):
        a, b = max(0, anchor - hi), min(starts - 1, anchor - lo)  # the first and last start in this half
        if a <= b:
            core = raw[anchor - lo : anchor + length - hi]
            half = xxhash.xxh3_64_intdigest(core, (key ^ lo << 32 ^ hi) & 0xFFFFFFFFFFFFFFFF)
            yield half - ((half >> 63) << 64), lo, hi, copies, file, at, first + a, b - a + 1, anchor - a, raw[a : b + length]


def _piece_batch(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _PIECE_KINDS, strict=True)], names=_PIECE_NAMES)


def _with_bytes(rows: DataFrame, kinds: Side, length: int, gram: int) -> DataFrame:
    """One piece of each kind, with its bytes, from the text that it was met in, in halves. ``low`` and ``high`` bound how far its strings begin before the anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for batch, side, lo, hi in kinds.beside(batches):
            file, at = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for i in np.flatnonzero(lo < hi).tolist():
                raw = texts(batch.column(2).slice(i, 1))[0]
                for k in range(int(lo[i]), int(hi[i]), _ROWS):
                    wanted = side.slice(k, min(_ROWS, int(hi[i]) - k))
                    for key, copies, first, span in zip(*(wanted.column(c).to_pylist() for c in ("key", "copies", "first", "span")), strict=True):
                        starts = span >> 16
                        piece = (key, 0, length - gram, copies, int(file[i]), int(at[i]), first, starts, span & 0xFFFF, raw[first : first + starts + length - 1])
                        out += _halves(piece, length, gram)
                    if len(out) > _ROWS:
                        yield from _piece_batch(out)
                        out = []
        yield from _piece_batch(out)

    return map_batches(rows, run, _PIECE)


def _halved(heavy: DataFrame, length: int, gram: int) -> DataFrame:
    """Pieces of heavy keys in halves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in _PIECE_NAMES]
            yield from _piece_batch([h for p in zip(*columns, strict=True) for h in _halves(p, length, gram)])

    return map_batches(heavy, run, _PIECE)


def _constructed(groups: DataFrame, length: int) -> DataFrame:
    """Runs of repeated starts of the pieces that stand for one place only: file, at, first, starts."""

    def solve(block: list[tuple]) -> pa.RecordBatch:
        strings = [p[3] for p in block]
        hits = repeated_starts(strings, np.array([p[2] for p in block]), length)
        out: list[list] = [[], [], [], []]
        for (owner, first, _, _), hit in zip(block, hits, strict=True):
            if owner is None or not hit.any():
                continue
            edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
            for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                for column, value in zip(out, (*owner, first + a, b - a), strict=True):
                    column.append(value)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["file", "at", "first", "starts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[tuple] = []
        last = None
        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in ("key", "copies", "file", "at", "first", "starts", "bytes")]
            for key, copies, file, at, first, starts, raw in zip(*columns, strict=True):
                if key != last and len(block) >= TOGETHER:
                    yield solve(block)
                    block = []
                last = key
                block.append(((file, at) if copies == 1 else None, first, starts, raw))
        if block:
            yield solve(block)

    # in proportion to the pieces: their bytes are few for the work they make
    tasks = max(int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-groups.count() // TOGETHER))
    return map_batches(groups.repartition(tasks, "key").sortWithinPartitions("key"), run, "file long, at long, first long, starts long")


def repeated_starts_of(placed: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Runs of starts of repeated strings, as ``file``, ``at``, ``first`` and ``starts``; see :func:`.common.with_places` for the first two."""
    rows = placed.select("file", "at", F.col("doc.text").cast("string").alias("text"))
    every = written(_all_pieces(rows, length, gram), "pieces")
    shared = every.groupBy("key").agg(F.count("*").alias("n"), F.min("kind").alias("a"), F.max("kind").alias("b")).where("n > 1")
    shared = written(shared.select(F.col("key").alias("_key"), (F.col("a") != F.col("b")).alias("differ")), "shared-keys")
    met = written(every.join(shared, F.col("key") == F.col("_key")).drop("_key"), "shared-pieces")
    drop(every)
    run = ["file", "at", "first", F.shiftright("span", 16).cast("long").alias("starts")]
    same = met.where(~F.col("differ")).select(*run)
    differing = met.where("differ")
    kinds = differing.groupBy("key", "kind").agg(F.count("*").alias("copies"), F.min(F.struct("file", "at", "first", "span")).alias("p"))
    kinds = written(kinds.select("p.file", "p.at", "key", "kind", "copies", "p.first", "p.span"), "kinds")
    often = written(kinds.where("copies > 1").select(F.col("key").alias("_key"), F.col("kind").alias("_kind")), "frequent-kinds")
    copied = differing.join(often, (F.col("key") == F.col("_key")) & (F.col("kind") == F.col("_kind")), "left_semi").select(*run)
    wanted = Side(kinds.select("file", "at", "key", "copies", "first", "span"), "kinds-by-place", kinds.count())
    drop(kinds)
    todo = written(_with_bytes(rows, wanted, length, gram), "piece-bytes")
    small, solved, steps = [], [], []
    while True:
        sizes = todo.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").withColumnRenamed("key", "_key")
        sized = written(todo.join(sizes, F.col("key") == F.col("_key")).drop("_key"), "sized")
        small.append(sized.where(F.col("n") <= HEAVY).drop("n"))
        heavy = sized.where(F.col("n") > HEAVY)
        drop(todo)
        steps.append(sized)
        whole = heavy.where("low = high and copies = 1")  # the key is the whole string, and several pieces have it
        solved.append(written(whole.select("file", "at", "first", F.col("starts").cast("long").alias("starts")), "whole-strings"))
        heavy = heavy.where("low < high").drop("n")
        if heavy.isEmpty():
            break
        todo = written(_halved(heavy, length, gram), "halves")
    groups = small[0]
    for more in small[1:]:
        groups = groups.unionByName(more)
    built = written(_constructed(groups, length), "constructed")
    for more in steps:
        drop(more)
    out = same.unionByName(copied).unionByName(built)
    for more in solved:
        out = out.unionByName(more)
    return out


def _spans(first: np.ndarray, starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal stretches of bytes that repeated strings cover."""
    out: list[tuple[int, int]] = []
    order = np.argsort(first, kind="stable")
    for at, n in zip(first[order].tolist(), starts[order].tolist(), strict=True):
        end = at + n - 1 + length
        if out and at <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((at, end))
    return out


def _kept(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, out = 0, []
    for a, b in spans:
        out.append(raw[at:a])
        at = b
    return b"".join([*out, raw[at:]])


def _with_spans(runs: Side, batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[pa.RecordBatch, list[list[tuple[int, int]]]]]:
    for batch, side, lo, hi in runs.beside(batches):
        if side is None:
            yield batch, [[]] * batch.num_rows
        else:
            first, starts = side.column("first").to_numpy(), side.column("starts").to_numpy()
            yield batch, [_spans(first[a:b], starts[a:b], length) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]


def _runs_by_place(placed: DataFrame, length: int, gram: int) -> Side:
    found = written(repeated_starts_of(placed, length, gram), "runs")
    out = Side(found, "runs-by-place", found.count())
    drop(found)
    return out


def substring_digests(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs) and ``kept_sha256`` of every document.

    Texts are their UTF-8 bytes, null is empty, and texts shorter than ``length`` keep all. Equal rows repeat each other. Null and
    repeated ids are told apart by their places. An empty table gives no rows; other columns are not read.
    """
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    placed = with_places(docs)
    runs = _runs_by_place(placed, length, gram)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, spans in _with_spans(runs, batches, length):
            made = []
            for raw, cut in zip(texts(batch.column(3)), spans, strict=True):
                made.append((len(raw), sum(b - a for a, b in cut), len(cut), hashlib.sha256(_kept(raw, cut)).hexdigest()))
            columns = list(zip(*made, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(2), *(pa.array(c, k) for c, k in zip(columns, [pa.int64()] * 3 + [pa.string()], strict=True))], names=names)

    rows = placed.select("file", "at", F.col("doc.doc_id").cast("long").alias("doc_id"), F.col("doc.text").cast("string").alias("text"))
    return map_batches(rows, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeated(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Documents with repeated strings taken out of ``text``, and ``n_chars``, if there is one, counted anew.

    A character that is cut within its bytes goes as a whole. Documents without repeated strings, null texts included, stay as they are; all
    rows and columns stay, repeated rows and rows without an id as well. An empty table gives no rows.
    """
    placed = with_places(docs)
    runs = _runs_by_place(placed, length, gram)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, spans in _with_spans(runs, batches, length):
            out = [text if not cut else _kept(text.encode(), cut).decode("utf-8", "ignore") for text, cut in zip(batch.column(2).to_pylist(), spans, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), batch.column(3)], names=["text", "rest"])

    rest = F.struct(F.lit(0).alias(column_name(docs, "pad")), *(F.col(f"doc.`{c}`") for c in docs.columns if c != "text"))
    packed = placed.select("file", "at", F.col("doc.text").cast("string").alias("text"), rest.alias("rest"))
    kept = map_batches(packed, run, T.StructType([T.StructField("text", T.StringType()), T.StructField("rest", packed.schema["rest"].dataType)]))
    columns = []
    for c in docs.columns:
        value = F.col("text").cast(docs.schema[c].dataType) if c == "text" else F.length("text").cast(docs.schema[c].dataType) if c == "n_chars" else F.col(f"rest.`{c}`")
        columns.append(value.alias(c))
    return kept.select(*columns)
