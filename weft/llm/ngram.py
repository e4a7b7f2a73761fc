"""Cross-entropy difference: how much better a target model predicts a document than a background model does.

Both are n-gram models over one vocabulary, a byte-level BPE rank file or its first ``size`` entries, which are a smaller BPE by themselves
and encode any text. They are estimated alike: n-grams are smoothed by the next shorter ones (Dirichlet prior), and unigrams by a
constant. The background is every document, the target the documents that are marked; counts come from all of them. A document's
score is the mean over its tokens of target loss minus background loss, in nats: low is like the target.

Counts grow with the corpus: whatever n-gram occurs has one. Documents are read in chunks of some million tokens. A chunk asks for the counts of its
distinct n-grams: sorted, packed blocks of them, dealt out by a hash, carry the chunk's own counts and come back with the sums over all chunks. A
chunk is then scored beside what came back, so n-grams travel once per chunk and never once per document, a frequent one meets one row per
chunk, and the driver gathers two totals.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import read_ranks
from .common import Side, gathered, map_batches, with_places, written
from .pretokens import Encoder

#: Weight of the next shorter model in an n-gram's context, in tokens, and the constant added to each unigram.
PRIOR, ADDED = 32.0, 0.5
#: Tokens of a chunk, but for a document that has more; distinct n-grams of the corpus are counted in at least one bucket for so many tokens.
CHUNK = 3 << 19


_encoders: dict[tuple[str, str, int | None], Encoder] = {}


def encoder(rank_file: str, pattern: str, size: int | None = None) -> Encoder:
    """Encodes texts by the first ``size`` ranks (None: all); made once in a worker."""
    key = (rank_file, pattern, size)
    if key not in _encoders:
        import regex
        import tiktoken

        ranks = {t: r for t, r in read_ranks(rank_file).items() if size is None or r < size}
        own = tiktoken.Encoding("prefix", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        single = own._encode_single_piece if hasattr(own, "_encode_single_piece") else lambda p: own.encode_ordinary(p.decode())

        def encode_bytes(pretoken: bytes) -> bytes:
            ids = single(pretoken)
            return struct.pack(f"<{len(ids)}I", *ids)

        _encoders[key] = Encoder(regex.compile(pattern).findall, lambda p: encode_bytes(p.encode()), most=300_000, encode_bytes=encode_bytes)
    return _encoders[key]


_CHUNK_ROW = "chunk long, doc_ids array<long>, marked array<boolean>, sizes array<long>, ids binary"


def tokens(docs: DataFrame, rank_file: str, pattern: str, size: int | None = None, targets: DataFrame | None = None) -> DataFrame:
    """Every whole text as token ids, null as an empty one; a row is a chunk of documents: ``chunk``, ``doc_ids``, ``marked``, ``sizes`` (in tokens) and the packed ``ids``.

    ``targets`` has the ``doc_id`` of the marked documents; without it they have a column ``is_target``.
    """
    placed = with_places(docs)
    doc_id = F.col("doc.doc_id").cast("long").alias("doc_id")
    marks = None
    if targets is not None:
        of = targets.select(F.col("doc_id").cast("long").alias("_id")).where("_id is not null").distinct()
        marks = Side(placed.select("file", "at", doc_id).join(of, F.col("doc_id") == F.col("_id"), "left_semi").select("file", "at"), "targets", targets.count())
    names = [c.split()[0] for c in _CHUNK_ROW.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        held: list[tuple] = []
        total = 0

        def chunk() -> pa.RecordBatch:
            number = xxhash.xxh3_64_intdigest(f"{held[0][0]} {held[0][1]}") >> 1
            ids = np.frombuffer(b"".join(h[4] for h in held), "<u4")
            row = [number, [h[2] for h in held], [h[3] for h in held], [len(h[4]) // 4 for h in held], _pack_ids(ids)]
            held.clear()
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=names)

        if marks is not None:
            parts = ((batch, pa.array(lo < hi)) for batch, _, lo, hi in marks.beside(gathered(batches, 5 << 20)))
        else:
            parts = ((batch, batch.column(4)) for batch in gathered(batches, 5 << 20))
        for batch, marked in parts:
            own = own or encoder(rank_file, pattern, size)
            made = own.encode_many(batch.column(3))
            for file, at, doc_id, mark, ids in zip(*(c.to_pylist() for c in (*batch.columns[:3], marked)), made, strict=True):
                held.append((file, at, doc_id, mark, ids))
                total += len(ids) // 4
                if total >= CHUNK:
                    yield chunk()
                    total = 0
        if held:
            yield chunk()

    marked = F.lit(False) if targets is not None else F.coalesce(F.col("doc.is_target").cast("boolean"), F.lit(False))
    source = placed.select("file", "at", doc_id, F.col("doc.text").cast("string").alias("text"), marked.alias("is_target"))
    return map_batches(source, run, _CHUNK_ROW)


def counts(found: DataFrame, size: int, order: int) -> DataFrame:
    """``gram`` (a number), ``target`` and ``background``: how often each n-gram of an order stands in marked documents and in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, own in _chunks(batches, size, order):
            keys, sums = own.counts()[order]
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(sums[:, 0]), pa.array(sums[:, 1])], names=["gram", "target", "background"])

    rows = map_batches(found, run, "gram long, target long, background long")
    return rows.groupBy("gram").agg(F.sum("target").alias("target"), F.sum("background").alias("background"))


def losses(bigrams: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    """Loss of every bigram, -log p(token | context), from counts of those that were seen."""
    table = np.zeros((size + 1) * size)
    table[bigrams] = n
    table = table.reshape(size + 1, size)
    unigram = table.sum(0) + ADDED
    prior = PRIOR * unigram / unigram.sum()
    out = table + prior
    out /= table.sum(1, keepdims=True) + PRIOR
    return -np.log(out)


# --- counts for chunks -----------------------------------------------------------------------------------------


def _pack(values: np.ndarray) -> bytes:
    """Unsigned integers, byte plane by byte plane, compressed."""
    return pa.compress(np.ascontiguousarray(values.view(np.uint8).reshape(values.size, -1).T).tobytes(), codec="zstd", asbytes=True)


def _unpack(raw: bytes, kind: str, n: int) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(raw, n * width, codec="zstd", asbytes=True), np.uint8).reshape(width, n)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _pack_ids(ids: np.ndarray) -> bytes:
    """Ids as 16-bit integers where they fit, compressed as they follow one another: words recur as sequences."""
    small = ids.astype("<u2")
    fits = bool((small == ids).all())
    return bytes([fits]) + pa.Codec("zstd", compression_level=3).compress((small if fits else ids.astype("<u4")).tobytes(), asbytes=True)


def _unpack_ids(raw: bytes, n: int) -> np.ndarray:
    kind = "<u2" if raw[0] else "<u4"
    return np.frombuffer(pa.decompress(raw[1:], n * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind)


def _pack_keys(keys: np.ndarray) -> bytes:
    return _pack(np.diff(keys, prepend=0).astype("<u8"))


def _unpack_keys(raw: bytes, n: int) -> np.ndarray:
    return np.cumsum(_unpack(raw, "<u8", n).astype(np.int64))


def _bucket(keys: np.ndarray, n: int) -> np.ndarray:
    x = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((x ^ (x >> np.uint64(29))) >> np.uint64(8)) % np.uint64(n)


def _runs_of(sorted_keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    return np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])) if len(sorted_keys) else np.empty(0, np.int64)


class _Chunk:
    """Documents of one chunk, and for each token the n-grams that end there: the token and those before it as one number; what comes before a text is number ``size``."""

    def __init__(self, doc_ids: list, marked: list[bool], sizes: list[int], ids: np.ndarray, size: int, order: int):
        self.doc_ids, self.order, self.bits = doc_ids, order, size.bit_length()
        self.made: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.sizes = np.array(sizes, np.int64)
        self.owner = np.repeat(np.arange(len(sizes), dtype=np.int32), self.sizes)
        self.marked = np.repeat(np.array(marked, bool), self.sizes)
        self.first = (np.cumsum(self.sizes) - self.sizes)[self.owner] == np.arange(len(ids))
        self.none = sum(size << self.bits * k for k in range(order))  # as many of it as there are tokens in an n-gram
        self.grams = {1: ids.astype(np.int64)}
        for k in range(2, order + 1):
            self.grams[k] = self.shifted(self.grams[k - 1], self.context(k - 1)) << self.bits | self.grams[1]

    def context(self, k: int) -> int:
        """The number of k missing tokens."""
        return self.none & ((1 << self.bits * k) - 1)

    def shifted(self, values: np.ndarray, at_first: int) -> np.ndarray:
        """The value of the token before, within a document."""
        out = np.empty_like(values)
        out[1:] = values[:-1]
        out[self.first] = at_first
        return out

    def counts(self) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """By order the distinct n-grams, sorted, and how often each stands in marked documents and in all, then as what comes before a token there."""
        if self.made:
            return self.made
        out = self.made
        for k in range(self.order, 0, -1):
            both = np.sort(self.grams[k] << 1 | self.marked)
            begin = _runs_of(both >> 1)
            keys = both[begin] >> 1
            own = np.stack([np.add.reduceat(both & 1, begin) if len(begin) else begin, np.diff(begin, append=len(both))], 1)
            if k < self.order:
                longer, sums = out[k + 1]
                contexts = longer >> self.bits
                follows = sums[:, 1] > 0  # the others only come before tokens themselves
                contexts, sums = contexts[follows], sums[follows]
                begin = _runs_of(contexts)
                contexts, before = contexts[begin], np.add.reduceat(sums[:, :2], begin, axis=0) if len(begin) else sums[:, :2]
                every = np.union1d(keys, contexts)
                table = np.zeros((len(every), 4), np.int64)
                table[np.searchsorted(every, keys), :2] = own
                table[np.searchsorted(every, contexts), 2:] = before
                out[k] = every, table
            else:
                out[k] = keys, np.concatenate([own, np.zeros_like(own)], 1)
        return out


def _chunks(batches: Iterator[pa.RecordBatch], size: int, order: int) -> Iterator[tuple[int, _Chunk]]:
    for batch in batches:
        for i in range(batch.num_rows):
            chunk, doc_ids, marked, sizes, ids = (c[i].as_py() for c in batch.columns)
            yield chunk, _Chunk(doc_ids, marked, sizes, _unpack_ids(ids, sum(sizes)), size, order)


def _in_buckets(keys: np.ndarray, shift: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The order in which sorted keys lie by bucket, and the bucket of each in that order; n-grams that differ in their last token alone (``shift`` bits) stay together and pack well."""
    bucket = _bucket(keys >> shift, buckets).astype(np.uint16 if buckets <= 1 << 16 else np.int64)
    by = np.argsort(bucket, kind="stable")
    return by, bucket[by]


_BLOCK = "bucket int, chunk long, k int, n int, keys binary, counts binary"
_SUMS = "file long, at long, bucket int, n int, counts binary"


def _blocks(found: DataFrame, size: int, order: int, buckets: int) -> DataFrame:
    """Each chunk's distinct n-grams and their counts, in blocks by bucket."""
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _encoders.clear()  # of a worker that has encoded texts before
        for chunk, own in _chunks(batches, size, order):
            for k, (keys, sums) in own.counts().items():
                if not len(keys):
                    continue
                by, bucket = _in_buckets(keys, own.bits if k > 1 else 0, buckets)
                keys, sums = keys[by], sums[by].astype("<u4")
                edges = [*_runs_of(bucket).tolist(), len(keys)]
                made = [(int(bucket[a]), chunk, k, b - a, _pack_keys(keys[a:b]), _pack(sums[a:b].T.ravel())) for a, b in zip(edges[:-1], edges[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), kinds, strict=True)], names=[c.split()[0] for c in _BLOCK.split(", ")])

    return map_batches(found, run, _BLOCK)


def _summed_blocks(blocks: DataFrame, buckets: int) -> DataFrame:
    """Of each block the sums over all chunks of its n-grams, in its order; ``file`` is the chunk and ``at`` the order."""
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list[tuple]] = {}
        for batch in batches:
            for bucket, chunk, k, n, keys, sums in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.setdefault((bucket, k), []).append((chunk, n, keys, sums))
        while held:
            (bucket, k), parts = held.popitem()
            distinct, at = np.unique(np.concatenate([_unpack_keys(keys, n) for _, n, keys, _ in parts]), return_inverse=True)
            totals = np.zeros((len(distinct), 4), "<u8")
            ends = np.cumsum([n for _, n, _, _ in parts]).tolist()
            for (_, n, _, sums), end in zip(parts, ends, strict=True):  # a block has each key once
                totals[at[end - n : end]] += _unpack(sums, "<u4", 4 * n).reshape(4, n).T
            made = [(chunk, k, bucket, n, _pack(totals[at[end - n : end]].T.ravel())) for (chunk, n, _, _), end in zip(parts, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), kinds, strict=True)], names=[c.split()[0] for c in _SUMS.split(", ")])

    return map_batches(blocks.repartition(buckets, "bucket"), run, _SUMS)


def _ordered(values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Values of at most ``bits`` bits, sorted, and the places that they came from, which rise among equal values."""
    place = len(values).bit_length()
    if bits + place > 63:
        order = np.argsort(values, kind="stable")
        return values[order], order
    both = values.astype(np.int64) << place  # sorting numbers is several times as fast as sorting places by them
    both |= np.arange(len(values))
    both.sort()
    return both >> place, both & ((1 << place) - 1)


def _chunk_losses(own: _Chunk, answers: dict[int, np.ndarray], totals: tuple[int, int], size: int, leave_out: bool) -> list[np.ndarray]:
    """Summed target and background losses of each document of a chunk; ``answers`` has by order the four sums of the chunk's n-grams, in the order of its counts."""
    n = len(own.owner)
    last = (np.cumsum(own.sizes) - 1)[own.owner]  # the last token of each token's document
    tables = own.counts()
    at, mine, before, often = {}, {}, {}, {}
    for k, grams in own.grams.items():
        if k == 1:
            keys, order = _ordered(grams, own.bits)
        else:
            # what comes before a token is the shorter n-gram that ends at the token before, but for a document's last one, that nothing follows
            before[k] = own.shifted(at[k - 1], int(np.searchsorted(tables[k - 1][0], own.context(k - 1))))
            often[k] = own.shifted(mine[k - 1] - (at[k - 1] == at[k - 1][last]), 1)
            keys, order = _ordered(before[k].astype(np.int64) << own.bits | own.grams[1], len(tables[k - 1][0]).bit_length() + own.bits)
        # a document's places stay together below each key
        edge = np.empty(n, bool)
        edge[:1] = True
        np.not_equal(keys[1:], keys[:-1], out=edge[1:])
        begin = np.flatnonzero(edge)
        at[k], mine[k] = np.empty(n, np.int32), np.empty(n, np.int32)
        at[k][order] = np.repeat(np.searchsorted(tables[k][0], grams[order[begin]]).astype(np.int32), np.diff(begin, append=n))
        owner = own.owner[order]
        edge[1:] |= owner[1:] != owner[:-1]
        length = np.diff(np.flatnonzero(edge), append=n)
        mine[k][order] = np.repeat(length.astype(np.int32), length)
    out = []
    for which, total in enumerate(totals):
        less = (own.marked.astype(np.int32) if which == 0 else 1) if leave_out else 0
        p = (answers[1][which][at[1]] - less * mine[1] + ADDED) / (total - less * own.sizes[own.owner] + ADDED * size)
        for k in range(2, own.order + 1):
            p *= PRIOR
            p += answers[k][which][at[k]] - less * mine[k]
            p /= answers[k - 1][2 + which][before[k]] - less * often[k] + PRIOR
        out.append(np.bincount(own.owner, -np.log(p), len(own.sizes)))
    return out


def score(docs: DataFrame, rank_file: str, pattern: str, size: int | None = None, order: int = 2, targets: DataFrame | None = None, leave_out: bool = False) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``target_loss``, ``background_loss`` (means over the tokens) and ``difference`` of every document.

    ``docs`` has ``doc_id``, ``text`` and ``is_target`` (null: not marked), or ``targets`` the ids of the marked ones. ``size`` is the number of ranks (None: all), ``order``
    1 to 3. With ``leave_out`` a document is scored without its own counts, so that no text is rated by a model that has seen it; equal texts still count for each other. A text
    without tokens has null losses. Without any marked document the target model is flat. Repeated rows count and are scored each, null ids
    as well; an empty table gives no rows; other columns are not read. A chunk is held in memory: some 100 bytes a token, so a text of 100 MB takes about 2.5 GB.
    """
    own_size = size or len(read_ranks(rank_file))
    found = written(tokens(docs, rank_file, pattern, size, targets), "tokens")
    lengths = F.arrays_zip("marked", "sizes")
    sums_of = lambda only: F.sum(F.aggregate(lengths, F.lit(0).cast("long"), lambda a, x: a + F.when(x["marked"] | F.lit(not only), x["sizes"]).otherwise(0)))
    marked, every = (int(x or 0) for x in found.agg(sums_of(True), sums_of(False)).first())
    buckets = max(int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-every // CHUNK))
    sums = Side(_summed_blocks(_blocks(found, own_size, order, buckets), buckets), "sums-by-chunk", every // 64)
    names = ["doc_id", "n_tokens", "target_loss", "background_loss"]

    def answer(chunk: int, own: _Chunk) -> dict[int, np.ndarray]:
        table = sums._of(chunk, 0)
        columns = [table.column(c).to_pylist() for c in ("at", "bucket", "n", "counts")]
        out = {}
        for k, (keys, _) in own.counts().items():
            parts = sorted((bucket, n, raw) for at, bucket, n, raw in zip(*columns, strict=True) if at == k)
            by, _ = _in_buckets(keys, own.bits if k > 1 else 0, buckets)
            out[k] = np.empty((4, len(keys)), np.int64)
            for column, values in zip(out[k], np.concatenate([_unpack(raw, "<u8", 4 * n).reshape(4, n) for _, n, raw in parts], axis=1), strict=True):
                column[by] = values
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _encoders.clear()
        for chunk, own in _chunks(batches, own_size, order):
            losses = _chunk_losses(own, answer(chunk, own), (marked, every), own_size, leave_out) if len(own.owner) else [np.zeros(len(own.sizes))] * 2
            none = own.sizes == 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(own.doc_ids, pa.int64()), pa.array(own.sizes), *(pa.array(x / np.maximum(own.sizes, 1), mask=none) for x in losses)], names=names
            )

    means = map_batches(found, run, "doc_id long, n_tokens long, target_loss double, background_loss double")
    return means.withColumn("difference", F.col("target_loss") - F.col("background_loss"))
