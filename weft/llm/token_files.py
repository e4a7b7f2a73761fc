"""Token ids as flat binary files: unsigned ids, 64-bit document offsets, partition bases by prefix sums.

Documents are dealt by ranges of their id, so that files in the order of their partitions hold documents in ascending
order. A task writes one pair of files: ``NAME.ids`` with little-endian unsigned ids, of 16 bits if the vocabulary
has at most 65,536 of them and else of 32, and ``NAME.idx`` with little-endian signed 64-bit integers, namely n + 1 offsets into the ids and then n document ids (null:
the smallest integer). A name holds the partition and a random part, so a task that runs twice never
overwrites a file; the manifest has the files of the tasks that count. A file's base, the ids in all files before it, is a prefix sum over
the manifest, which has one row per file.
"""

from __future__ import annotations

import json
import os
import re
import struct
import tempfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import byte_characters
from .common import gathered, map_batches, open_store
from .pretokens import Encoder

NO_ID = -(1 << 63)
_MANIFEST = "partition int, name string, kind string, n_docs long, n_tokens long"


class TokenizerEncoder:
    """Whole texts to ids by a file of the tokenizers library as it comes, with ``add_special_tokens=False``.

    A byte-level BPE without normalizer and prefix space is run on distinct pre-tokens, which gives the same ids as on whole
    texts. Texts that hold the string of an added token, and any other tokenizer, go through the library as wholes.
    """

    def __init__(self, path: str, pattern: str):
        import regex
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        added = sorted(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.added_bytes = re.compile(self.added.pattern.encode()) if added else None
        spec = json.loads(self.tokenizer.to_str())
        pre = spec["pre_tokenizer"] or {}
        self.kind = "<u2" if self.tokenizer.get_vocab_size(True) <= 1 << 16 else "<u4"
        self.encoder = None
        if spec["normalizer"] is None and spec["model"]["type"] == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre["add_prefix_space"]:
            character = byte_characters()
            tokenize = self.tokenizer.model.tokenize

            pack = [struct.Struct(f"<{n}{'H' if self.kind == '<u2' else 'I'}").pack for n in range(65)]

            def encode_bytes(pretoken: bytes) -> bytes:
                # ASCII letters stand for themselves
                if pretoken[1:].isalpha():
                    found = tokenize(character[pretoken[0]] + pretoken[1:].decode("ascii"))
                else:
                    found = tokenize("".join([character[b] for b in pretoken]))
                ids = [t.id for t in found]
                return pack[len(ids)](*ids) if len(ids) < 65 else np.array(ids, self.kind).tobytes()

            self.encoder = Encoder(regex.compile(pattern).findall, lambda p: encode_bytes(p.encode()), most=300_000, encode_bytes=encode_bytes)

    def encode(self, text: str) -> bytes:
        if self.encoder and not (self.added and self.added.search(text)):
            return self.encoder.encode(text)
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def encode_many(self, column: pa.Array) -> list[bytes]:
        """The ids of each text of a string column; null is empty."""
        if not self.encoder:
            return [self.encode(t or "") for t in column.to_pylist()]
        whole = {}
        if self.added and any(self.added_bytes.search(b) for b in column.buffers()[2:] if b is not None):
            whole = {i: self.encode(t) for i, t in enumerate(column.to_pylist()) if t and self.added.search(t)}
            column = pc.if_else(pa.array([i in whole for i in range(len(column))]), "", column) if whole else column
        made = self.encoder.encode_many(column)
        for i, ids in whole.items():
            made[i] = ids
        return made


_encoders: dict[tuple[str, str], TokenizerEncoder] = {}


def encoder(path: str, pattern: str) -> TokenizerEncoder:
    """The encoder of a tokenizer file, made once in a worker."""
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = TokenizerEncoder(path, pattern)
    return _encoders[path, pattern]


def write_token_files(
    df: DataFrame, folder: str, tokenizer_file: str, pattern: str, end_id: int = 0, id_column: str = "doc_id", text_column: str = "text"
) -> list[dict]:
    """Encodes every whole text (null: empty), appends ``end_id``, and writes ids and offsets to ``folder`` in ascending order of ids.

    Null ids come first, repeated ids follow one another; other columns are not read. Returns the manifest, one
    entry per file with ``base``, and writes it to ``folder`` as well. An empty table gives an empty manifest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sizes, ids, partition = None, [], [], TaskContext.get().partitionId()
        fs, root = open_store(folder)
        name = f"part-{partition:06d}-{uuid.uuid4().hex}"
        out = None
        for batch in gathered(batches):
            if out is None:
                own = encoder(tokenizer_file, pattern)
                end = np.array([end_id], own.kind).tobytes()
                fs.create_dir(root, recursive=True)
                out = fs.open_output_stream(f"{root}/{name}.ids")
            made = [ids + end for ids in own.encode_many(batch.column(1))]
            out.write(b"".join(made))
            sizes.append(np.fromiter(map(len, made), np.int64, len(made)) // len(end))
            ids.append(batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False).astype("<i8"))
        if out is None:
            return
        out.close()
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype("<i8")
        with fs.open_output_stream(f"{root}/{name}.idx") as f:
            f.write(offsets.tobytes() + np.concatenate(ids).tobytes())
        yield pa.RecordBatch.from_pydict(
            {"partition": pa.array([partition], pa.int32()), "name": [name], "kind": [own.kind], "n_docs": [len(offsets) - 1], "n_tokens": [int(offsets[-1])]}
        )

    rows = df.select(df[id_column].cast("long").alias("id"), df[text_column].cast("string").alias("text"))
    # the second key only spreads rows that share an id
    dealt = rows.repartitionByRange("id", F.xxhash64("text")).sortWithinPartitions("id", F.xxhash64("text"))
    files = sorted((r.asDict() for r in map_batches(dealt, run, _MANIFEST).collect()), key=lambda r: r["partition"])
    base = 0
    for f in files:
        f["base"], base = base, base + f["n_tokens"]
    fs, root = open_store(folder)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/manifest.json") as out:
        out.write(json.dumps({"end_id": end_id, "n_tokens": base, "files": files}).encode())
    return files


class TokenFile:
    """A file of ids and its offsets, memory-mapped; files of a remote store are copied to a local file first."""

    def __init__(self, folder: str, name: str, kind: str):
        fs, root = open_store(folder)
        self.copies = []

        def mapped(suffix: str, kind: str) -> np.ndarray:
            path = f"{root}/{name}.{suffix}"
            if not isinstance(fs, pyarrow.fs.LocalFileSystem):
                fd, local = tempfile.mkstemp()
                os.close(fd)
                self.copies.append(local)
                pyarrow.fs.copy_files(path, local, source_filesystem=fs, destination_filesystem=pyarrow.fs.LocalFileSystem())
                path = local
            return np.memmap(path, kind, "r") if os.path.getsize(path) else np.empty(0, kind)

        index = mapped("idx", "<i8")
        n = len(index) // 2
        self.offsets, self.doc_ids, self.ids = index[: n + 1], index[n + 1 :], mapped("ids", kind)

    def __getitem__(self, k: int) -> np.ndarray:
        """The ids of the file's k-th document."""
        return self.ids[self.offsets[k] : self.offsets[k + 1]]

    def close(self) -> None:
        for path in self.copies:
            os.unlink(path)


def read_token_digests(spark: SparkSession, folder: str, files: list[dict], id_column: str = "doc_id") -> DataFrame:
    """What the files hold, per document: its id, ``start``, ``n_tokens`` and ``ids_crc32`` (over the ids as little-endian unsigned 32-bit integers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                f = TokenFile(folder, row["name"], row["kind"])
                for at in range(0, row["n_docs"], 4096):
                    to = min(at + 4096, row["n_docs"])
                    ids = f.doc_ids[at:to]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(ids, pa.int64(), mask=ids == NO_ID),
                            pa.array(f.offsets[at:to] + row["base"], pa.int64()),
                            pa.array(np.diff(f.offsets[at : to + 1]), pa.int64()),
                            pa.array([zlib.crc32(f[k].astype("<u4").tobytes()) for k in range(at, to)], pa.int64()),
                        ],
                        names=[id_column, "start", "n_tokens", "ids_crc32"],
                    )
                f.close()

    rows = spark.createDataFrame([(f["name"], f["kind"], f["n_docs"], f["base"]) for f in files], "name string, kind string, n_docs long, base long")
    return map_batches(rows.repartition(max(1, len(files))), run, f"{id_column} long, start long, n_tokens long, ids_crc32 long")
