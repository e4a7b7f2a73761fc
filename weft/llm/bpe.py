"""Byte-level BPE encoding and decoding with a sentencepiece model that is written straight from a rank file.

A rank file lists the byte strings of a vocabulary, each with its rank. :func:`model_bytes` serialises
a sentencepiece BPE model with one piece per rank: its bytes are mapped to printable characters, one per byte, and its
score is the negative rank, so that sentencepiece joins pairs in the order of the ranks. Normalisation is the
identity and no space is added or escaped. Texts are cut by the vocabulary's pattern, each pre-token is mapped to
these characters and encoded by itself; decoding maps ids back to bytes.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches
from .pretokens import Encoder


def byte_characters() -> list[str]:
    """For each byte a printable character of its own: itself where it prints, the rest from U+0100 on."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in prints else chr(next(rest)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """The byte strings and ranks of a rank file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int | float) -> bytes:
    """A protobuf field: bytes by length, integers as varints, floats in 32 bits."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


# Field numbers and codes of sentencepiece's published model format.
_PIECE, _TRAINER, _NORMALIZER = 1, 2, 3
_UNKNOWN_TYPE, _NORMAL_TYPE, _BPE_KIND = 2, 1, 2
_MODEL_KIND, _VOCAB_SIZE, _UNK_ID, _BOS_ID, _EOS_ID, _PAD_ID = 3, 4, 40, 41, 42, 43


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """A serialised sentencepiece model whose piece ids are the ranks; the id after the last is its unknown piece.

    The ranks have to run from 0 without gaps and hold all 256 single bytes.
    """
    order = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in order] != list(range(len(order))):
        raise ValueError("ranks have to run from 0 without gaps")
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("every single byte needs a rank")
    character = byte_characters()
    out = [
        _field(_PIECE, _field(1, "".join(map(character.__getitem__, t)).encode()) + _field(2, float(-r)) + _field(3, _NORMAL_TYPE))
        for r, t in enumerate(order)
    ]
    out.append(_field(_PIECE, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, _UNKNOWN_TYPE)))
    absent = (1 << 64) - 1  # -1 as a varint
    trainer = _field(_MODEL_KIND, _BPE_KIND) + _field(_VOCAB_SIZE, len(order) + 1) + _field(_UNK_ID, len(order))
    trainer += b"".join(_field(n, absent) for n in (_BOS_ID, _EOS_ID, _PAD_ID))
    # identity rules; no dummy prefix, no removal of extra white space, no escaping of white space
    normalizer = _field(1, b"identity") + b"".join(_field(n, 0) for n in (3, 4, 5))
    return b"".join(out) + _field(_TRAINER, trainer) + _field(_NORMALIZER, normalizer)


class Codec:
    """Encodes and decodes whole texts with the model of a rank file."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(ranks))
        character = dict(enumerate(byte_characters()))
        encode = model.encode

        def encode_one(pretoken: str) -> bytes:
            ids = encode(pretoken.encode().decode("latin-1").translate(character))
            return struct.pack(f"<{len(ids)}I", *ids)

        self.encoder = Encoder(regex.compile(pattern).findall, encode_one)
        self.bytes_of = sorted(ranks, key=ranks.__getitem__)

    def encode(self, text: str) -> list[int]:
        found = self.encoder.encode(text)
        return list(memoryview(found).cast("I"))

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of a sequence of ids; an id without a piece is an error."""
        return b"".join(map(self.bytes_of.__getitem__, ids))


_codecs: dict[tuple[str, str], Codec] = {}


def codec(rank_file: str, pattern: str) -> Codec:
    """The codec of a rank file, made once in a worker."""
    key = (rank_file, pattern)
    if key not in _codecs:
        _codecs[key] = Codec(read_ranks(rank_file), pattern)
    return _codecs[key]


def encode_documents(df: DataFrame, rank_file: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Ids of every whole text and their decoding: ``id_column``, ``ids`` (array of int), ``decoded`` (binary).

    A null text is empty: no ids and no bytes. Rows are kept as they are, repeated and null ids included; no other column
    is read. Each row is encoded by itself, without a shuffle.
    """
    return _mapped(df, rank_file, pattern, id_column, text_column, f"{id_column} long, ids array<int>, decoded binary", lambda ids, raw: (ids, raw))


def token_digests(df: DataFrame, rank_file: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Of :func:`encode_documents` only the count of ids and digests of ids and decoded bytes, so that neither has to leave the worker.

    ``id_column``, ``n_tokens``, ``ids_sha256`` (of decimal ids joined by commas), ``decoded_sha256``.
    """

    def digest(ids: list[int], raw: bytes) -> tuple[int, str, str]:
        return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(raw).hexdigest()

    return _mapped(df, rank_file, pattern, id_column, text_column, f"{id_column} long, n_tokens long, ids_sha256 string, decoded_sha256 string", digest)


def _mapped(df: DataFrame, rank_file: str, pattern: str, id_column: str, text_column: str, schema: str, make) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(rank_file, pattern)
        kinds = None
        for batch in batches:
            made = []
            for text in batch.column(1).to_pylist():
                ids = own.encode(text or "")
                made.append(make(ids, own.decode(ids)))
            columns = list(zip(*made, strict=True)) or [() for _ in names[1:]]
            kinds = kinds or {"ids": pa.list_(pa.int32()), "decoded": pa.binary(), "n_tokens": pa.int64()}
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), *(pa.array(c, kinds.get(n, pa.string())) for c, n in zip(columns, names[1:], strict=True))], names=names
            )

    return map_batches(df.select(df[id_column].cast("long"), df[text_column].cast("string")), run, schema)
