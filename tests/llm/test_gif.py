import hashlib
import os
import random
import struct
import zlib

import numpy as np
import pytest

from weft.llm import gif
from weft.llm.gif import Image, build, decode_frames, digest, encode, frames, lzw_decode, lzw_encode, media_digests, padded, parse


def test_code_streams_round_trip():
    r = random.Random(1)
    for depth in (2, 3, 5, 8):
        for n in (0, 1, 2, 3, 50, 700, 6000, 30_000):
            data = bytes(r.randrange(1 << depth) for _ in range(n))
            assert lzw_decode(lzw_encode(data, depth), depth, n) == data
    for data in (b"a" * 100_000, b"ab" * 40_000, os.urandom(50_000)):
        assert lzw_decode(lzw_encode(data), 8, len(data)) == data


def test_known_stream():
    # 10 x 10 pixels of four colours, a published example of the format
    stream = bytes.fromhex("8c2d99872a1cdc33a0027 5ec95faa8de608c04914c01".replace(" ", ""))
    pixels = lzw_decode(stream, 2, 100)
    assert pixels[:10] == bytes([1, 1, 1, 1, 1, 2, 2, 2, 2, 2]) and len(pixels) == 100 and set(pixels) == {0, 1, 2}


def test_full_table_without_a_clear_code():
    """Codes of 12 bits go on when the table is full and no clear code comes."""
    data = os.urandom(9000)
    codes, widths, table, nxt, prefix = [256], [9], {bytes([i]): i for i in range(256)}, 258, b""
    for b in data:
        if prefix + bytes([b]) in table:
            prefix += bytes([b])
            continue
        codes.append(table[prefix])
        if nxt < 4096:
            table[prefix + bytes([b])] = nxt
            nxt += 1
        prefix = bytes([b])
    codes += [table[prefix], 257]
    bits, free, n = [], 258, 0
    for c in codes:
        width = 9 if c == 256 and n == 0 else min(12, (258 + max(0, n - 2)).bit_length())
        bits += [c >> k & 1 for k in range(width)]
        n += 1
    stream = np.packbits(np.array(bits, np.uint8), bitorder="little").tobytes()
    assert lzw_decode(stream, 8, len(data)) == data


def test_broken_streams():
    good = lzw_encode(b"abcabcabc")
    for bad in (b"", good[:3], b"\xff" * 9):
        with pytest.raises(ValueError):
            lzw_decode(bad, 8, 9)
    for bad in (b"", b"GIF89a", b"PNG" * 20, encode(padded(b"x"))[:-20]):
        with pytest.raises((ValueError, struct.error)):
            parse(bad)


def test_disposal_transparency_and_palettes():
    grey = np.frombuffer(gif._GREY, np.uint8).reshape(-1, 3)
    own = np.zeros((256, 3), np.uint8)
    own[1] = (255, 0, 0)
    one = lambda *p: np.array(p, np.uint8).reshape(1, -1)
    images = [Image(0, 0, one(5, 6), grey, 10, 0, None), Image(0, 0, one(1, 9), own, 20, 3, 9), Image(1, 0, one(7), grey, 30, 2, None), Image(0, 0, one(8), grey, 40, 0, None)]
    width, height, got = parse(build(2, 1, images))
    shown = [(i.delay_ms, c.tolist()) for i, c in ((i, c.copy()) for i, c in frames(width, height, got))]
    g = lambda v: [v, v, v, 255]
    assert shown == [(10, [[g(5), g(6)]]), (20, [[[255, 0, 0, 255], g(6)]]), (30, [[g(5), g(7)]]), (40, [[g(8), [0, 0, 0, 0]]])]


def test_interlaced_rows():
    pixels = np.arange(20, dtype=np.uint8).reshape(20, 1)
    order = np.concatenate([np.arange(a, 20, s) for a, s in ((0, 8), (4, 8), (2, 4), (1, 2))])
    data = bytearray(build(1, 20, [Image(0, 0, pixels[order], np.frombuffer(gif._GREY, np.uint8).reshape(-1, 3), 0, 0, None)]))
    at = data.index(b"\x2c\0\0\0\0\1\0\x14\0\0") + 9
    data[at] |= 0x40
    assert parse(bytes(data))[2][0].indices.tolist() == pixels.tolist()


def test_digests(spark):
    texts = [None, "", "a", "é" * 100, "long " * 40_000, "a"]
    df = spark.createDataFrame([(i, t, 3) for i, t in enumerate(texts)], "doc_id long, text string, media_bytes long")
    for r in media_digests(df).collect():
        raw = (texts[r["doc_id"]] or "").encode()
        payload = padded(raw)
        media = encode(payload)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest()) and r["feature"] == digest(raw)[6]
    assert media_digests(df.limit(0)).count() == 0


def test_frames_as_rows(spark):
    media = [(1, encode(padded(b"x" * 70_000))), (2, None), (3, b"nothing"), (4, encode(padded(b"")))]
    out = decode_frames(spark.createDataFrame(media, "id long, media binary"), "id", "media").collect()
    assert sorted((r["id"], r["frame"], r["delay_ms"]) for r in out if r["error"] is None) == [(1, 0, 40), (1, 1, 40), (4, 0, 40)]
    assert sorted(r["id"] for r in out if r["error"]) == [2, 3]
    first = next(r for r in out if r["id"] == 1 and r["frame"] == 0)
    assert first["hist_r"][ord("x") >> 4] == 64 * 1024 == sum(first["hist_r"]) and len(first["rgba"]) == 64 * 1024 * 4


def test_broken_files_are_rows(spark):
    whole = encode(padded(b"some text"))
    huge = b"GIF89a" + struct.pack("<HHBBB", 65535, 65535, 0, 0, 0) + b"\x3b"
    large = whole[:-1] + b"\x2c" + struct.pack("<HHHHB", 0, 0, 60000, 60000, 0) + b"\x08\x00\x3b"
    broken = [b"GIF89a", huge, large, *(whole[:n] for n in range(len(whole))), whole[:800] + b"\xff" * 40]
    out = decode_frames(spark.createDataFrame(list(enumerate(broken)), "id long, media binary"), "id", "media").collect()
    assert sorted(r["id"] for r in out) == list(range(len(broken))) and all(r["error"] and r["frame"] is None for r in out)


def plain_lzw(data, depth):
    """A decoder that reads one bit after the other and keeps a dictionary of strings."""
    bits = [byte >> i & 1 for byte in data for i in range(8)]
    clear, at, out = 1 << depth, 0, bytearray()
    table, width, before = {}, depth + 1, None
    while True:
        code = sum(b << i for i, b in enumerate(bits[at : at + width]))
        at += width
        if code == clear:
            table, width, before = {i: bytes([i]) for i in range(clear)} | {clear: b"", clear + 1: b""}, depth + 1, None
            continue
        if code == clear + 1:
            return bytes(out)
        entry = table[code] if code in table else before + before[:1]
        out += entry
        if before is not None and len(table) < 4096:
            table[len(table)] = before + entry[:1]
        width = min(12, max(depth + 1, len(table).bit_length()))
        before = entry


def test_stored_media_by_another_decoder():
    r = np.random.default_rng(3)
    for raw in (b"", b"abc" * 500, "äöü ".encode() * 300, r.integers(0, 256, 9000, np.uint8).tobytes(), b"x" * 70_000):
        media, payload, at, got = encode(padded(raw)), padded(raw), 13 + 768, b""
        assert media[:6] == b"GIF89a" and media[-1] == 0x3B
        while media[at] != 0x3B:
            if media[at] == 0x21:
                at += 2
            else:
                assert media[at] == 0x2C and media[at + 9] == 0 and media[at + 10] == 8
                at += 11
                stream = b""
                while media[at]:
                    stream += media[at + 1 : at + 1 + media[at]]
                    at += 1 + media[at]
                at += 1
                got += plain_lzw(stream, 8)
                continue
            while media[at]:
                at += 1 + media[at]
            at += 1
        assert got == payload
