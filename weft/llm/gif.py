"""GIF as a column format: LZW coding, palettes, disposal, transparency, and frames with colour histograms.

:func:`decode` reads any GIF 87a or 89a: it decodes the LZW code stream of each image, applies its local
or the global palette, undoes interlacing, and draws it on the canvas under the transparency and disposal rules of its graphic control
extension. :func:`encode` stores bytes losslessly as palette indices of grey frames of 64 columns.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches, texts

WIDTH = 64
#: Rows of a stored frame at most: 64 KB of payload.
ROWS = 1024
DELAY_MS = 40
BINS = 16
_CODES = 4096
_GREY = bytes(v for v in range(256) for _ in range(3))


# --- LZW -------------------------------------------------------------------------------------------------------

_widths: dict[int, np.ndarray] = {}


def _widths_after_clear(first: int) -> np.ndarray:
    """Bits of the codes after a clear code, in order, while the table grows to its 4096 entries.

    ``first`` is the first free code. A reader adds an entry with each code but the first.
    """
    if first not in _widths:
        n = np.arange(_CODES)
        free = first + np.maximum(0, n - 1)
        _widths[first] = np.minimum(12, np.floor(np.log2(free)).astype(np.int64) + 1)
    return _widths[first]


def lzw_encode(data: bytes, depth: int = 8) -> bytes:
    """The code stream of pixels of ``depth`` bits: a clear code first and whenever the table is full, an end code last."""
    clear, end = 1 << depth, (1 << depth) + 1
    first = end + 1
    codes: list[int] = [clear]
    starts = [1]  # where the codes after each clear code begin
    add = codes.append
    known: dict[int, int] = {}
    get, free = known.get, first
    stream = iter(data)
    prefix = next(stream, None)
    if prefix is not None:
        for pixel in stream:
            key = prefix << 8 | pixel
            code = get(key)
            if code is not None:
                prefix = code
                continue
            add(prefix)
            prefix = pixel
            if free < _CODES:
                known[key] = free
                free += 1
            else:
                add(clear)
                starts.append(len(codes))
                known.clear()
                free = first
        add(prefix)
    add(end)
    values = np.array(codes, np.uint16)
    widths = np.empty(len(codes), np.int64)
    widths[0] = depth + 1
    after = _widths_after_clear(first)
    for a, b in zip(starts, [*starts[1:], len(codes)], strict=True):
        widths[a:b] = after[: b - a]
    bits = np.unpackbits(values.astype("<u2").view(np.uint8).reshape(-1, 2), axis=1, bitorder="little")
    cuts = [0, *(np.flatnonzero(np.diff(widths)) + 1).tolist(), len(codes)]
    runs = [bits[a:b, : widths[a]].ravel() for a, b in zip(cuts, cuts[1:], strict=False)]
    return np.packbits(np.concatenate(runs), bitorder="little").tobytes()


def lzw_decode(data: bytes, depth: int, most: int) -> bytes:
    """The first ``most`` pixels of a code stream; a stream that is broken or ends early is an error."""
    clear, end = 1 << depth, (1 << depth) + 1
    first = end + 1
    raw = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.uint32)
    window = raw[:-2] | raw[1:-1] << 8 | raw[2:] << 16
    widths = _widths_after_clear(first)
    ends = np.cumsum(widths)
    offsets = ends - widths
    n_bits, at, got = 8 * len(data), 0, 0
    roots = [bytes([i]) if i < clear else b"" for i in range(first)]
    out: list[bytes] = []
    table, prev = roots[:], b""
    fresh = True
    while got < most:
        if fresh:
            spots, sizes = at + offsets, widths
        else:  # a full table that goes on without a clear code
            sizes = np.full(_CODES, 12, np.int64)
            spots = at + 12 * np.arange(_CODES)
        n = int(np.searchsorted(spots + sizes, n_bits, "right"))
        if not n:
            raise ValueError("the code stream ends early")
        codes = window[spots[:n] >> 3] >> (spots[:n] & 7).astype(np.uint32) & ((1 << sizes[:n]) - 1).astype(np.uint32)
        stops = np.flatnonzero((codes == clear) | (codes == end))
        stop = int(stops[0]) if len(stops) else n
        before = len(out)
        todo = codes[:stop].tolist()
        try:
            if not prev and todo:
                prev = table[todo[0]]
                out.append(prev)
                todo = todo[1:]
            room = _CODES - len(table)
            add, grow = out.append, table.append
            for code in todo[:room]:
                if code == len(table):
                    entry = prev + prev[:1]
                else:
                    entry = table[code]
                grow(prev + entry[:1])
                add(entry)
                prev = entry
            if rest := todo[room:]:
                out.extend(map(table.__getitem__, rest))
                prev = out[-1]
        except IndexError as e:
            raise ValueError("the code stream has a code that isn't defined") from e
        got += sum(map(len, out[before:]))
        if stop < n:
            at = int(spots[stop] + sizes[stop])
            if codes[stop] == end:
                break
            table, prev, fresh = roots[:], b"", True
        else:
            if got < most and n < len(spots):
                raise ValueError("the code stream ends early")
            at, fresh = int(spots[n - 1] + sizes[n - 1]), False
    if got < most:
        raise ValueError("the code stream ends early")
    return b"".join(out)[:most]


# --- container -------------------------------------------------------------------------------------------------


@dataclass
class Image:
    """One image of a file: its place, palette indices and control data."""

    left: int
    top: int
    indices: np.ndarray
    palette: np.ndarray
    delay_ms: int
    disposal: int
    transparent: int | None


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255)) + b"\0"


def build(width: int, height: int, images: list[Image], palette: bytes = _GREY) -> bytes:
    """A GIF 89a file of images with up to 256 colours; images whose palette is ``palette`` use the global one."""
    shared = np.frombuffer(palette, np.uint8).reshape(-1, 3)
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0xF7, 0, 0), palette.ljust(768, b"\0")]
    for i in images:
        h, w = i.indices.shape
        out.append(b"\x21\xf9\x04" + struct.pack("<BHBB", i.disposal << 2 | (i.transparent is not None), i.delay_ms // 10, i.transparent or 0, 0))
        own = b"" if i.palette is shared or np.array_equal(i.palette, shared) else i.palette.astype(np.uint8).tobytes().ljust(768, b"\0")
        out.append(b"\x2c" + struct.pack("<HHHHB", i.left, i.top, w, h, 0x87 if own else 0) + own)
        out.append(b"\x08" + _blocks(lzw_encode(i.indices.tobytes())))
    return b"".join([*out, b"\x3b"])


#: Pixels of a canvas or image at most; a file that asks for more is an error.
MAX_PIXELS = 1 << 26


def parse(data: bytes, max_pixels: int = MAX_PIXELS) -> tuple[int, int, list[Image]]:
    """Width and height of the canvas and the images of a file; whatever is wrong with it is a ValueError."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF file")
    if len(data) < 13:
        raise ValueError("the file ends early")
    width, height, flags = struct.unpack_from("<HHB", data, 6)
    if width * height > max_pixels:
        raise ValueError(f"a canvas of {width} x {height} pixels")
    at = 13

    def colours(bits: int) -> np.ndarray:
        nonlocal at
        n = 2 << bits
        at += 3 * n
        return np.frombuffer(data, np.uint8, 3 * n, at - 3 * n).reshape(n, 3)

    def joined() -> bytes:
        nonlocal at
        got = []
        while n := data[at]:
            got.append(data[at + 1 : at + 1 + n])
            at += n + 1
        at += 1
        return b"".join(got)

    shared = colours(flags & 7) if flags & 0x80 else None
    images: list[Image] = []
    delay, disposal, transparent = 0, 0, None
    try:
        while (kind := data[at]) != 0x3B:
            at += 1
            if kind == 0x21:
                label = data[at]
                at += 1
                body = joined()
                if label == 0xF9:
                    packed, hundredths, index = struct.unpack_from("<BHB", body)
                    delay, disposal, transparent = 10 * hundredths, packed >> 2 & 7, index if packed & 1 else None
            elif kind == 0x2C:
                left, top, w, h, packed = struct.unpack_from("<HHHHB", data, at)
                at += 9
                if w * h > max_pixels:
                    raise ValueError(f"an image of {w} x {h} pixels")
                own = colours(packed & 7) if packed & 0x80 else shared
                if own is None:
                    raise ValueError("an image without a palette")
                depth = data[at]
                at += 1
                if not 2 <= depth <= 8:
                    raise ValueError("a code size out of range")
                pixels = np.frombuffer(lzw_decode(joined(), depth, w * h), np.uint8).reshape(h, w)
                if packed & 0x40:
                    order = np.concatenate([np.arange(a, h, s) for a, s in ((0, 8), (4, 8), (2, 4), (1, 2))])
                    straight = np.empty_like(pixels)
                    straight[order] = pixels
                    pixels = straight
                images.append(Image(left, top, pixels, own, delay, disposal, transparent))
                delay, disposal, transparent = 0, 0, None
            else:
                raise ValueError("an unknown block")
    except (IndexError, struct.error) as e:
        raise ValueError("the file ends early") from e
    return width, height, images


def frames(width: int, height: int, images: list[Image]) -> Iterator[tuple[Image, np.ndarray]]:
    """Each image with the RGBA canvas after it is drawn; parts outside the canvas are cut off.

    Disposal 2 clears the image's place to transparent before the next image, 3 restores what was there, others leave it.
    """
    canvas = np.zeros((height, width, 4), np.uint8)
    for i in images:
        place = (slice(i.top, i.top + i.indices.shape[0]), slice(i.left, i.left + i.indices.shape[1]))
        target = canvas[place]
        pixels = i.indices[: target.shape[0], : target.shape[1]]
        before = target.copy() if i.disposal == 3 else None
        palette = np.zeros((256, 4), np.uint8)
        palette[: len(i.palette), :3], palette[: len(i.palette), 3] = i.palette, 255
        colours = palette[pixels]
        if i.transparent is None:
            target[...] = colours
        else:
            shown = pixels != i.transparent
            target[shown] = colours[shown]
        yield i, canvas
        if i.disposal == 2:
            target[...] = 0
        elif before is not None:
            target[...] = before


def histograms(rgba: np.ndarray) -> list[list[int]]:
    """Pixels that aren't transparent, in 16 equal bins of red, green and blue."""
    shown = rgba[..., 3] > 0
    channels = [rgba[..., c].ravel() if shown.all() else rgba[..., c][shown] for c in range(3)]
    return [np.bincount(c, minlength=256).reshape(BINS, -1).sum(1).tolist() for c in channels]


# --- bytes as media --------------------------------------------------------------------------------------------


def padded(raw: bytes) -> bytes:
    """``raw`` and zero bytes up to a positive multiple of 64."""
    return raw + b"\0" * (max(1, -(-len(raw) // WIDTH)) * WIDTH - len(raw))


def encode(payload: bytes) -> bytes:
    """Bytes, a positive multiple of 64, as grey frames of 64 columns and up to 1024 rows, each shown for 40 ms."""
    pixels = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    grey = np.frombuffer(_GREY, np.uint8).reshape(-1, 3)
    images = [Image(0, 0, pixels[i : i + ROWS], grey, DELAY_MS, 2, None) for i in range(0, len(pixels), ROWS)]
    return build(WIDTH, min(ROWS, len(pixels)), images)


def digest(raw: bytes) -> tuple:
    """Stores a text's payload as media, reads the stored bytes back, and describes what was read."""
    media = encode(padded(raw))
    parts, red = [], np.zeros(BINS, np.int64)
    width, height, images = parse(media)
    for image, canvas in frames(width, height, images):
        shown = canvas[: image.indices.shape[0]]
        parts.append(shown[..., 0].tobytes())
        red += np.array(histograms(shown)[0])
    payload = b"".join(parts)
    feature = f"{len(images)}x{DELAY_MS}ms:" + "-".join(map(str, red.tolist()))
    return (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature)


DIGEST = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_digests(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """:func:`digest` of every whole text (null: empty), with its id; other columns are not read, repeated rows stay."""
    names = [id_column, *(c.split()[0] for c in DIGEST.split(", "))]
    kinds = [pa.int64() if c.endswith("long") else pa.string() for c in DIGEST.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [digest(raw) for raw in texts(batch.column(1))]
            columns = list(zip(*made, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=names)

    return map_batches(df.select(df[id_column].cast("long"), df[text_column].cast("string")), run, f"{id_column} long, {DIGEST}")


FRAMES = (
    "frame int, delay_ms int, width int, height int, rgba binary, hist_r array<long>, hist_g array<long>, hist_b array<long>, error string"
)


def decode_frames(df: DataFrame, id_column: str, media_column: str, max_pixels: int = MAX_PIXELS) -> DataFrame:
    """One row per frame of every GIF in ``media_column``: the composited canvas (RGBA) and its colour histograms.

    A null, empty or broken file, and one with a canvas or image of more than ``max_pixels`` pixels, gives one row with null frame columns and the reason in ``error``; frames
    before the fault are not given. A file without images gives no rows; repeated rows are decoded each, null ids as well; an empty table gives no rows. Other columns are not read.
    """
    kinds = [pa.int32()] * 4 + [pa.binary()] + [pa.list_(pa.int64())] * 3 + [pa.string()]
    names = [id_column, *(c.strip().split()[0] for c in FRAMES.split(", "))]

    def rows(data: bytes | None) -> Iterator[tuple]:
        try:
            if not data:
                raise ValueError("no data")
            width, height, images = parse(data, max_pixels)
        except ValueError as e:
            yield (None,) * 8 + (str(e),)
            return
        for k, (i, canvas) in enumerate(frames(width, height, images)):
            yield (k, i.delay_ms, width, height, canvas.tobytes(), *histograms(canvas), None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for made in rows(data):
                    yield pa.RecordBatch.from_arrays([pa.array([key], batch.schema.field(0).type), *(pa.array([v], k) for v, k in zip(made, kinds, strict=True))], names=names)

    kind = dict(df.dtypes)[id_column]
    return map_batches(df.select(df[id_column], df[media_column].cast("binary")), run, f"{id_column} {kind}, {FRAMES}")
