"""Cutting text where byte-level BPE vocabularies always cut it, and a cache of what each piece encodes to.

The pattern of these vocabularies never lets a match run past a space that stands between
two other characters, nor across a line feed. Text is therefore cut in front of every space and on both sides
of every line feed, and a worker encodes each distinct piece once. A piece that is a word is one match, and one that is a word and
then ASCII signs is two; these aren't cut by the pattern. Runs of three white-space characters, or of
two at the end of the text, may be matched as one; such texts are cut by the pattern itself.

Columns of texts are cut as bytes, all texts of a batch at once, and in front of ASCII signs that follow a letter as well: what a batch repeats is looked up once.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa

_RUNS = re.compile(r"\s\s\s|\s\s\Z")
#: Private-use characters; one that a text lacks marks the cuts.
_MARKS = [chr(c) for c in range(0xE000, 0xE010)]


def pieces(text: str) -> list[str] | None:
    """The pieces of a text, or None if it has to be cut by the pattern."""
    if _RUNS.search(text):
        return None
    mark = next((m for m in _MARKS if m not in text), None)
    if mark is None:
        return None
    return text.replace(" ", f"{mark} ").replace("\n", f"{mark}\n{mark}").split(mark)


#: ASCII signs that are neither letters, digits nor white space.
_SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


#: Bytes by what they are: ASCII letters, ASCII signs, ASCII white space, and those that may begin white space beyond ASCII.
_LETTER, _SIGN, _SPACE, _LEAD = 1, 2, 4, 8
_KINDS = np.zeros(256, np.uint8)
for _of, _kind in ((range(0x41, 0x5B), _LETTER), (range(0x61, 0x7B), _LETTER), (_SIGNS.encode(), _SIGN), ((*range(0x09, 0x0E), *range(0x1C, 0x21)), _SPACE), ((0xC2, 0xE1, 0xE2, 0xE3), _LEAD)):
    _KINDS[list(_of)] = _kind


def _uncut(data: np.ndarray, kinds: np.ndarray, bounds: np.ndarray) -> list[int]:
    """Numbers of the texts that have to be cut by the pattern; text i is data[bounds[i]:bounds[i + 1]]."""
    space = kinds == _SPACE
    two = space[:-1] & space[1:]
    ends = bounds[1:][np.diff(bounds) > 1]
    leads = np.flatnonzero(kinds == _LEAD)
    lead, second, third = data[leads], data[leads + 1], data[np.minimum(leads + 2, len(data) - 1)]
    # white space beyond ASCII, or some characters more
    wide = (lead == 0xC2) & ((second == 0x85) | (second == 0xA0)) | (lead == 0xE1) & (second == 0x9A) | (lead == 0xE3) & (second == 0x80) & (third == 0x80)
    wide |= (lead == 0xE2) & ((second == 0x80) & ((third < 0x8B) | (third == 0xA8) | (third == 0xA9) | (third == 0xAF)) | (second == 0x81))
    places = np.concatenate([np.flatnonzero(two[:-1] & two[1:]), ends[two[ends - 2]] - 1, leads[wide]])
    doubtful = np.unique(np.searchsorted(bounds, places, "right") - 1).tolist()
    return [i for i in doubtful if _RUNS.search(data[bounds[i] : bounds[i + 1]].tobytes().decode())]


def _starts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where the pieces of texts begin. No piece reaches from one text into the next, and a text that has to be cut by the pattern is one piece."""
    kinds = _KINDS[data]
    cut = data == 0x20
    feeds = np.flatnonzero(data == 0x0A)
    cut[feeds] = True
    cut[feeds[feeds + 1 < len(data)] + 1] = True
    signs = np.flatnonzero(kinds == _SIGN)
    signs = signs[signs > 0]
    before = data[signs - 1]
    # letters of U+00C0 to U+00FF are two bytes, and all but two of these characters are letters
    latin = (before >= 0x80) & (before != 0x97) & (before != 0xB7) & (data[np.maximum(signs - 2, 0)] == 0xC3)
    cut[signs[(kinds[signs - 1] == _LETTER) | latin]] = True
    for i in _uncut(data, kinds, bounds):
        cut[bounds[i] : bounds[i + 1]] = False
    cut[bounds[:-1][bounds[:-1] < len(data)]] = True
    return np.flatnonzero(cut)


def _parts(column: pa.Array) -> tuple[pa.Buffer, np.ndarray]:
    """The bytes of a large string or binary column without nulls, and where each value begins and ends in them."""
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    return pa.py_buffer(b"") if data is None else data.slice(int(bounds[0]), int(bounds[-1] - bounds[0])), bounds - bounds[0]


def _plain(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Which pieces are words of ASCII letters and letters of U+00C0 to U+00FF alone."""
    fits = _KINDS[data] == _LETTER
    two = np.flatnonzero(data[:-1] == 0xC3)
    two = two[(data[two + 1] != 0x97) & (data[two + 1] != 0xB7)]
    fits[two] = fits[two + 1] = True
    fitting = np.concatenate([[0], np.cumsum(fits)])
    begin, end = bounds[:-1] + (data[bounds[:-1]] == 0x20), bounds[1:]
    return (end > begin) & (fitting[end] - fitting[begin] == end - begin)


def is_word(piece: str) -> bool:
    """Whether a piece is letters, with or without a space in front; letters beyond U+024F are left to the pattern, as what counts as one differs by Unicode's version."""
    word = piece[1:] if piece[:1] == " " else piece
    return word.isalpha() and (word.isascii() or max(word) < "\u0250")


#: Bytes of the longest piece that a column's encoding remembers.
_LONG = 64


class _Known(dict):
    """What pieces encode to; a missing one is taken from the generation before, or encoded on the spot."""

    def __init__(self, make: Callable[[str], bytes]):
        super().__init__()
        self.make = make
        self.before: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        found = self.before.get(piece)
        self[piece] = found = self.make(piece) if found is None else found
        return found

    def turn(self) -> None:
        """Starts a new generation; pieces that nothing asks for until the next one are forgotten."""
        self.before = dict(self)
        self.clear()


class Encoder:
    """Encodes texts to ids, kept as bytes of unsigned integers.

    ``encode_one`` takes a pre-token and returns its ids in that form, and so does ``encode_bytes`` of a pre-token as UTF-8. About ``most`` pieces and pre-tokens are remembered in each of
    two generations; what is forgotten is encoded again, which costs time but changes no result.
    """

    def __init__(self, findall: Callable[[str], list[str]], encode_one: Callable[[str], bytes], most: int = 150_000, encode_bytes: Callable[[bytes], bytes] | None = None):
        self.findall, self.most = findall, most
        self.of_pretoken = _Known(encode_one)
        self.of_piece = _Known(self._piece)
        self.encode_one = encode_one
        self.encode_bytes = encode_bytes or (lambda p: encode_one(p.decode()))
        self.of_bytes: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        word = piece.rstrip(_SIGNS)
        if is_word(word):
            return self.encode_one(piece) if len(word) == len(piece) else self.of_piece[word] + self.of_pretoken[piece[len(word) :]]
        return b"".join(map(self.of_pretoken.__getitem__, self.findall(piece)))

    def encode(self, text: str) -> bytes:
        """The ids of a whole text."""
        for known in (self.of_piece, self.of_pretoken):
            if len(known) > self.most:
                known.turn()
        cut = pieces(text)
        if cut is None:
            return b"".join(map(self.of_pretoken.__getitem__, self.findall(text)))
        return b"".join(map(self.of_piece.__getitem__, cut))

    def _new(self, piece: bytes, plain: bool) -> bytes:
        """What a piece, as UTF-8, encodes to; ``plain`` says that it is a word for certain."""
        if plain:
            return self.encode_bytes(piece)
        text = piece.decode()
        return self.encode_bytes(piece) if is_word(text) else b"".join([self.encode_bytes(p.encode()) for p in self.findall(text)])

    def encode_many(self, column: pa.Array) -> list[bytes]:
        """The ids of each text of a string column; null is empty. Distinct pieces are looked up once, those of up to 64 bytes are remembered as in :meth:`encode`."""
        column = column.cast(pa.large_string()).fill_null("")
        raw, bounds = _parts(column)
        if not len(raw):
            return [b""] * len(column)
        data = np.frombuffer(raw, np.uint8)
        starts = _starts(data, bounds)
        every = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(data))), raw]).dictionary_encode()
        if len(self.of_bytes) > self.most:
            self.before, self.of_bytes = self.of_bytes, {}
        own, edges = _parts(every.dictionary)
        plain, edges, own = _plain(np.frombuffer(own, np.uint8), edges).tolist(), edges.tolist(), own.to_pybytes()
        distinct = [own[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
        found = list(map(self.of_bytes.get, distinct))
        for i in [i for i, ids in enumerate(found) if ids is None]:
            piece = distinct[i]
            found[i] = ids = self.before.get(piece) or self._new(piece, plain[i])
            if len(piece) <= _LONG:
                self.of_bytes[piece] = ids
        flat, ends = _parts(pa.array(found, pa.large_binary()).take(every.indices))
        flat, ends = memoryview(flat), ends[np.searchsorted(starts, bounds)].tolist()
        return [bytes(flat[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
