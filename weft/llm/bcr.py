"""Column-wise construction of the Burrows-Wheeler transform of many strings, with common prefixes.

Each round inserts one symbol of every string, from the last to the first: the suffix S of a string becomes xS. Where xS
belongs follows from the transform so far: as the strings' next symbols stand in it at their suffixes' places, xS comes after as many
suffixes as there are smaller symbols, and equal ones further up. Its common prefix with its neighbour is one more than the least
common prefix between S and the nearest place further up (or down) that has x as well, which is a range minimum.

Between rounds both columns lie in two files that are read and written front to back, so that memory holds the columns of one
round and the strings, and nothing grows with the number of rounds. Common prefixes are capped at 255, or at ``cap``.
"""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Stands in the transform where a string has no symbol left; never a byte of UTF-8.
END = 0xFF


class _Files:
    """The two columns of the last round; rounds take turns between two pairs of files, overwritten front to back."""

    def __init__(self, folder: str):
        self.files = [[os.open(os.path.join(folder, f"{name}.{turn}"), os.O_RDWR | os.O_CREAT, 0o600) for name in ("transform", "prefixes")] for turn in (0, 1)]
        self.round, self.size = 0, 0

    def write(self, *columns: np.ndarray) -> None:
        self.round += 1
        self.size = len(columns[0])
        for fd, column in zip(self.files[self.round & 1], columns, strict=True):
            data, at = memoryview(column), 0
            while at < len(data):
                at += os.pwrite(fd, data[at : at + (1 << 24)], at)

    def read(self) -> list[np.ndarray]:
        columns = []
        for fd in self.files[self.round & 1]:
            column = np.empty(self.size, np.uint8)
            data, at = memoryview(column), 0
            while at < len(data):
                at += os.preadv(fd, [data[at : at + (1 << 24)]], at)
            columns.append(column)
        return columns

    def close(self) -> None:
        for fd in sum(self.files, []):
            os.close(fd)


def _range_minima(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The least of values[lo..hi], ends included, for each pair."""
    out = np.empty(len(lo), values.dtype)
    level = np.frexp((hi - lo + 1).astype(np.float64))[1] - 1
    step, table, top = 1, values, int(level.max(initial=0))
    for k in range(top + 1):
        pick = np.flatnonzero(level == k)
        if len(pick):
            out[pick] = np.minimum(table[lo[pick]], table[hi[pick] - step + 1])
        if k < top:
            table = np.minimum(table[:-step], table[step:])
            step *= 2
    return out


def _by_symbol(column: np.ndarray) -> np.ndarray:
    """The places of a column of bytes, one symbol after another; a counting sort."""
    return pc.array_sort_indices(pa.array(column)).to_numpy(zero_copy_only=False).view(np.int64)


def _nth(order: np.ndarray, smaller: np.ndarray, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How often the symbol stands before each place, from the places in the order of their symbols; queries rise by symbol and place."""
    out = np.empty(len(at), np.int64)
    edges = [*np.flatnonzero(np.diff(symbol, prepend=symbol[:1] ^ 1)).tolist(), len(at)]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        of = int(symbol[a])
        out[a:b] = np.searchsorted(order[smaller[of] : smaller[of + 1]], at[a:b])
    return out


def _inserted(at: np.ndarray, *columns: tuple[np.ndarray, np.ndarray]) -> Iterator[np.ndarray]:
    """Of each pair of columns the first with the second at the (rising) places ``at`` of the result."""
    keep = np.ones(len(columns[0][0]) + len(at), bool)
    keep[at] = False
    for old, new in columns:
        out = np.empty(len(keep), old.dtype)
        out[keep] = old
        out[at] = new
        yield out


def build(strings: list[bytes], cap: int, folder: str | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Transform, common prefixes (with the suffix before, at most ``cap``) and each whole string's place in the order of all suffixes.

    The empty suffixes come first, in the order of the strings. Strings hold no byte 0xFF and aren't empty.
    """
    if not 0 < cap < 256:
        raise ValueError("cap has to be 1 to 255")
    n = len(strings)
    sizes = np.fromiter(map(len, strings), np.int64, n)
    ends = np.cumsum(sizes)
    symbols = np.frombuffer(b"".join(strings), np.uint8)
    # dense symbols keep the order of the bytes; the last one stands for END
    alphabet = np.flatnonzero(np.bincount(symbols, minlength=256))
    dense = np.zeros(256, np.uint8)
    dense[alphabet] = np.arange(len(alphabet))
    symbols, none = dense[symbols], len(alphabet)
    own = tempfile.mkdtemp(prefix="bcr-", dir=folder)
    files = _Files(own)
    try:
        files.write(symbols[ends - 1], np.zeros(n, np.uint8))
        total = np.bincount(symbols[ends - 1], minlength=none + 1)  # of each symbol in the transform
        place = np.arange(n)  # of each string's last inserted suffix
        live, finished = np.arange(n), np.empty(0, np.int64)
        for done in range(1, int(sizes.max(initial=0)) + 1):
            transform, prefixes = files.read()
            ended, live = live[sizes[live] < done], live[sizes[live] >= done]
            finished = np.concatenate([finished, ended])
            # the places of each symbol, one symbol after another
            order = _by_symbol(transform)
            below = np.concatenate([[0], np.cumsum(total)])
            came = place[live]
            symbol = transform[came]
            # the suffixes longer by a symbol, in order; this one's own and the places with the same symbol before and after
            by_order = np.argsort(symbol.astype(np.int64) * len(transform) + came)
            live, came, symbol = live[by_order], came[by_order], symbol[by_order]
            nth = _nth(order, below, symbol, came)
            at = n + below[symbol] + nth
            shared = np.zeros((2, len(live)), np.uint8)
            has_back, has_on = nth > 0, nth + 1 < total[symbol]
            # neighbours that are new themselves have come from known places; the others are looked up
            beside = np.flatnonzero((np.diff(at) == 1) & (np.diff(symbol.astype(np.int16)) == 0))
            from_back, from_on = np.full(len(live), -1), np.full(len(live), -1)
            from_back[beside + 1], from_on[beside] = came[beside], came[beside + 1]
            seek_back, seek_on = np.flatnonzero(has_back & (from_back < 0)), np.flatnonzero(has_on & (from_on < 0))
            from_back[seek_back] = order[below[symbol[seek_back]] + nth[seek_back] - 1]
            from_on[seek_on] = order[below[symbol[seek_on]] + nth[seek_on] + 1]
            back, on = np.flatnonzero(has_back), np.flatnonzero(has_on)
            lo = np.concatenate([from_back[back], came[on]])
            hi = np.concatenate([came[back], from_on[on]])
            least = np.minimum(_range_minima(prefixes, lo + 1, hi), cap - 1) + 1
            shared[0, back], shared[1, on] = least[: len(back)], least[len(back) :]
            coming = np.where(sizes[live] > done, symbols[np.maximum(ends[live] - done - 1, 0)], none).astype(np.uint8)
            total += np.bincount(coming, minlength=none + 1)
            place[finished] += np.searchsorted(at - np.arange(len(at)), place[finished], "right")
            place[live] = at
            transform, prefixes = _inserted(at, (transform, coming), (prefixes, shared[0]))
            # the suffix after a new one now has it before itself
            inside = at + 1 < len(prefixes)
            prefixes[at[inside] + 1] = shared[1, inside]
            files.write(transform, prefixes)
        transform, prefixes = files.read()
        transform = np.append(alphabet, END).astype(np.uint8)[transform]
    finally:
        files.close()
        shutil.rmtree(own, ignore_errors=True)
    return transform, prefixes, place


def repeated_starts(strings: list[bytes], starts: np.ndarray, length: int, folder: str | None = None) -> list[np.ndarray]:
    """For each string, which of its first ``starts`` suffixes begin with ``length`` bytes that another suffix begins with too."""
    transform, prefixes, place = build(strings, length, folder)
    n = len(strings)
    hit = np.zeros(len(transform), bool)
    far = prefixes >= length
    hit |= far
    hit[:-1] |= far[1:]
    # from each whole string's place down its suffixes: the suffix without the first symbol stands where that symbol came from
    order = _by_symbol(transform)
    order = order[: len(order) - int(np.count_nonzero(transform == END))]
    out = np.zeros((n, int(starts.max(initial=0))), bool)
    at = place.copy()
    for k in range(out.shape[1]):
        live = np.flatnonzero(starts > k)
        out[live, k] = hit[at[live]]
        at[live] = order[at[live] - n]
    return [out[i, :s] for i, s in enumerate(starts.tolist())]
