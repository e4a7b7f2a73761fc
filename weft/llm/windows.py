"""Dealing out equal substrings: pieces of text around content-defined anchors.

All strings of ``length`` bytes that are equal have to meet, without sending each of them anywhere. Every such window
holds ``length - k + 1`` substrings of ``k`` bytes; the smallest of their hashes is the window's key, so equal windows have equal keys, and
neighbouring windows mostly share theirs. A piece is a run of window starts with one key, cut after as many starts as an anchor can
be in; its bytes reach from its first start to the end of its last window. Each window of a text is in exactly one piece.
"""

from __future__ import annotations

import numpy as np

_ODD = np.uint64(0x9E3779B97F4A7C15)
_powers: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers_of(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64."""
    have = _powers.get((base, 0))
    if have is None or len(have[0]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        inverse = pow(base, -1, 1 << 64)
        have = tuple(np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, b, np.uint64))]) for b in (base, inverse))
        _powers[base, 0] = have
    return have[0][:n], have[1][:n]


class Rolling:
    """Hashes of any substrings of a buffer, from sums of byte values times powers."""

    def __init__(self, data: np.ndarray, base: int):
        self.up, down = _powers_of(base, len(data) + 1)
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * down[: len(data)])])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.up[start]

    def every(self, k: int) -> np.ndarray:
        """Of all substrings of k bytes, well spread."""
        n = len(self.sums) - k
        return _mixed((self.sums[k:] - self.sums[:n]) * self.up[:n])


def _extreme(values: np.ndarray, width: int, op) -> np.ndarray:
    """The least (or greatest) of every ``width`` neighbours."""
    step = 1
    while 2 * step <= width:
        values = op(values[:-step], values[step:])
        step *= 2
    return op(values[: len(values) - (width - step)], values[width - step :]) if width > step else values


def pieces(data: np.ndarray, bounds: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """Pieces of texts that stand one after another in ``data`` (text i from bounds[i] to bounds[i + 1]).

    Returns arrays over pieces: text, first window start within it, number of starts, key, hash of the piece's bytes, and the anchor:
    the place in the piece of the leftmost substring with the key's hash, the same one for all of the piece's windows.
    """
    width = length - k + 1
    if len(data) < length:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64, np.int64))
    rolled = Rolling(data, 0xD6E8FEB86659FD93)
    grams = rolled.every(k)
    key = _extreme(grams, width, np.minimum)  # of the window that starts there
    valid = np.zeros(len(key), bool)
    for a, n in zip(bounds[:-1].tolist(), np.diff(bounds).tolist(), strict=True):
        if n >= length:
            valid[a : a + n - length + 1] = True
    change = np.ones(len(key) + 1, bool)
    # a window whose first substring is its least one is the last with that anchor
    change[1:-1] = (key[1:] != key[:-1]) | (key[:-1] == grams[: len(key) - 1]) | (valid[1:] != valid[:-1])
    edges = np.flatnonzero(change)
    first, last = edges[:-1], edges[1:] - 1
    keep = valid[first]
    first, last = first[keep], last[keep]
    text = np.searchsorted(bounds, first, "right") - 1
    least = key[first]
    anchor = last.copy()
    todo = np.flatnonzero(grams[anchor] != least)
    if len(todo):
        # candidates: substrings that are the least of some window
        around = np.concatenate([np.zeros(width - 1, np.uint64), key, np.zeros(width - 1, np.uint64)])
        places = np.flatnonzero(grams == _extreme(around, width, np.maximum)[: len(grams)])
        at = np.searchsorted(places, anchor[todo])
        while len(todo):
            anchor[todo] = places[at]
            off = grams[anchor[todo]] != least[todo]
            todo, at = todo[off], at[off] + 1
    hashed = _mixed(rolled.of(first, last + length))
    return text, first - bounds[text], last - first + 1, least, hashed, anchor - first
