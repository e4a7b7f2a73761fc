import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weft.llm.bcr import END, _by_symbol, _nth, build, repeated_starts


def brute(strings):
    """Transform and common prefixes by sorting all suffixes, the empty ones first and equal ones by their strings."""
    suffixes = sorted(((tuple(s[i:]), k, i) for k, s in enumerate(strings) for i in range(len(s) + 1)), key=lambda z: [*((c, 0) for c in z[0]), (-1, z[1])])
    transform = [strings[k][i - 1] if i else END for _, k, i in suffixes]
    common = [0]
    for (a, _, _), (b, _, _) in zip(suffixes, suffixes[1:]):
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        common.append(n)
    return transform, common


@settings(max_examples=150, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=12).map(lambda b: bytes(x % 3 + 97 for x in b)), min_size=1, max_size=8))
def test_construction(strings):
    transform, common, place = build(strings, 200)
    want = brute(strings)
    assert (transform.tolist(), common.tolist()) == want


def test_repeated_starts():
    r = random.Random(4)
    for _ in range(120):
        length = r.randint(1, 5)
        strings = [bytes(r.choice(b"ab\x00\xfe") for _ in range(r.randint(length, 18))) for _ in range(r.randint(1, 7))]
        starts = np.array([r.randint(1, len(s) - length + 1) for s in strings])
        seen = Counter(s[i : i + length] for s in strings for i in range(len(s) - length + 1))
        want = [[seen[s[i : i + length]] > 1 for i in range(n)] for s, n in zip(strings, starts.tolist())]
        assert [x.tolist() for x in repeated_starts(strings, starts, length)] == want


def test_many_equal_strings_span_blocks():
    strings = [b"abcab" * 20] * 40 + [b"x" + b"abcab" * 20]
    assert all(x.all() for x in repeated_starts(strings, np.array([50] * 40 + [2]), 50)[:40])


def test_cap():
    with pytest.raises(ValueError):
        build([b"a"], 256)


def test_places_by_symbol_and_how_often_a_symbol_stands_before():
    r = np.random.default_rng(3)
    for n, symbols in ((1, 1), (7, 3), (5000, 40), (5000, 256)):
        column = r.integers(0, symbols, n).astype(np.uint8)
        order = _by_symbol(column)
        assert order.tolist() == np.argsort(column, kind="stable").tolist()
        below = np.concatenate([[0], np.cumsum(np.bincount(column, minlength=symbols))])
        at = np.sort(r.choice(n, -(-n // 2), replace=False))
        at = at[np.argsort(column[at], kind="stable")]
        assert _nth(order, below, column[at], at).tolist() == [int((column[:p] == column[p]).sum()) for p in at.tolist()]
