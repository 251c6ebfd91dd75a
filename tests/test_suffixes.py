"""Suffix order, common prefixes and longest previous factors against brute force."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandline.functions.suffixes import common_prefixes, previous_factors, suffix_array


def keys(seq):
    """Zeros below all else, each one different."""
    return [[(0, i) if v == 0 else (1, v) for i, v in enumerate(seq)][k:] for k in range(len(seq))]


def prefix(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60), st.sampled_from([1, 300, 1 << 30]), st.randoms())
def test_arrays(values, scale, rnd):
    seq = np.array([*[v * scale if v else 0 for v in values], 0], np.int64)
    k = keys(seq.tolist())
    ranks = []
    sa = suffix_array(seq, ranks)
    assert sa.tolist() == sorted(range(len(seq)), key=lambda i: k[i])
    lcp = common_prefixes(seq, sa, ranks)
    assert lcp.tolist() == [0, *[prefix(k[a], k[b]) for a, b in zip(sa[:-1], sa[1:], strict=True)]]
    place = np.array(rnd.sample(range(len(seq)), len(seq)))
    want = [max([0, *[prefix(k[i], k[j]) for j in range(len(seq)) if place[j] < place[i]]]) for i in range(len(seq))]
    assert previous_factors(sa, lcp, place).tolist() == want
    least = common_prefixes(seq, sa, ranks, 3)
    assert previous_factors(sa, least, place, 3).tolist() == [w if w >= 3 else 0 for w in want]


@pytest.mark.parametrize("seq", [[0], [5], [0, 0, 0], [7] * 500 + [0], [1, 2] * 300 + [0, 1, 2, 0]])
def test_odd(seq):
    s = np.array(seq, np.int64)
    ranks = []
    sa = suffix_array(s, ranks)
    lcp = common_prefixes(s, sa, ranks)
    if seq == [7] * 500 + [0]:
        assert previous_factors(sa, lcp, np.arange(len(s))).tolist() == [0, *range(499, 0, -1), 0]
    assert sorted(sa.tolist()) == list(range(len(s)))
