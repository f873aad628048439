import os

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from custaris.llm import suffixes


def check(rows, shallow):
    m = np.array([list(r) for r in rows], np.uint8).reshape(len(rows), -1)
    order, lcp = suffixes.deep_shallow(m, shallow)
    got = [rows[i] for i in order]
    assert got == sorted(rows) and sorted(order) == list(range(len(rows)))
    for k in range(1, len(rows)):
        assert lcp[k] == len(os.path.commonprefix([got[k - 1], got[k]]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.binary(min_size=20, max_size=20).map(lambda b: bytes(c % 3 for c in b)), min_size=1, max_size=30), st.sampled_from([0, 8, 16, 24]))
def test_random(rows, shallow):
    check(rows, shallow)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 39), st.integers(0, 2)), min_size=1, max_size=40), st.sampled_from([0, 8, 40]))
def test_long_common_prefixes(edits, shallow):
    rows = []
    for p, c in edits:
        r = bytearray(40)
        r[p] = c
        rows.append(bytes(r))
    check(rows, shallow)
