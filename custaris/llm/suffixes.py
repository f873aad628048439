"""Suffix sorting by deep-shallow sorting (numpy): multikey quicksort to a shallow depth, blind tries below it.

The strings are rows of a byte matrix (fixed width, padded).  The shallow part sorts by eight bytes at a time, all open
groups of equal prefixes at once; groups that are still tied at ``SHALLOW`` bytes have a long common prefix, and a blind
trie orders each of them: inner nodes keep only the depth of a branch and its bytes, so an insertion compares one
string in full, whatever the length of the prefix.
"""

from __future__ import annotations

import numpy as np

SHALLOW = 96


class BlindTrie:
    """Compact trie over strings of one length; leaves hold lists of equal strings' numbers."""

    def __init__(self, strings: list[bytes]):
        self.s = strings
        self.root = None            # node: [depth, {byte: child}] or leaf: [number, ...] as ("leaf", [numbers])

    def insert(self, i: int) -> None:
        s = self.s[i]
        if self.root is None:
            self.root = ("leaf", [i])
            return
        path, node = [], self.root   # blind descent: follow the branching bytes only
        while node[0] != "leaf":
            path.append(node)
            nxt = node[1].get(s[node[0]])
            node = nxt if nxt is not None else next(iter(node[1].values()))
        other = self.s[node[1][0]]
        if other == s:
            node[1].append(i)
            return
        d = common_prefix(s, other)
        parent = child = None        # the place on the path where depth d lies
        for p in path:
            if p[0] >= d:
                child = p
                break
            parent = p
        if child is not None and child[0] == d:
            child[1][s[d]] = ("leaf", [i])
            return
        if child is None:
            child = node if parent is None or s[parent[0]] in parent[1] else None
        if parent is not None and child is not None:
            child = parent[1][other[parent[0]]]
        new = (d, {other[d]: child if child is not None else node, s[d]: ("leaf", [i])})
        if parent is None:
            self.root = (d, {other[d]: self.root, s[d]: ("leaf", [i])})
        else:
            parent[1][s[parent[0]]] = new

    def walk(self) -> tuple[list[int], list[int]]:
        """Numbers in sorted order, and the common prefix of each with the one before (the first has -1)."""
        order, lcp, stack = [], [], [(self.root, -1)]
        while stack:
            node, above = stack.pop()
            if node[0] == "leaf":
                order += node[1]
                lcp += [above] + [len(self.s[node[1][0]])] * (len(node[1]) - 1)
            else:
                keys = sorted(node[1], reverse=True)
                for k in keys:
                    stack.append((node[1][k], above if k == keys[-1] else node[0]))
        return order, lcp


def common_prefix(a: bytes, b: bytes) -> int:
    """Length of the common prefix of two different strings."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def deep_shallow(m: np.ndarray, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp) of the rows of byte matrix ``m``; lcp[k] is the common prefix of rows order[k-1] and order[k]."""
    n, width = m.shape
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    pad = -width % 8
    keys = np.ascontiguousarray(np.pad(m, ((0, 0), (0, pad)))).view(">u8")
    order, lcp = np.arange(n), np.zeros(n, np.int64)
    group = np.zeros(n, np.int64)            # by place in order: number of the group of equal prefixes
    open_ = np.arange(n)                      # places whose group has more than one row
    for d in range(0, min(shallow, width + pad), 8):
        if not len(open_):
            break
        k = keys[order[open_], d // 8]
        g = group[open_]
        by = np.lexsort((k, g))
        order[open_] = order[open_][by]
        k, g = k[by], g[by]
        new = np.append(True, (k[1:] != k[:-1]) | (g[1:] != g[:-1]))
        split = np.append(False, (k[1:] != k[:-1]) & (g[1:] == g[:-1]))
        at = np.flatnonzero(split)
        x = (k[at] ^ k[at - 1]).astype(np.uint64)
        lcp[open_[at]] = d + _zero_bytes(x)
        label = np.cumsum(new) - 1
        group[open_] = label
        size = np.bincount(label)
        open_ = open_[size[label] > 1]
    if len(open_):
        g = group[open_]
        start = np.append(np.flatnonzero(np.append(True, g[1:] != g[:-1])), len(g))
        for a, b in zip(start[:-1], start[1:]):
            place = open_[a:b]
            rows = order[place]
            trie = BlindTrie([r.tobytes() for r in m[rows]])
            for i in range(len(rows)):
                trie.insert(i)
            got, lc = trie.walk()
            order[place] = rows[got]
            lcp[place[1:]] = lc[1:]
    return order, np.minimum(lcp, width)


def _zero_bytes(x: np.ndarray) -> np.ndarray:
    """Leading zero bytes of big-endian 64-bit numbers."""
    out = np.zeros(len(x), np.int64)
    for k in range(1, 8):
        out += x < np.uint64(1 << (64 - 8 * k))
    return out
