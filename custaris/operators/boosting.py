"""Gradient-boosted trees on binned features, for many folds and settings together.

Features are cut into at most ``BINS`` ranges at approximate quantiles of the given rows, and rows are kept as one byte a
feature.  A tree grows level by level: for every node, feature and bin the gradients, Hessians and rows are summed, and the
best cut is taken from these sums; the sums of the two sides give the leaf values, shrunk by ``l2``, so a tree of depth d
takes d sums.  Shorter runs of a setting are prefixes of the longest one and cost nothing.

Two ways to run the same kernel, chosen by the size of the binned rows alone, with equal trees (the tests compare them):

* up to ``LOCAL_BYTES`` the binned rows are broadcast (that is the checked bound) and every task fits whole models, one for
  each setting and fold, so that a search runs on all cores without a job a level;
* beyond it the rows stay distributed: a level of all trees of a group of models is one aggregation keyed by (model, node,
  feature, bin), and the rows' margins are written every ``REFRESH`` rounds, which bounds what a pass derives anew.

Losses: ``logistic`` (0/1 label, row weights) and ``squared``.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

BINS = 255
LOCAL_BYTES = 64 << 20     # binned rows up to here are broadcast
REFRESH = 16               # rounds after which distributed margins are written
GROUP_CELLS = 4 << 20      # sums of one distributed level that reach the driver at most
BLOCK_ROWS = 16384
CODES = 1024               # values of a joint code of narrow features
MANY_ROWS = 4096           # rows from which a model in memory is fitted by columns
SUM_PARTS = 128            # nodes summed at once
CUT_CELLS = 16_384         # cells of nodes cut at once: they stay in a core's cache
SUM_ROWS = 16_384          # rows summed at once: their codes and values stay in a core's cache


@dataclass(frozen=True)
class Boost:
    """Settings of one model; ``least``: rows of a leaf, ``leaves``: leaves of a tree (None: as many as the depth gives)."""

    loss: str = "logistic"
    rounds: int = 100
    rate: float = 0.1
    depth: int = 3
    l2: float = 0.0
    least: int = 20
    leaves: int | None = 31
    subsample: float = 1.0
    seed: int = 42


class Tree:
    """Nodes as lists: feature (-1: leaf), cut (bin), the two children, value, gain."""

    def __init__(self):
        self.feature, self.cut, self.low, self.high, self.value, self.gain = [], [], [], [], [], []

    def leaf(self, value: float) -> int:
        for col, v in zip((self.feature, self.cut, self.low, self.high, self.value, self.gain), (-1, 0, 0, 0, value, 0.0)):
            col.append(v)
        return len(self.feature) - 1

    def route(self, bins: np.ndarray) -> np.ndarray:
        """Leaf of each row."""
        feature, cut, low, high = (np.array(c) for c in (self.feature, self.cut, self.low, self.high))
        at, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        while True:
            f = feature[at]
            if (f < 0).all():
                return at
            at = np.where(f < 0, at, np.where(bins[rows, f] > cut[at], high[at], low[at]))


class Grower:
    """One tree as it grows: ``open`` are the nodes of the last level that may still be cut."""

    def __init__(self, spec: Boost):
        self.spec, self.tree = spec, Tree()
        self.tree.leaf(0.0)
        self.open, self.level, self.count = [0], 0, 1

    @property
    def done(self) -> bool:
        """No cut is left; a tree with all its leaves needs no sums to know it."""
        full = self.level and self.spec.leaves is not None and self.count >= self.spec.leaves
        return self.level >= self.spec.depth or not self.open or bool(full)

    def cut(self, cells: np.ndarray, g: np.ndarray, h: np.ndarray, c: np.ndarray, n_features: int) -> None:
        """Cut the open nodes by the sums of the cells that hold rows, in the order (node, feature, bin)."""
        s = self.spec
        column = cells // (BINS + 1)                      # node * n_features + feature
        first = np.flatnonzero(np.diff(column, prepend=-1))
        span = np.diff(first, append=len(cells))

        def sides(v):
            """Sums of the cells up to each one within its column, and of the whole column."""
            run = np.cumsum(v)
            before = np.repeat(run[first] - v[first], span)
            return run - before, np.repeat(run[first + span - 1], span) - before
        (gl, gt), (hl, ht), (cl, ct) = sides(g), sides(h), sides(c)
        ok = (cl >= s.least) & (ct - cl >= s.least)

        def part(x, y):
            return x * x / np.maximum(y + s.l2, 1e-12)
        gain = np.where(ok, part(gl, hl) + part(gt - gl, ht - hl) - part(gt, ht), -np.inf)
        node = column // n_features
        start = np.flatnonzero(np.diff(node, prepend=-1))
        there = node[start]                               # open nodes that hold rows
        most = np.maximum.reduceat(gain, start)
        # equal gains of several features: the first one, whatever the order of the sums
        near = np.flatnonzero(gain >= np.repeat(most - 1e-9 * np.abs(np.where(np.isfinite(most), most, 0)), np.diff(start, append=len(cells))))
        best = near[np.searchsorted(near, start)]
        self._take(there, most, column[best] % n_features, cells[best] % (BINS + 1), gl[best], hl[best], gt[best], ht[best])

    def cut_dense(self, there: Sequence[int], g: np.ndarray, h: np.ndarray, c: np.ndarray, data: Packed, allowed: np.ndarray | None = None) -> None:
        """:meth:`cut` by the (node, cell) sums of all cells of the open nodes ``there``: a cell without rows repeats the cut
        before it, which comes first.  ``allowed``: (open node, feature) marks of the features that it may be cut by."""
        s, n = self.spec, len(there)
        most, best, sides = np.empty(n), np.empty(n, np.int64), np.empty((4, n))
        step = max(1, CUT_CELLS // len(data.cell))
        for a in range(0, n, step):
            here = slice(a, a + step)
            (gl, gt), (hl, ht) = data.running(g[here]), data.running(h[here])
            cl, ct = (hl, ht) if c is h else data.running(c[here])
            out = (cl < s.least) | (cl > (ct - s.least)[:, None])
            if allowed is not None:
                out |= ~allowed[np.array(there[here])][:, data.feature]
            gain, under = gt[:, None] - gl, ht[:, None] - hl
            gain *= gain
            under += s.l2
            gain /= np.maximum(under, 1e-12, out=under)
            np.add(hl, s.l2, out=under)
            low = gl * gl
            low /= np.maximum(under, 1e-12, out=under)
            gain += low
            gain -= (gt * gt / np.maximum(ht + s.l2, 1e-12))[:, None]
            np.copyto(gain, -np.inf, where=out)
            most[here] = top = gain.max(1)
            # equal gains of several features: the first one, whatever the order of the sums
            best[here] = at = (gain >= (top - 1e-9 * np.abs(np.where(np.isfinite(top), top, 0)))[:, None]).argmax(1)
            row = np.arange(len(at))
            sides[:, here] = gl[row, at], hl[row, at], gt, ht
        cell = data.cell[best]
        self._take(there, most, cell // (BINS + 1), cell % (BINS + 1), *sides)

    def _take(self, there, most, feature, cut, gl, hl, gt, ht) -> None:
        """Cut the open nodes ``there`` by their best cuts, while leaves are left."""
        s, t = self.spec, self.tree
        if self.level == 0:
            t.value[0] = self._value(gt[0], ht[0])
        taken = [k for k in np.argsort(-most, kind="stable").tolist() if most[k] > 1e-10]
        if s.leaves is not None:
            taken = taken[:max(0, s.leaves - self.count)]
        new = []
        for k in sorted(taken):
            at = self.open[int(there[k])]
            t.feature[at], t.cut[at], t.gain[at] = int(feature[k]), int(cut[k]), float(most[k])
            t.low[at] = t.leaf(self._value(gl[k], hl[k]))
            t.high[at] = t.leaf(self._value(gt[k] - gl[k], ht[k] - hl[k]))
            new += [t.low[at], t.high[at]]
            self.count += 1
        self.open = new
        self.level += 1

    def _value(self, g: float, h: float) -> float:
        return self.spec.rate * float(g) / max(float(h) + self.spec.l2, 1e-12)


@dataclass
class BoostedTrees:
    """A fitted model: start value, trees and the cut points of the features."""

    loss: str
    start: float
    trees: list[Tree]
    edges: list[list[float]]
    features: str = "features"

    def margins(self, x: np.ndarray) -> np.ndarray:
        bins = _bins(x, self.edges)
        out = np.full(len(x), self.start)
        for t in self.trees:
            out += np.array(t.value)[t.route(bins)]
        return out

    def score(self, df: DataFrame, out: str) -> DataFrame:
        @F.arrow_udf("double")
        def margin(x: pa.Array) -> pa.Array:
            m = self.margins(x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)) if len(x) else np.zeros(0)
            return pa.array(_probability(m) if self.loss == "logistic" else m)
        return df.withColumn(out, margin(vector_to_array(F.col(self.features))))

    def importances(self) -> list[float]:
        """Share of the gain of all cuts by feature."""
        total = np.zeros(len(self.edges))
        for t in self.trees:
            for f, gain in zip(t.feature, t.gain):
                if f >= 0:
                    total[f] += gain
        return (total / total.sum() if total.sum() else total).tolist()

    def to_dict(self) -> dict:
        return {"type": "boosted", "loss": self.loss, "start": self.start, "edges": self.edges, "features": self.features,
                "trees": [vars(t) for t in self.trees]}

    @classmethod
    def from_dict(cls, d: dict) -> BoostedTrees:
        trees = []
        for cols in d["trees"]:
            t = Tree()
            vars(t).update(cols)
            trees.append(t)
        return cls(d["loss"], d["start"], trees, d["edges"], d["features"])


def _probability(m: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(m / 2))


def _bins(x: np.ndarray, edges: Sequence[Sequence[float]]) -> np.ndarray:
    """Bin of each value: the number of cut points below it (a missing one stands after all)."""
    out = np.empty(x.shape, np.uint8)
    for j, e in enumerate(edges):
        out[:, j] = np.searchsorted(np.asarray(e), x[:, j], side="left")
    return out


def uniform(row: np.ndarray, seed: int, at: int) -> np.ndarray:
    """A number from 0 to 1 for each key hash, seed and round."""
    with np.errstate(over="ignore"):
        z = row.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * np.uint64(seed * 1_000_003 + at + 1)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    return (z >> np.uint64(11)).astype(np.float64) / (1 << 53)


def _chosen(row: np.ndarray, spec: Boost, at: int) -> np.ndarray:
    """Whether a row is in round ``at``'s subsample, by a hash of its key."""
    out = np.empty(len(row), bool)
    for s in range(0, len(row), SUM_ROWS):
        out[s:s + SUM_ROWS] = uniform(row[s:s + SUM_ROWS], spec.seed, at) < spec.subsample
    return out


def _slopes(spec: Boost, y, w, margin) -> tuple[np.ndarray, np.ndarray]:
    if spec.loss == "squared":
        return w * (y - margin), w
    p = _probability(margin)
    return w * (y - p), w * p * (1 - p)


def _start(loss: str, w: float, wy: float) -> float:
    mean = wy / w
    if loss == "squared":
        return mean
    mean = min(max(mean, 1e-9), 1 - 1e-9)
    return float(np.log(mean / (1 - mean)))


def _sums(cell: np.ndarray, at: np.ndarray, nodes: int, n_features: int, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """(cells that hold rows, sums of the values in them, rows in them); a cell is a (node, feature, bin).

    ``cell`` is feature * (BINS + 1) + bin of each row and feature.
    """
    width = n_features * (BINS + 1)
    flat = (at[:, None] * width + cell).ravel()
    rows = np.bincount(flat, minlength=nodes * width)
    some = np.flatnonzero(rows)
    return some, *(np.bincount(flat, np.repeat(v, n_features), nodes * width)[some] for v in values), rows[some].astype(float)


@dataclass
class Rows:
    """Binned rows: ``bins`` (binary), y, w, fold, row (a hash of the key), and the features' cut points."""

    df: DataFrame
    edges: list[list[float]]
    n: int
    features: str
    kept: object = None
    lock: object = field(default_factory=threading.Lock, repr=False)

    @property
    def is_small(self) -> bool:
        return self.n * (len(self.edges) + 28) <= LOCAL_BYTES

    def shared(self):
        """The rows in memory, ordered, as one broadcast for all their fits."""
        with self.lock:
            if self.kept is None:
                table = self.df.orderBy("row", "bins", "y", "w").toArrow().combine_chunks().to_batches()
                self.kept = self.df.sparkSession.sparkContext.broadcast(_columns(table[0]) if table else None)
            return self.kept


def bin_rows(df: DataFrame, features: str, label: str, key: str, weight: str | None = None, fold: str | None = "fold") -> Rows:
    """One pass for the cut points, one that writes the binned rows in the shared folder."""
    x = vector_to_array(F.col(features))
    first = df.select(x.alias("x")).first()
    if first is None:
        raise ValueError("no rows to fit")
    d = len(first["x"])
    probs = ", ".join(repr((i + 1) / BINS) for i in range(BINS - 1))
    got = df.select(x.alias("x")).selectExpr(*[f"percentile_approx(x[{j}], array({probs}), 10000) AS e{j}" for j in range(d)],
                                             "count(*) AS n").first()
    edges = [sorted({float(v) for v in got[f"e{j}"] or () if v == v}) for j in range(d)]
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = df.select(x.alias("x"), F.col(label).cast("double").alias("y"), w.alias("w"),
                     (F.col(fold).cast("int") if fold else F.lit(-1)).alias("fold"), F.xxhash64(key).alias("row"))

    def run(batches):
        for b in batches:
            m = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) if b.num_rows else np.zeros((0, d))
            bins = _bins(m, edges)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in bins], pa.binary()), *[b.column(c) for c in ("y", "w", "fold", "row")]],
                                             names=["bins", "y", "w", "fold", "row"])
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/custaris-binned-{uuid.uuid4().hex[:12]}"
    rows.mapInArrow(run, "bins binary, y double, w double, fold int, row long").write.parquet(path)
    return Rows(df.sparkSession.read.parquet(path), edges, int(got["n"]), features)


def _columns(b) -> tuple[np.ndarray, ...]:
    bins = np.frombuffer(b"".join(b.column("bins").to_pylist()), np.uint8).reshape(b.num_rows, -1)
    return bins, *(b.column(c).to_numpy(zero_copy_only=False) for c in ("y", "w", "fold", "row"))


class Packed:
    """Rows by columns for :func:`_fit_here`: bins a feature, and joint codes of narrow features that share one histogram.

    The sums of a feature are those of its joint code over the other features, so a level costs one pass a code.  Two values
    of a row are one complex number, so that a pass adds both.
    """

    def __init__(self, bins: np.ndarray):
        self.bins = np.ascontiguousarray(bins.T)
        wide = [int(c.max()) + 1 for c in self.bins]
        self.first = np.cumsum([0, *wide])         # a feature's cells among those of all features, as many as it has bins
        self.cell = np.concatenate([f * (BINS + 1) + np.arange(n) for f, n in enumerate(wide)])
        self.feature = self.cell // (BINS + 1)
        self.codes: list[tuple[np.ndarray, int, np.ndarray | tuple, np.ndarray]] = []   # joint code of each row, codes, (code, cell) marks or bins, cells
        self.counts: list[np.ndarray] | None = None     # all rows by joint code
        held: list[int] = []
        for f in sorted(range(len(wide)), key=lambda f: wide[f]):
            if held and int(np.prod([wide[x] for x in held])) * wide[f] > CODES:
                self._close(held, wide)
                held = []
            held.append(f)
        self._close(held, wide)
        self.by_row = np.empty((self.bins.shape[1], len(self.codes)), np.uint16)    # the same codes row by row, for some of the rows
        for j, (code, *_) in enumerate(self.codes):
            self.by_row[:, j] = code

    def _close(self, held: list[int], wide: list[int]) -> None:
        size = int(np.prod([wide[f] for f in held]))
        code = self.bins[held[0]].astype(np.uint8 if size <= 256 else np.uint16)
        for f in held[1:]:
            code = code * code.dtype.type(wide[f]) + self.bins[f]
        places = np.unravel_index(np.arange(size), [wide[f] for f in held]) if len(held) > 3 else ()
        # of many features one product splits the code's sums, of a few the sums over the others do
        marks = np.hstack([(p[:, None] == np.arange(wide[f])).astype(float) for f, p in zip(held, places)]) if len(held) > 3 else tuple(wide[f] for f in held)
        self.codes.append((code, size, marks, np.concatenate([np.arange(self.first[f], self.first[f + 1]) for f in held])))

    def cells(self, parts: list[np.ndarray], values: Sequence[np.ndarray]) -> np.ndarray:
        """(value, part, cell) sums of one or two ``values`` over the rows of each part; the last value: the rows themselves."""
        return self.of_pairs(parts, _pairs(*values), len(values) > 1)

    def of_pairs(self, parts: list[np.ndarray], v: np.ndarray, counted: bool) -> np.ndarray:
        """:meth:`cells` of pairs; not ``counted``: the second values are ones and count the rows."""
        n = len(parts)
        whole = n == 1 and len(parts[0]) == self.bins.shape[1]      # then the part's rows are all of them, in order
        pairs = [np.zeros(n * size, complex) for _, size, _, _ in self.codes]
        count = counted and not (whole and self.counts)
        counts = [np.zeros(n * size, np.int64) for _, size, _, _ in self.codes] if count else self.counts
        key, add, one = np.empty(SUM_ROWS, np.intp), np.empty(SUM_ROWS, np.intp), np.ones(SUM_ROWS, np.int64)
        for first, at, rows in self._runs(parts):
            value = v[rows.start:rows.stop] if whole else v.take(rows)
            block = None if whole else self.by_row.take(rows, axis=0)
            m = len(value)
            k = key[:m]
            for j, (code, size, _, _) in enumerate(self.codes):
                k[:] = code[rows.start:rows.stop] if whole else block[:, j]
                if at is not None:
                    k += np.multiply(at, size, out=add[:m])
                np.add.at(pairs[j][first * size:], k, value)
                if count:
                    np.add.at(counts[j][first * size:], k, one[:m])
        if whole and count:
            self.counts = counts
        out = np.empty((3 if counted else 2, n, len(self.cell)))
        for j, (_, size, marks, cells) in enumerate(self.codes):
            for k, joint in enumerate((pairs[j].real, pairs[j].imag, *((counts[j],) if counted else ()))):
                joint = joint.reshape(n, size)
                if not isinstance(marks, tuple):
                    out[k][:, cells] = joint.astype(float, order="C") @ marks
                    continue
                joint, at = joint.reshape(n, *marks), 0
                for f, wide in enumerate(marks):
                    others = tuple(x + 1 for x in range(len(marks)) if x != f)
                    out[k][:, cells[at]:cells[at] + wide] = joint.sum(others) if others else joint
                    at += wide
        return out

    def running(self, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums of the cells up to each one within its feature, and of all rows, for (node, cell) sums."""
        out, total = sums.copy(), sums[:, :self.first[1]].sum(1)
        out[:, self.first[1:-1]] -= total[:, None]
        return np.cumsum(out, 1, out=out), total

    def _runs(self, parts: list[np.ndarray]):
        """(first part, parts after it by row or None, rows) in runs of up to ``SUM_ROWS``; small parts share one."""
        if len(parts) == 1 and len(parts[0]) == self.bins.shape[1]:
            yield from ((0, None, range(s, min(s + SUM_ROWS, len(parts[0])))) for s in range(0, len(parts[0]), SUM_ROWS))
            return
        p = 0
        while p < len(parts):
            q, n = p + 1, len(parts[p])
            while q < len(parts) and n + len(parts[q]) <= MANY_ROWS:
                n, q = n + len(parts[q]), q + 1
            if q > p + 1:
                yield p, np.repeat(np.arange(q - p), [len(x) for x in parts[p:q]]), np.concatenate(parts[p:q])
            else:
                yield from ((p, None, parts[p][s:s + SUM_ROWS]) for s in range(0, n, SUM_ROWS))
            p = q

    def sums(self, parts: list[np.ndarray], values: Sequence[np.ndarray]) -> np.ndarray:
        """:meth:`cells` as (value, part, feature, bin)."""
        got = self.cells(parts, values)
        out = np.zeros((*got.shape[:2], len(self.bins) * (BINS + 1)))
        out[:, :, self.cell] = got
        return out.reshape(*got.shape[:2], len(self.bins), BINS + 1)

    def leaves(self, tree: Tree, at: int = 0, rows: np.ndarray | None = None):
        """(leaf, its rows) of every leaf."""
        rows = np.arange(self.bins.shape[1]) if rows is None else rows
        f = tree.feature[at]
        if f < 0:
            yield at, rows
            return
        high = self.bins[f].take(rows) > tree.cut[at]
        yield from self.leaves(tree, tree.low[at], rows.compress(~high))
        yield from self.leaves(tree, tree.high[at], rows.compress(high))


def _pairs(first: np.ndarray, second: np.ndarray | None = None) -> np.ndarray:
    """Two values of each row as one complex number; without a second one it counts the rows."""
    out = np.empty(len(first), complex)
    out.real, out.imag = first, 1 if second is None else second
    return out


def _grow_packed(spec: Boost, data: Packed, v: np.ndarray, use: np.ndarray | None, counted: bool, read=None, allowed=None):
    """One tree and (leaf, its rows); of two sibling nodes only the smaller one is summed, the other is the rest of its parent.

    ``v``: slopes and Hessians of the rows as pairs, ``counted`` or not (see :meth:`Packed.of_pairs`); ``read`` turns other
    sums into these and the rows; ``allowed``: the features of (nodes, level), see :meth:`Grower.cut_dense`."""
    grow = Grower(spec)
    tree, d = grow.tree, len(data.bins)
    rows_of = {0: np.arange(data.bins.shape[1]) if use is None else np.flatnonzero(use)}
    pairs: list[tuple[int, int, int]] = []
    while not grow.done:
        before = grow.open
        if grow.level == 0:
            if not len(rows_of[0]):
                break
            there, now = [0], data.of_pairs([rows_of[0]], v, counted)
        else:
            todo = []
            for j, (above, *two) in enumerate(pairs):
                n = [len(rows_of[at]) for at in two]
                if max(n) >= 2 * spec.least:      # else neither has a cut
                    todo.append((known[above], 2 * j, int(n[0] > n[1])))       # place above, of the first one, the smaller one
            if not todo:
                break
            there = [at + k for _, at, _ in todo for k in (0, 1)]
            last, now = now, np.empty((len(now), len(there), len(data.cell)))
            for first in range(0, len(todo), SUM_PARTS):
                some = todo[first:first + SUM_PARTS]
                got = data.of_pairs([rows_of[before[at + small]] for _, at, small in some], v, counted)
                for j, (above, _, small) in enumerate(some):
                    at = 2 * (first + j)
                    now[:, at + small] = got[:, j]
                    np.subtract(last[:, above], got[:, j], out=now[:, at + 1 - small])
        known = {before[at]: k for k, at in enumerate(there)}
        g, h, c = (now[0], now[1], now[-1]) if read is None else read(now)
        grow.cut_dense(there, g, h, h if len(now) == 2 and read is None else c, data, allowed and allowed(len(before), grow.level))
        pairs = [(at, tree.low[at], tree.high[at]) for at in before if tree.feature[at] >= 0]
        for at, low, high in pairs:
            rows = rows_of.pop(at)
            over = data.bins[tree.feature[at]].take(rows) > tree.cut[at]
            rows_of[low], rows_of[high] = rows.compress(~over), rows.compress(over)
    return tree, rows_of


def _fit_here(data, spec: Boost, leave: int | None, checks: Sequence[int] = ()):
    """Trees of one model over rows in memory, and the margins of the fold left out after the rounds of ``checks``."""
    bins, y, w, fold, row = data
    own = np.ones(len(y), bool) if leave is None else fold != leave
    b, ty, tw, trow = bins[own], y[own], w[own], row[own]
    if not len(ty):
        raise ValueError(f"no rows outside fold {leave}")
    n_features = bins.shape[1]
    start = _start(spec.loss, float(tw.sum()), float(tw @ ty))
    plain = spec.loss == "squared" and bool((tw == 1).all())
    if len(ty) >= MANY_ROWS:
        trees, seen = _fit_packed(Packed(b), Packed(bins[~own]) if not own.all() else None, ty, tw, trow, spec, start, plain, checks)
        return start, trees, seen, y[~own]
    cell = b.astype(np.int32) + np.arange(n_features, dtype=np.int32) * (BINS + 1)
    margin, out_margin, out_bins = np.full(len(ty), start), np.full(int((~own).sum()), start), bins[~own]
    trees, seen = [], {}
    for r in range(spec.rounds):
        g, h = _slopes(spec, ty, tw, margin)
        use = _chosen(trow, spec, r) if spec.subsample < 1 else np.ones(len(ty), bool)
        grow, at = Grower(spec), np.zeros(len(ty), np.int64)
        while not grow.done:
            place = np.full(len(grow.tree.feature), -1)
            place[grow.open] = np.arange(len(grow.open))
            here = np.flatnonzero((place[at] >= 0) & use)
            if not len(here):
                break
            # Hessians of the squared loss with equal weights are the rows themselves
            got = _sums(cell[here], place[at[here]], len(grow.open), n_features, *((g[here],) if plain else (g[here], h[here])))
            grow.cut(got[0], got[1], got[-2] if not plain else got[2], got[-1], n_features)
            f, c, lo, hi = (np.array(v) for v in (grow.tree.feature, grow.tree.cut, grow.tree.low, grow.tree.high))
            was = f[at]
            at = np.where(was < 0, at, np.where(b[np.arange(len(b)), was] > c[at], hi[at], lo[at]))
        trees.append(grow.tree)
        value = np.array(grow.tree.value)
        margin += value[at]
        if len(out_margin):
            out_margin += value[grow.tree.route(out_bins)]
        if r + 1 in checks:
            seen[r + 1] = out_margin.copy()
    return start, trees, seen, y[~own]


def _fit_packed(rows: Packed, out: Packed | None, y, w, key, spec: Boost, start: float, plain: bool, checks: Sequence[int]):
    """:func:`_fit_here` by columns: trees, and the margins of the rows ``out`` after the rounds of ``checks``."""
    margin, out_margin = np.full(len(y), start), np.full(out.bins.shape[1] if out else 0, start)
    trees, seen, v = [], {}, np.ones(len(y), complex)
    for r in range(spec.rounds):
        for s in range(0, len(y), SUM_ROWS):
            here = slice(s, s + SUM_ROWS)
            g, h = _slopes(spec, y[here], w[here], margin[here])
            v.real[here], v.imag[here] = g, 1 if plain else h
        use = _chosen(key, spec, r) if spec.subsample < 1 else None
        tree, rows_of = _grow_packed(spec, rows, v, use, not plain)
        trees.append(tree)
        for leaf, at in rows_of.items():
            margin[at] += tree.value[leaf]
        for leaf, at in rows.leaves(tree, 0, np.flatnonzero(~use)) if use is not None else ():
            margin[at] += tree.value[leaf]
        for leaf, at in out.leaves(tree) if out else ():
            out_margin[at] += tree.value[leaf]
        if r + 1 in checks:
            seen[r + 1] = out_margin.copy()
    return trees, seen


def fit(rows: Rows, spec: Boost, leave: int | None = None) -> BoostedTrees:
    """One model over all rows, or over those outside a fold."""
    if rows.is_small:
        ((start, trees),) = _fit_local(rows, [(spec, leave)])
    else:
        ((start, trees),) = _fit_distributed(rows, [(spec, leave)])[0]
    return BoostedTrees(spec.loss, start, trees, rows.edges, rows.features)


def _fit_local(rows: Rows, jobs):
    import pickle
    shared = rows.shared()

    def run(batches):
        for b in batches:
            for k in b.column("id").to_pylist():
                start, trees, _, _ = _fit_here(shared.value, *jobs[k])
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([pickle.dumps((start, trees))], pa.binary())], names=["id", "m"])
    got = rows.df.sparkSession.range(0, len(jobs), 1, len(jobs)).mapInArrow(run, "id long, m binary").collect()
    return [pickle.loads(bytes(r["m"])) for r in sorted(got, key=lambda r: r["id"])]


def cross_validate(rows: Rows, specs: dict[str, Boost], folds: Sequence[int], label: str = "Churn") -> DataFrame:
    """(model, fold, label, p) of every row by the model that left its fold out, for every setting (written table).

    Settings that differ in their rounds alone share one run.
    """
    runs: dict[Boost, dict[int, list[str]]] = {}
    for tag, s in specs.items():
        runs.setdefault(replace(s, rounds=0), {}).setdefault(s.rounds, []).append(tag)
    longest = [(replace(s, rounds=max(by)), by) for s, by in runs.items()]
    jobs = sorted(((s, by, f) for s, by in longest for f in folds), key=lambda j: -j[0].rounds * j[0].depth)
    schema = f"model string, fold int, `{label}` double, p double"
    spark = rows.df.sparkSession

    def rows_of(spec, by, f, r, y, margin):
        p = _probability(margin) if spec.loss == "logistic" else margin
        for tag in by[r]:
            yield pa.RecordBatch.from_arrays([pa.array([tag] * len(y), pa.string()), pa.array(np.full(len(y), f, np.int32)), pa.array(y), pa.array(p)],
                                             names=["model", "fold", label, "p"])
    if rows.is_small:
        shared = rows.shared()

        def run(batches):
            for b in batches:
                for k in b.column("id").to_pylist():
                    spec, by, f = jobs[k]
                    _, _, seen, y = _fit_here(shared.value, spec, f, list(by))
                    for r, margin in seen.items():
                        yield from rows_of(spec, by, f, r, y, margin)
        out = spark.range(0, len(jobs), 1, len(jobs)).mapInArrow(run, schema)
    else:
        fitted, scored = _fit_distributed(rows, [(s, f) for s, _, f in jobs])[0], jobs
        shared = spark.sparkContext.broadcast([(start, trees) for start, trees in fitted])

        def run(batches):
            for b in batches:
                for at in range(0, b.num_rows, BLOCK_ROWS):
                    bins, y, w, fold, _ = _columns(b.slice(at, BLOCK_ROWS))
                    for (spec, by, f), (start, trees) in zip(scored, shared.value):
                        here = fold == f
                        if here.any():
                            margin = np.full(int(here.sum()), start)
                            for r, t in enumerate(trees, 1):
                                margin += np.array(t.value)[t.route(bins[here])]
                                if r in by:
                                    yield from rows_of(spec, by, f, r, y[here], margin)
        out = rows.df.mapInArrow(run, schema)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/custaris-oof-{uuid.uuid4().hex[:12]}"
    out.write.parquet(path)
    return spark.read.parquet(path)


# -- rows that stay distributed ------------------------------------------------------------

def _fit_distributed(rows: Rows, jobs) -> tuple[list[tuple[float, list[Tree]]], int]:
    """(start, trees) of every job, and the number of aggregations; jobs in groups whose sums are bounded."""
    cells = [2 ** min(s.depth - 1, 12) * len(rows.edges) * (BINS + 1) * 3 for s, _ in jobs]
    out, passes, group, size = [], 0, [], 0
    for j, c in [*zip(jobs, cells), (None, 0)]:
        if group and (j is None or size + c > GROUP_CELLS):
            got, n = _fit_group(rows, group)
            out, passes, group, size = out + got, passes + n, [], 0
        if j is not None:
            group.append(j)
            size += c
    return out, passes


def _fit_group(rows: Rows, jobs):
    spark, n_features, width = rows.df.sparkSession, len(rows.edges), BINS + 1
    by_fold = {r["fold"]: (r["w"], r["wy"], r["n"]) for r in rows.df.groupBy("fold").agg(
        F.sum("w").alias("w"), F.sum(F.col("w") * F.col("y")).alias("wy"), F.count("*").alias("n")).collect()}
    starts = []
    for s, leave in jobs:
        w, wy, n = (sum(v[i] for f, v in by_fold.items() if leave is None or f != leave) for i in range(3))
        if not n:
            raise ValueError(f"no rows outside fold {leave}")
        starts.append(_start(s.loss, float(w), float(wy)))
    trees: list[list[Tree]] = [[] for _ in jobs]
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/custaris-margins-{uuid.uuid4().hex[:12]}"
    state = rows.df.withColumn("margins", F.array(*[F.lit(v) for v in starts]))
    written = passes = 0

    def margins_of(b, bins, recent):
        m = b.column("margins").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).copy()
        for k, new in enumerate(recent):
            for t in new:
                m[:, k] += np.array(t.value)[t.route(bins)]
        return m

    for r in range(max(s.rounds for s, _ in jobs)):
        growers = {k: Grower(s) for k, (s, _) in enumerate(jobs) if r < s.rounds}
        recent = [t[written:] for t in trees]
        while todo := {k: g for k, g in growers.items() if not g.done}:
            def run(batches, todo=todo, recent=recent, r=r):
                total: dict[int, np.ndarray] = {}
                for batch in batches:
                    for at in range(0, batch.num_rows, BLOCK_ROWS):
                        b = batch.slice(at, BLOCK_ROWS)
                        bins, y, w, fold, row = _columns(b)
                        margin = margins_of(b, bins, recent)
                        cell = bins.astype(np.int32) + np.arange(n_features, dtype=np.int32) * width
                        for k, grow in todo.items():
                            spec, leave = jobs[k]
                            place = np.full(len(grow.tree.feature), -1)
                            place[grow.open] = np.arange(len(grow.open))
                            node = place[grow.tree.route(bins)]
                            use = (node >= 0) & (True if leave is None else fold != leave)
                            if spec.subsample < 1:
                                use &= _chosen(row, spec, r)
                            here = np.flatnonzero(use)
                            if len(here):
                                g, h = _slopes(spec, y[here], w[here], margin[here, k])
                                some, *v = _sums(cell[here], node[here], len(grow.open), n_features, g, h)
                                if k not in total:
                                    total[k] = np.zeros((3, len(grow.open) * n_features * width))
                                total[k][:, some] += v
                for k, s in total.items():
                    some = np.flatnonzero(s[2])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), k, np.int32)), pa.array(some), *map(pa.array, s[:, some])],
                                                     names=["job", "cell", "g", "h", "c"])
            got = state.mapInArrow(run, "job int, cell long, g double, h double, c double").groupBy("job", "cell").agg(
                *[F.sum(v).alias(v) for v in "ghc"]).orderBy("job", "cell").toArrow()
            passes += 1
            job, *sums = (got.column(c).to_numpy() for c in ("job", "cell", "g", "h", "c"))
            for k, grow in todo.items():
                own = job == k
                if own.any():
                    grow.cut(*[v[own] for v in sums], n_features)
                else:
                    grow.open = []
        for k, grow in growers.items():
            trees[k].append(grow.tree)
        if (r + 1) % REFRESH == 0:
            recent = [t[written:] for t in trees]

            def refresh(batches, recent=recent):
                for b in batches:
                    bins = _columns(b)[0]
                    m = margins_of(b, bins, recent)
                    flat = pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * len(jobs), pa.int32()), pa.array(m.ravel()))
                    yield b.set_column(b.schema.get_field_index("margins"), "margins", flat)
            state.mapInArrow(refresh, state.schema).write.parquet(f"{base}-{r + 1}")
            state, written = spark.read.parquet(f"{base}-{r + 1}"), r + 1
    return [(s, t) for s, t in zip(starts, trees)], passes

