"""Random forests on binned rows, for many folds and settings together.

The method is MLlib's: every tree draws its rows with replacement (a Poisson count of mean 1 a row, here by a hash of the
row's key and its place among the rows of that key) and every node the features that it may be cut by; a cut is the best
one by Gini impurity or variance among up to ``FOREST_BINS`` ranges of a feature in the fitted rows; sibling leaves of one
label are joined; a row's result is the mean of its leaves.  For two classes both impurities are the same function of the
sums of labels and weights, so trees are grown by the kernel of :mod:`boosting`.

Trees don't depend on each other: up to ``boosting.LOCAL_BYTES`` the binned rows are broadcast and a task fits some trees
of one setting and fold and sums their results on the rows left out, so a forest takes one stage whatever its depth.
Larger rows and deeper trees than ``MOST_DEPTH``, whose nodes would not stay in a task's memory, are left to MLlib.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import boosting as B
from ..session import ensure_checkpoint_dir

FOREST_BINS = 32
MOST_DEPTH = 10
JOB_TREES = 25             # trees of one task
MOST_DRAWS = 12            # a row is drawn more often with a chance of 1e-10


@dataclass(frozen=True)
class Forest:
    """Settings of one forest; ``share``: the features of a node; ``classes``: labels are classes 0 and 1."""

    trees: int
    depth: int
    least: int = 1
    share: str = "all"
    classes: bool = False
    seed: int = 42

    def features(self, d: int) -> int:
        if self.share in ("all", "sqrt"):
            return d if self.share == "all" else math.ceil(math.sqrt(d))
        return math.ceil(float(self.share) * d)


def draws(key: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """How often each row is in a tree's sample: Poisson counts of mean 1."""
    out = np.empty(len(key), np.int8)
    chance = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(MOST_DRAWS)])
    for s in range(0, len(key), B.SUM_ROWS):
        u = B.uniform(key[s:s + B.SUM_ROWS], seed, tree)
        out[s:s + B.SUM_ROWS] = sum((u >= c for c in chance), np.zeros(len(u), np.int8))
    return out


def apart(key: np.ndarray) -> np.ndarray:
    """Hashes that differ for rows of one key too (``key`` is in order): a table may repeat a key or leave it null."""
    first = np.flatnonzero(np.diff(key, prepend=key[:1] - 1)) if len(key) else np.zeros(0, np.int64)
    again = np.arange(len(key)) - np.repeat(first, np.diff(first, append=len(key)))
    with np.errstate(over="ignore"):
        return key.astype(np.uint64) + np.uint64(0xD1342543DE82EF95) * again.astype(np.uint64)


def coarse(bins: np.ndarray, cuts: Sequence[int]) -> list[np.ndarray]:
    """Last fine bin of each coarse one but the last, a feature: all ``cuts`` of it, or up to ``FOREST_BINS`` - 1 at even counts of rows."""
    most, out = FOREST_BINS - 1, []
    for f, n in enumerate(cuts):
        if n <= most:
            out.append(np.arange(n))
            continue
        count = np.bincount(bins[:, f], minlength=n + 1)
        held, stride, taken = int(count[0]), len(bins) / FOREST_BINS, []
        target = stride
        for k in range(1, n + 1):
            before, held = held, held + int(count[k])
            if abs(before - target) < abs(held - target):
                taken.append(k - 1)
                target += stride
        out.append(np.array(taken, int))
    return out


def _class_weights(y: np.ndarray, w: np.ndarray) -> tuple[float, float] | None:
    """(weight of label 0, of label 1) where labels are 0 and 1 and the weight follows from the label."""
    if not np.isin(y, (0.0, 1.0)).all():
        return None
    each = [np.unique(w[y == k]) for k in (0.0, 1.0)]
    return None if max(map(len, each)) > 1 else tuple(float(v[0]) if len(v) else 1.0 for v in each)


def fit_trees(data: B.Packed, last: list[np.ndarray], y, w, key, spec: Forest, trees: Sequence[int]):
    """Trees over coarse columns, with the cuts of fine bins."""
    grown = B.Boost("squared", 1, 1.0, spec.depth, 0.0, spec.least, None, 1.0, spec.seed)
    d, classes = len(data.bins), (1.0, 1.0) if (w == 1).all() else _class_weights(y, w)
    m = spec.features(d)
    for t in trees:
        k = draws(key, spec.seed, t)
        rng = np.random.default_rng((spec.seed, t))

        def allowed(nodes, level):
            if m >= d:
                return None
            out = np.zeros((nodes, d), bool)
            np.put_along_axis(out, np.argsort(rng.random((nodes, d)), 1)[:, :m], True, 1)
            return out
        if classes is None:
            tree = _weighted(grown, data, k, y, w, allowed)
        else:
            low, high = classes

            def read(sums):     # weights are exact products of whole numbers of draws
                gy, n = sums
                return (high * gy, n if low == high == 1 else high * gy + low * (n - gy), n)
            tree, _ = B._grow_packed(grown, data, B._pairs(k * y, k), k > 0, False, read, allowed)
        if spec.classes:
            _prune(tree)
        tree.cut = [int(last[f][c]) if f >= 0 else 0 for f, c in zip(tree.feature, tree.cut)]
        yield tree


def _prune(tree: B.Tree) -> None:
    """As MLlib does: sibling leaves of one label become one leaf."""
    for at in reversed(range(len(tree.feature))):
        if tree.feature[at] >= 0:
            low, high = tree.low[at], tree.high[at]
            if tree.feature[low] < 0 and tree.feature[high] < 0 and (tree.value[low] > 0.5) == (tree.value[high] > 0.5):
                tree.feature[at] = -1


def _weighted(grown: B.Boost, data: B.Packed, k, y, w, allowed) -> B.Tree:
    """A tree over rows of any weight: draws are summed beside weights and labels."""
    class Both:
        def __getattr__(self, name):
            return getattr(data, name)

        def of_pairs(self, parts, v, counted):
            return np.concatenate([data.of_pairs(parts, v, False), data.of_pairs(parts, B._pairs(k), False)[:1]])
    return B._grow_packed(grown, Both(), B._pairs(k * w * y, k * w), k > 0, False, None, allowed)[0]


def cross_validate(rows: B.Rows, specs: dict[str, Forest], folds: Sequence[int], label: str) -> DataFrame:
    """(model, fold, label, p) of every row by the forest that left its fold out, for every setting (written table)."""
    spark, shared = rows.df.sparkSession, rows.shared()
    cuts = [len(e) for e in rows.edges]
    jobs = [(tag, s, f, range(t, min(t + JOB_TREES, s.trees))) for tag, s in specs.items() for f in folds for t in range(0, s.trees, JOB_TREES)]
    jobs.sort(key=lambda j: -len(j[3]) * j[1].depth)

    def run(batches):
        for b in batches:
            for i in b.column("id").to_pylist():
                tag, spec, leave, trees = jobs[i]
                bins, y, w, fold, key = shared.value
                own = fold != leave
                if not own.any():
                    raise ValueError(f"no rows outside fold {leave}")
                cols = bins[own]
                last = coarse(cols, cuts)
                for f, v in enumerate(last):
                    cols[:, f] = np.searchsorted(v, np.arange(B.BINS + 1), side="left").astype(np.uint8)[cols[:, f]]
                out, total = B.Packed(bins[~own]) if not own.all() else None, np.zeros(int((~own).sum()))
                for tree in fit_trees(B.Packed(cols), last, y[own], w[own], apart(key)[own], spec, trees):
                    for leaf, at in out.leaves(tree) if out else ():
                        total[at] += tree.value[leaf] / spec.trees
                yield pa.RecordBatch.from_arrays([pa.array([tag]), pa.array([leave], pa.int32()), pa.array([trees.start], pa.int32()),
                                                  pa.array([total.tobytes()], pa.binary())], names=["model", "fold", "first", "total"])

    def added(t: pa.Table) -> pa.Table:
        t = t.sort_by("first")          # results are added in the trees' order
        tag, leave = t.column("model")[0].as_py(), t.column("fold")[0].as_py()
        _, y, _, fold, _ = shared.value
        y = y[fold == leave]
        p = sum((np.frombuffer(x) for x in t.column("total").to_pylist()), np.zeros(len(y)))
        return pa.table({"model": pa.array([tag] * len(y), pa.string()), "fold": pa.array(np.full(len(y), leave, np.int32)), label: y, "p": p})
    parts = spark.range(0, len(jobs), 1, len(jobs)).mapInArrow(run, "model string, fold int, first int, total binary")
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/custaris-oof-{uuid.uuid4().hex[:12]}"
    parts.groupBy("model", "fold").applyInArrow(added, f"model string, fold int, `{label}` double, p double").write.parquet(path)
    return spark.read.parquet(path)
