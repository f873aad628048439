"""K-Means for many starts and cluster counts together.

The centres of all (start, K) runs stand in one array.  A step is one pass over the rows, which are kept packed: every
task, one a core, measures its rows against the centres of one K in one matrix product and reduces them to sums, counts and
costs by (run, cluster).  What moves is the number of centres a core, never the number of rows.  Runs that have settled
leave the next step.

Starts are chosen by greedy k-means++: a row is drawn with a chance in proportion to its squared distance from the centres
so far, by an exponential race over hashes of the rows' keys (one least value an aggregation), ``CANDIDATES`` draws a step,
of which the one that lowers the cost most is taken.  A run of K clusters takes the first K centres of its start.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

CANDIDATES = 4
MAX_STEPS = 300
NEAR_ROWS = 1024           # rows measured against all centres at once: the distances stay in a core's cache
TASK_ROWS = 16_384         # rows that are work for a core in a step
TASK_BYTES = 4 << 20
SAME = 1e-12               # a move of this share of the rows' size is rounding: Spark doesn't fix the order of its sums


@dataclass(frozen=True)
class Centers:
    """Centres of one run and its cost (sum of squared distances)."""

    centers: tuple[tuple[float, ...], ...]
    cost: float
    features: str = "features"

    def clusterCenters(self) -> list[np.ndarray]:
        return [np.array(c) for c in self.centers]

    def transform(self, df: DataFrame, out: str = "Cluster") -> DataFrame:
        """Nearest centre of each row, the first one on a tie."""
        at = np.array(self.centers)

        @F.arrow_udf("int")
        def nearest(x: pa.Array) -> pa.Array:
            m = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1) if len(x) else np.zeros((0, at.shape[1]))
            return pa.array(_squares(m, at).argmin(1).astype(np.int32))
        return df.withColumn(out, nearest(vector_to_array(F.col(self.features))))

    def to_dict(self) -> dict:
        return {"type": "centers", "centers": self.centers, "cost": self.cost, "features": self.features}

    @classmethod
    def from_dict(cls, d: dict) -> Centers:
        return cls(tuple(tuple(c) for c in d["centers"]), d["cost"], d["features"])


def _squares(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centers.T + (centers * centers).sum(1), 0)


def _keys(b: pa.RecordBatch) -> np.ndarray:
    """Key hashes of the rows; a record is a row or, packed, a block of rows."""
    row = b.column("row")
    if pa.types.is_binary(row.type):
        return np.frombuffer(b"".join(row.to_pylist()), np.int64)
    return row.to_numpy(zero_copy_only=False)


def _matrix(b: pa.RecordBatch) -> np.ndarray:
    x = b.column("x")
    n = sum(b.column("n").to_pylist()) if "n" in b.schema.names else len(x)
    if not n:
        return np.zeros((0, 1))
    flat = np.frombuffer(b"".join(x.to_pylist())) if pa.types.is_binary(x.type) else x.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(n, -1)


def _blocks(rows: DataFrame) -> DataFrame:
    """The rows in packed blocks of ``NEAR_ROWS``, written in the shared folder: every step reads them, so they are turned
    from vectors once, and dealt in equal shares over all cores (fewer where there are few rows)."""
    first, n = rows.select("x").first(), rows.count()
    if first is None:
        raise ValueError("no rows to cluster")
    cores, parts = rows.sparkSession.sparkContext.defaultParallelism, math.ceil(n / TASK_ROWS)
    if parts > cores:
        parts = cores * math.ceil(n * len(first["x"]) * 8 / TASK_BYTES / cores)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, NEAR_ROWS):
                b = batch.slice(at, NEAR_ROWS)
                yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(v).tobytes()], pa.binary()) for v in (_matrix(b), _keys(b))]
                                                 + [pa.array([b.num_rows])], names=["x", "row", "n"])
    path = f"{ensure_checkpoint_dir(rows.sparkSession).rstrip('/')}/custaris-blocks-{uuid.uuid4().hex[:12]}"
    rows.mapInArrow(run, "x binary, row binary, n long").repartition(parts).write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def summed(rows: DataFrame, reduce, size: int, block: int = NEAR_ROWS) -> dict[int, np.ndarray]:
    """Sums of vectors over all rows: ``reduce`` turns ``block`` records into {key: vector of up to ``size`` numbers}.

    A task packs its sums, one vector a key, and they are added in the order of the tasks: without a shuffle, as tasks are no
    more than the cores, or the rows' size by the read split.
    """
    def run(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for at in range(0, b.num_rows, block):
                for k, v in reduce(b.slice(at, block)).items():
                    total[k] = total[k] + v if k in total else v
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([v.tobytes() for v in total.values()], pa.binary())],
                                         names=["key", "v"])
    got = rows.mapInArrow(run, "key long, v binary").toArrow()
    out: dict[int, np.ndarray] = {}
    for k, v in zip(got.column("key").to_pylist(), got.column("v").to_pylist()):
        v = np.frombuffer(v)
        out.setdefault(k, np.zeros(size))[:len(v)] += v
    return out


def _uniform(row: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = row.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * np.uint64(salt + 1)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    return ((z >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)


def _records(rows: DataFrame) -> int:
    """Records turned into one matrix: a packed block, or as many rows."""
    return 1 if rows.schema["x"].dataType.typeName() == "binary" else NEAR_ROWS


def _draw(rows: DataFrame, centers: np.ndarray | None, seeds: Sequence[int], step: int) -> np.ndarray:
    """(start, candidate, coordinate): rows drawn for each start, in proportion to their squared distances."""
    n, step_rows = len(seeds), _records(rows)

    def run(batches):
        best: dict[tuple[int, int], tuple] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, step_rows):
                b = batch.slice(at, step_rows)
                x, row = _matrix(b), _keys(b)
                for s in range(n):
                    far = np.ones(len(x)) if centers is None else _squares(x, centers[s]).min(1)
                    for c in range(CANDIDATES):
                        with np.errstate(divide="ignore"):
                            late = -np.log(_uniform(row, (seeds[s] * 1009 + step) * CANDIDATES + c)) / far
                        tied = np.flatnonzero(late == np.fmin.reduce(late))
                        i = tied[row[tied].argmin()] if len(tied) else row.argmin()
                        got = float(late[i]), int(row[i]), x[i].tolist()
                        best[s, c] = min(best.get((s, c), got), got)
        for (s, c), (late, row, x) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array([s]), pa.array([c]), pa.array([late]), pa.array([row]), pa.array([x])],
                                             names=["s", "c", "late", "row", "x"])
    got = (rows.mapInArrow(run, "s long, c long, late double, row long, x array<double>")
           .groupBy("s", "c").agg(F.min_by("x", F.struct("late", "row")).alias("x")).collect())
    if not got:
        raise ValueError("no rows to cluster")
    out = np.zeros((n, CANDIDATES, len(got[0]["x"])))
    for r in got:
        out[r["s"], r["c"]] = r["x"]
    return out


def _starts(keyed: DataFrame, rows: DataFrame, k: int, seeds: Sequence[int]) -> np.ndarray:
    """(start, centre, coordinate) by greedy k-means++, all starts together; ``keyed`` rows are drawn, ``rows`` only summed."""
    centers = _draw(keyed, None, seeds, 0)[:, :1]
    while centers.shape[1] < k:
        tried = _draw(keyed, centers, seeds, centers.shape[1])

        def costs(b):
            x = _matrix(b)
            return {s: np.minimum(_squares(x, centers[s]).min(1)[:, None], _squares(x, tried[s])).sum(0) for s in range(len(seeds))}
        got = summed(rows, costs, CANDIDATES, _records(rows))
        best = [int(got[s].argmin()) for s in range(len(seeds))]
        centers = np.concatenate([centers, np.stack([tried[s, c] for s, c in enumerate(best)])[:, None]], 1)
    return centers


def _sums(todo: dict[tuple[int, int], np.ndarray]):
    """Cost, and rows and coordinate sums of every cluster, of each run over a batch.

    Runs of one K stand together, with rows along the last axis: the nearest centre is a minimum over whole lines of
    numbers, and what it marks is the left side of the product that gives the sums.
    """
    names = list(todo)
    groups = []
    for k in sorted({len(c) for c in todo.values()}):
        own = [j for j, r in enumerate(names) if len(todo[r]) == k]
        at = np.concatenate([todo[names[j]] for j in own])
        groups.append((k, own, np.hstack([-2 * at, (at * at).sum(1)[:, None]])))

    def reduce(b):
        x = _matrix(b)
        n, squares = len(x), (x * x).sum(1)
        x = np.hstack([x, np.ones((n, 1))])
        out = {}
        for k, own, at in groups:
            d = (at @ x.T).reshape(len(own), k, n)      # squared distances less the row's own square
            least = d.min(1)
            one = d == least[:, None]
            if np.count_nonzero(one) != n * len(own):
                one &= one.cumsum(1) == 1       # the first one on a tie
            sums = (one.reshape(-1, n).astype(float) @ x).reshape(len(own), k, -1)
            cost = np.maximum(least + squares, 0).sum(1)
            out |= {j: np.concatenate([[cost[i]], sums[i, :, -1], sums[i, :, :-1].ravel()]) for i, j in enumerate(own)}
        return out
    return reduce


def fit_many(df: DataFrame, ks: Sequence[int], key: str, seeds: Sequence[int] = tuple(range(42, 52)), features: str = "features",
             tolerance: float = 1e-4, max_steps: int = MAX_STEPS) -> dict[int, Centers]:
    """Best run of all starts for each K.  ``tolerance`` is relative to the features' mean variance, as the reference's."""
    keyed = _blocks(df.select(vector_to_array(F.col(features)).alias("x"), F.xxhash64(key).alias("row")))
    rows = keyed.select("x", "n").persist()     # every step reads them; what memory doesn't hold stays on the executors' disks
    try:
        return _fit(rows, _starts(keyed, rows, max(ks), seeds), ks, seeds, features, tolerance, max_steps)
    finally:
        rows.unpersist()


def _fit(rows: DataFrame, first: np.ndarray, ks: Sequence[int], seeds: Sequence[int], features: str, tolerance: float,
         max_steps: int) -> dict[int, Centers]:
    """Lloyd's steps of all runs from their first centres."""
    d = first.shape[2]

    def spread(b):
        x = _matrix(b)
        return {0: np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)])}
    s = summed(rows, spread, 1 + 2 * d, 1)[0]
    enough = tolerance * float(np.mean(s[1 + d:] / s[0] - (s[1:1 + d] / s[0]) ** 2))
    runs = {(k, i): first[i, :k].copy() for k in ks for i in range(len(seeds))}
    todo, cost = dict(runs), {}
    same = SAME * float(np.sqrt(max(s[1 + d:].max() / s[0], 0)))   # centres so near have the same rows: sums in another order
    for step in range(max_steps + 1):
        names = list(todo)
        got = summed(rows, _sums(todo), 1 + max(len(c) for c in todo.values()) * (1 + d), 1)
        moved = {}
        for j, r in enumerate(names):
            k, v = len(todo[r]), got[j]
            cost[r], n = float(v[0]), v[1:1 + k]
            new = np.where(n[:, None] > 0, v[1 + k:1 + k + k * d].reshape(k, d) / np.maximum(n, 1)[:, None], todo[r])
            runs[r] = todo[r]  # the centres that the cost belongs to
            if np.abs(new - todo[r]).max() > same:
                moved[r] = new
        # a run whose centres stay as they are leaves; the others go on until all have settled
        if step == max_steps or all(((new - todo[r]) ** 2).sum() <= enough for r, new in moved.items()):
            break
        todo = moved
    out = {}
    for k in ks:
        best = min(range(len(seeds)), key=lambda i: (cost[k, i], i))
        out[k] = Centers(tuple(tuple(map(float, c)) for c in runs[k, best]), cost[k, best], features)
    return out
