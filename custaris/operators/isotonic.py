"""Isotonic calibration on distributed rows (M9).

Rows are reduced to one a score, ranged by score, and every range pools adjacent violators on its own; the blocks that are
left are ranged anew over fewer parts and pooled again, until one part has seen all of them.  Pooling within ranges first
is exact: a block that violates its neighbour is pooled in any order.  What the last part sees is bounded: the means of the
blocks of 0/1 labels rise strictly and are fractions of their weights, so n rows leave some n^(2/3) blocks at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PARTS = 64                 # score ranges of the first pooling; each further one has an eighth of them
_SCHEMA = "lo double, hi double, w double, wy double"


@dataclass(frozen=True)
class Isotonic:
    """Ends of the blocks and their values; between blocks the value is interpolated, outside it is the nearest one's."""

    at: tuple[float, ...]
    value: tuple[float, ...]

    def transform(self, df: DataFrame, score: str = "p", out: str = "p_cal") -> DataFrame:
        at, value = np.array(self.at), np.array(self.value)

        @F.arrow_udf("double")
        def calibrated(p: pa.Array) -> pa.Array:
            x = p.to_numpy(zero_copy_only=False)
            return pa.array(np.interp(x, at, value), mask=np.isnan(x))
        return df.withColumn(out, calibrated(F.col(score).cast("double")))

    def to_dict(self) -> dict:
        return {"type": "isotonic", "at": self.at, "value": self.value}

    @classmethod
    def from_dict(cls, d: dict) -> Isotonic:
        return cls(tuple(d["at"]), tuple(d["value"]))


def pool(blocks) -> list[list[float]]:
    """Pool adjacent violators: [lo, hi, weight, weighted sum] in order of their scores."""
    out: list[list[float]] = []
    for lo, hi, w, wy in blocks:
        out.append([lo, hi, w, wy])
        while len(out) > 1 and out[-2][3] * out[-1][2] >= out[-1][3] * out[-2][2]:
            _, hi2, w2, wy2 = out.pop()
            last = out[-1]
            last[1], last[2], last[3] = hi2, last[2] + w2, last[3] + wy2
    return out


def _pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for b in batches:
            yield from zip(*[c.to_pylist() for c in b.columns])
    got = pool(rows())
    if got:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64()) for c in zip(*got)], names=["lo", "hi", "w", "wy"])


def fit(rows: DataFrame, score: str = "p", label: str = "Churn", parts: int = PARTS) -> Isotonic:
    """Calibration of a score by 0/1 labels; null scores and labels don't count."""
    p, y = F.col(score).cast("double"), F.col(label).cast("double")
    blocks = (rows.where(p.isNotNull() & y.isNotNull()).groupBy(p.alias("lo"))
              .agg(F.count("*").cast("double").alias("w"), F.sum(y).alias("wy")).select("lo", F.col("lo").alias("hi"), "w", "wy"))
    while True:
        blocks = blocks.repartitionByRange(parts, "lo").sortWithinPartitions("lo").mapInArrow(_pooled, _SCHEMA)
        if parts == 1:
            break
        parts = max(1, parts // 8)
    got = blocks.orderBy("lo").collect()
    if not got:
        raise ValueError("no rows to calibrate on")
    ends = sorted({(x, r["wy"] / r["w"]) for r in got for x in (r["lo"], r["hi"])})
    return Isotonic(tuple(x for x, _ in ends), tuple(v for _, v in ends))
