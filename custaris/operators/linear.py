"""Linear models fitted for many folds and penalties together.

Logistic regression is solved by Newton steps.  A step is one aggregation over the rows whose key is the job (a left-out
fold and a penalty) and whose value is its loss, gradient and Gram matrix; every task reduces its rows to these sums, so
a scan serves all jobs, and what moves doesn't grow with the rows.  A step that does not lower a job's loss is halved.
Jobs that have converged leave the next scan.

Ridge regression needs one scan in all: a Gram matrix a fold.  The rows outside a fold are the sum of the others, and
every penalty is one solve.

The objective is the reference's: weighted loss plus ``|b|^2 / (2 C)`` (logistic) or ``alpha |b|^2`` (ridge); the
intercept isn't penalised unless a job says so.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_STEPS = 100
TOLERANCE = 1e-10          # Newton decrement, relative to the loss, at which a job has converged
BLOCK_ROWS = 8192          # rows turned into one matrix product


@dataclass(frozen=True)
class LogisticJob:
    """One fit: rows of fold ``leave`` stay out (None: all rows are in)."""

    tag: str
    c: float
    leave: int | None = None
    penalise_intercept: bool = False


@dataclass(frozen=True)
class LinearModel:
    """Coefficients and intercept; ``kind`` says whether the result is a probability."""

    kind: str
    coefficients: tuple[float, ...]
    intercept: float
    features: str = "features"

    def margin(self) -> Column:
        x = F.zip_with(vector_to_array(F.col(self.features)), F.lit(list(self.coefficients)), lambda a, b: a * b)
        return F.aggregate(x, F.lit(self.intercept), lambda acc, v: acc + v)

    def score(self, df: DataFrame, out: str) -> DataFrame:
        m = self.margin()
        return df.withColumn(out, 1 / (1 + F.exp(-m)) if self.kind == "logistic" else m)

    def importances(self) -> list[float]:
        return [abs(v) for v in self.coefficients]

    def to_dict(self) -> dict:
        return {"type": "linear", **asdict(self)}

    @classmethod
    def from_dict(cls, d: dict) -> LinearModel:
        return cls(d["kind"], tuple(d["coefficients"]), d["intercept"], d["features"])


def _matrix(batch: pa.RecordBatch, column: str = "x") -> np.ndarray:
    """Rows of an array column with a leading 1 for the intercept."""
    x = batch.column(column)
    flat = x.flatten().to_numpy(zero_copy_only=False)
    return np.hstack([np.ones((batch.num_rows, 1)), flat.reshape(batch.num_rows, -1)]) if batch.num_rows else np.zeros((0, 1))


def summed(rows: DataFrame, reduce, size: int, block: int = BLOCK_ROWS) -> dict[int, np.ndarray]:
    """Sums of vectors over all rows: ``reduce`` turns a task's batches, cut into ``block`` rows, into {key: vector of ``size`` numbers}.

    Vectors are added position by position, so no task sees all partial sums of a key.
    """
    def run(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for at in range(0, b.num_rows, block):
                for k, v in reduce(b.slice(at, block)).items():
                    total[k] = total[k] + v if k in total else v
        for k, v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), k, np.int64)), pa.array(np.arange(len(v))), pa.array(v)],
                                             names=["key", "place", "v"])
    got = rows.mapInArrow(run, "key long, place long, v double").groupBy("key", "place").agg(F.sum("v").alias("v")).toArrow()
    out: dict[int, np.ndarray] = {}
    key, place, v = (got.column(c).to_numpy() for c in ("key", "place", "v"))
    for k in np.unique(key).tolist():
        here = key == k
        out[k] = np.zeros(size)
        out[k][place[here]] = v[here]
    return out


def model_rows(df: DataFrame, features: str, *extra: Column) -> DataFrame:
    """The features as an array ``x`` beside the given columns."""
    return df.select(vector_to_array(F.col(features)).alias("x"), *extra)


def fit_logistic(df: DataFrame, jobs: Sequence[LogisticJob], features: str = "features", label: str = "Churn",
                 weight: str | None = "weight", fold: str | None = "fold", tolerance: float = TOLERANCE) -> list[LinearModel]:
    """One model for each job; a few scans in all."""
    y = F.col(label).cast("double").alias("y")
    w = (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w")
    rows = model_rows(df, features, y, w, (F.col(fold).cast("int") if fold else F.lit(-1)).alias("fold"))
    first = rows.select("x").first()
    if first is None:
        raise ValueError("no rows to fit")
    d = len(first["x"]) + 1
    beta = np.zeros((len(jobs), d))
    penalty = np.array([1.0 / j.c for j in jobs])
    last, step, best = np.full(len(jobs), np.inf), np.zeros((len(jobs), d)), beta.copy()
    open_jobs = list(range(len(jobs)))
    for _ in range(MAX_STEPS):
        if not open_jobs:
            return [LinearModel("logistic", tuple(map(float, b[1:])), float(b[0]), features) for b in best]
        sums = summed(rows, _logistic_sums(beta, open_jobs, [jobs[k].leave for k in open_jobs]), 1 + d + d * d)
        still = []
        for k in open_jobs:
            s = sums.get(k)
            if s is None:
                raise ValueError(f"no rows outside fold {jobs[k].leave}")
            ridge = np.full(d, penalty[k])
            ridge[0] *= jobs[k].penalise_intercept
            loss = s[0] + 0.5 * float(ridge @ beta[k] ** 2)
            if loss > last[k] + 1e-12 * abs(last[k]):  # the step went too far
                step[k] /= 2
                if np.abs(step[k]).max() > 1e-14:
                    beta[k] = best[k] + step[k]
                    still.append(k)
                continue
            best[k], last[k] = beta[k].copy(), loss
            g = s[1:1 + d] + ridge * beta[k]
            h = s[1 + d:].reshape(d, d) + np.diag(ridge)
            step[k] = -np.linalg.lstsq(h, g, rcond=1e-14)[0]
            if -float(g @ step[k]) <= tolerance * max(1.0, abs(loss)):
                best[k] += step[k]   # the last step is as good as free
                continue
            beta[k] = best[k] + step[k]
            still.append(k)
        open_jobs = still
    raise ValueError(f"{len(open_jobs)} fits did not converge in {MAX_STEPS} steps")


def _logistic_sums(beta, open_jobs, leave):
    """Loss, gradient and Gram matrix of each open job over a batch."""
    at = beta[open_jobs].T

    def reduce(b):
        x = _matrix(b)
        y, w, fold = (b.column(c).to_numpy(zero_copy_only=False) for c in ("y", "w", "fold"))
        m = x @ at
        p = 0.5 * (1 + np.tanh(m / 2))
        lost = np.logaddexp(0, m) - y[:, None] * m
        out = {}
        for j, k in enumerate(open_jobs):
            own = w if leave[j] is None else np.where(fold == leave[j], 0.0, w)
            gram = (x * (own * p[:, j] * (1 - p[:, j]))[:, None]).T @ x
            out[k] = np.concatenate([[own @ lost[:, j]], x.T @ (own * (p[:, j] - y)), gram.ravel()])
        return out
    return reduce


def predict_folds(df: DataFrame, models: dict[tuple[str, int], LinearModel], label: str = "Churn", fold: str = "fold") -> DataFrame:
    """(model, fold, label, p) of every row by the model of each (tag, fold left out); one scan for all."""
    some = next(iter(models.values()))
    logistic, tags = some.kind == "logistic", sorted({t for t, _ in models})
    of = {k: np.array([m.intercept, *m.coefficients]) for k, m in models.items()}

    def run(batches):
        for b in batches:
            x, folds, y = _matrix(b), b.column("fold").to_numpy(), b.column("y")
            for tag in tags:
                p = np.full(b.num_rows, np.nan)
                for f in np.unique(folds).tolist():
                    here = folds == f
                    m = x[here] @ of[tag, f]
                    p[here] = 0.5 * (1 + np.tanh(m / 2)) if logistic else m
                yield pa.RecordBatch.from_arrays([pa.array([tag] * b.num_rows, pa.string()), b.column("fold"), y, pa.array(p)],
                                                 names=["model", "fold", label, "p"])
    rows = model_rows(df, some.features, F.col(label).cast("double").alias("y"), F.col(fold).cast("int").alias("fold"))
    return rows.mapInArrow(run, f"model string, fold int, `{label}` double, p double")


# -- ridge ---------------------------------------------------------------------------------

def fold_grams(df: DataFrame, features: str = "features", label: str = "label", fold: str = "fold") -> dict[int, np.ndarray]:
    """Gram matrix of (1, x, y) for every fold; one scan."""
    rows = model_rows(df, features, F.col(label).cast("double").alias("y"), F.col(fold).cast("int").alias("fold"))
    first = rows.select("x").first()
    if first is None:
        raise ValueError("no rows to fit")
    d = len(first["x"]) + 2

    def reduce(b):
        z = np.hstack([_matrix(b), b.column("y").to_numpy(zero_copy_only=False)[:, None]])
        folds = b.column("fold").to_numpy(zero_copy_only=False)
        return {int(f): (z[folds == f].T @ z[folds == f]).ravel() for f in np.unique(folds)}
    return {f: s.reshape(d, d) for f, s in summed(rows, reduce, d * d).items()}


def ridge_from_gram(gram: np.ndarray, alpha: float, features: str = "features") -> LinearModel:
    """Ridge coefficients of the rows that the Gram matrix of (1, x, y) sums up."""
    n, s = gram[0, 0], gram[0, 1:]
    centred = gram[1:, 1:] - np.outer(s, s) / n     # the intercept is free: centred sums
    b = np.linalg.lstsq(centred[:-1, :-1] + alpha * np.eye(len(s) - 1), centred[:-1, -1], rcond=1e-14)[0]
    return LinearModel("linear", tuple(map(float, b)), float((s[-1] - s[:-1] @ b) / n), features)


def ridge_folds(grams: dict[int, np.ndarray], alphas: Sequence[float], features: str = "features") -> dict[tuple[float, int], LinearModel]:
    """(alpha, fold left out) -> model, each Gram matrix being the whole less the fold's."""
    whole = sum(grams.values())
    return {(a, f): ridge_from_gram(whole - g, a, features) for a in alphas for f, g in grams.items()}
