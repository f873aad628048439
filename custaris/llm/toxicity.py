"""Toxicity by a classifier chain.

Categories are predicted one after the other by linear models on word and stem features; each later model also sees the
probabilities of the categories before it.  Those inputs come from out-of-fold predictions while fitting, so a later
model learns from what earlier models really predict on unseen documents.

The chain is ``marked`` (a document with marker words), ``severe`` (markers dense against its length), ``toxic`` (the
label).  Labels exist for ``toxic`` only; the earlier categories are derived from the labelled rows alone: markers are
the words whose document frequency under the label exceeds what chance explains (signed log-likelihood ratio, corrected for the number of words), so no
word list is written here.

A stem is the first ``STEM`` characters of a longer word.  Its features tell whether at least 1, 2, .. ``STEM_FORMS``
different words of the document have it, so suffix forms that are each too rare for the test count together.

The fit uses at most ``FIT_ROWS`` labelled documents of smallest hash (a documented bound), near copies counted once;
the out-of-fold predictions set the decision threshold.  Scoring reads whole texts.

Defined results: null or empty text has probability 0 and isn't toxic; equal rows are separate documents; without
labels of both kinds every document scores 0; an empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, materialize, slices, thinned, words

CHAIN = ("marked", "severe", "toxic")
FIT_ROWS = 8_000
FOLDS = 5
MAX_FEATURES = 512         # strongest words and stems by the ratio; the size of the models
STEM = 4                   # characters
STEM_FORMS = 3
WORD_TRIM = b".,;:!?\"'()[]{}#*$%&|<>-_"


def bag(text: str | None) -> Counter:
    """Lower-cased words without punctuation at their ends, counted."""
    return Counter(w.strip(WORD_TRIM) for w in (text or "").lower().encode("utf-8", "surrogatepass").split())


@lru_cache(200_000)
def stem(word: bytes) -> bytes | None:
    """First STEM characters of a longer word."""
    w = word.decode("utf-8", "surrogatepass")
    return w[:STEM].encode("utf-8", "surrogatepass") if len(w) > STEM else None


def features(b: Counter) -> set[bytes]:
    """Words of a bag, and b"stem k" for each stem that at least k of them have (no word holds a space)."""
    forms = Counter(map(stem, b))
    forms.pop(None, None)
    return {w for w in b if w} | {b"%s %d" % (t, k) for t, n in forms.items() for k in range(1, min(n, STEM_FORMS) + 1)}


def log_ratio(a, b, na, nb):
    """Signed G statistic (Column) of document frequencies ``a`` of ``na`` against ``b`` of ``nb``."""
    def term(k, n, p):
        return F.when(k > 0, k * F.log(k / (F.lit(float(n)) * p))).otherwise(0.0)
    p = (a + b) / F.lit(float(na + nb))
    g = (term(a, na, p) + term(F.lit(float(na)) - a, na, 1 - p) + term(b, nb, p) + term(F.lit(float(nb)) - b, nb, 1 - p)) * 2
    return F.when(a * nb > b * na, g).otherwise(-g)


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0, steps: int = 12) -> np.ndarray:
    """Weights (last: intercept) by Newton steps in the smaller of rows and columns; both are bounded here."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x1.shape[1])
    reg = np.full(len(w), l2)
    reg[-1] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        g = x1.T @ (p - y) + reg * w
        s = np.maximum(p * (1 - p), 1e-4)
        if x1.shape[1] <= len(x1):
            step = np.linalg.solve((x1 * s[:, None]).T @ x1 + np.diag(reg), g)
        else:  # Woodbury
            xd = x1 / reg
            step = g / reg - xd.T @ np.linalg.solve(np.diag(1 / s) + xd @ x1.T, x1 @ (g / reg))
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def matrix(bags: list[Counter], words: dict[bytes, int], markers: set[bytes]) -> np.ndarray:
    """Presence of the features ``words`` (words and stems), then log counts of markers and of markers per hundred words."""
    x = np.zeros((len(bags), len(words) + 2))
    for i, b in enumerate(bags):
        for w in features(b) & words.keys():
            x[i, words[w]] = 1.0
        n = sum(b[w] for w in markers)
        x[i, -2], x[i, -1] = np.log1p(n), np.log1p(100.0 * n / max(1, sum(b.values())))
    return x


class Chain:
    """Fitted chain: feature words and stems, markers, one weight vector a category, threshold."""

    def __init__(self, words: list[bytes], markers: set[bytes], x: np.ndarray, n_words: np.ndarray, toxic: np.ndarray):
        self.words, self.markers = {w: k for k, w in enumerate(words)}, set(markers)
        y = np.asarray(toxic, float)
        hits = np.expm1(x[:, -2])
        share = hits / np.maximum(n_words, 1)
        cut = np.median(share[hits > 0.5]) if (hits > 0.5).any() else np.inf
        fold = np.arange(len(y)) % FOLDS
        self.weights, before = [], np.zeros((len(y), 0))
        for goal in ((hits > 0.5).astype(float), (share >= cut).astype(float), y):
            z = np.hstack([x, before])
            self.weights.append(logistic(z, goal))
            out = np.zeros(len(y))
            for f in range(FOLDS):
                if (fold != f).any() and (fold == f).any():
                    out[fold == f] = self._probability(z[fold == f], logistic(z[fold != f], goal[fold != f]))
            before = np.hstack([before, out[:, None]])
        self.threshold = self._threshold(before[:, -1], y)

    @staticmethod
    def _probability(z, w):
        return 1 / (1 + np.exp(-np.clip(z @ w[:-1] + w[-1], -30, 30)))

    @staticmethod
    def _threshold(p, y) -> float:
        """Smallest cut from which the out-of-fold precision is at least 0.9 and the F1 value best."""
        order = np.argsort(-p, kind="stable")
        tp = np.cumsum(y[order])
        n = np.arange(1, len(y) + 1)
        precise = tp / n >= 0.9
        f1 = np.where(precise, 2 * tp / (n + y.sum()), -1)
        k = int(f1.argmax()) if len(f1) else 0
        return float(p[order][k]) if len(f1) and f1[k] > 0 else 1.0

    def predict(self, bags: list[Counter]) -> np.ndarray:
        """Probabilities, one column a category."""
        z = matrix(bags, self.words, self.markers)
        for w in self.weights:
            z = np.hstack([z, self._probability(z, w)[:, None]])
        return z[:, -len(self.weights):]


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows: int) -> DataFrame:
    """Bounded labelled sample (text, y, h), one document of each group that shares a least shingle.

    Copies would vote many times for their chance words; three independent least shingles find nearly all of them.
    The whole word sequence is the shingle of a text under five words.
    """
    y = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).cast("int").alias("y"))
    y = thinned(y, F.xxhash64(id_col), labels.count(), rows).orderBy(F.xxhash64(id_col), id_col).limit(rows)
    d = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col), F.col(text_col).alias("text")).join(F.broadcast(y), id_col)
    d = d.select("text", "y", F.xxhash64(id_col, "text").alias("h"))

    def run(batches):
        for b in slices(batches):
            least = [[min(zlib.crc32(b" ".join(w[i:i + 5]), seed) for i in range(max(1, len(w) - 4))) for seed in (1, 2, 3)]
                     for w in map(words, b.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array([x[k] for x in least], pa.int64()) for k in range(3)]],
                                             names=["text", "y", "h", "m0", "m1", "m2"])
    d = d.mapInArrow(run, "text string, y int, h long, m0 long, m1 long, m2 long")
    for k in range(3):
        d = d.groupBy(f"m{k}").agg(F.min_by(F.struct(*d.columns), F.struct("h", "text")).alias("s")).select("s.*")
    return materialize(d.select("text", "y", "h"), "toxic")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        rows: int = FIT_ROWS) -> Chain | None:
    """Chain fitted on a bounded, hash-ordered sample of labelled documents; None without both labels."""
    d = sample(docs, labels, id_col, text_col, label_col, rows)
    n = {r.y: r["count"] for r in d.groupBy("y").count().collect()}
    n_t, n_c = n.get(1, 0), n.get(0, 0)
    if min(n_t, n_c) < 5:
        return None

    def split(batches):
        for b in slices(batches):
            rows = [(w, t) for x, t in zip(b.column("text").to_pylist(), b.column("y").to_pylist()) for w in features(bag(x))]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows], pa.binary()), pa.array([t for _, t in rows], pa.int32())], names=["w", "y"])
    freq = d.mapInArrow(split, "w binary, y int").groupBy("w").agg(F.sum("y").cast("double").alias("a"), F.sum(1 - F.col("y")).cast("double").alias("c"))
    freq = materialize(freq.where("a + c >= 3"), "toxicwords")
    least = 2 * np.log(max(freq.count(), 1) / 0.01)       # chance would pass this once in a hundred corpora
    g = log_ratio(F.col("a"), F.col("c"), n_t, n_c)
    best = freq.withColumn("g", g).where(F.abs("g") >= float(least)).orderBy(F.desc(F.abs("g")), "w").limit(MAX_FEATURES).collect()
    feats = [bytes(r.w) for r in best]
    # a marker is nearly absent from clean documents, not only less frequent there
    markers = {bytes(r.w) for r in best if b" " not in bytes(r.w) and r.g > 0 and r.a / n_t >= 20 * (r.c + 0.5) / n_c}
    index = {w: k for k, w in enumerate(feats)}

    def encode(batches):
        for b in slices(batches):
            bags = [bag(t) for t in b.column("text").to_pylist()]
            x = matrix(bags, index, markers)
            yield pa.RecordBatch.from_arrays([
                pa.array([np.flatnonzero(r[:-2]).tolist() for r in x], pa.list_(pa.int32())), pa.array(x[:, -2]), pa.array(x[:, -1]),
                pa.array([sum(q.values()) for q in bags], pa.int64()), b.column("y"), b.column("h")], names=["i", "u", "v", "n", "y", "h"])
    got = d.mapInArrow(encode, "i array<int>, u double, v double, n long, y int, h long").toPandas().sort_values("h", kind="stable")
    x = np.zeros((len(got), len(feats) + 2))
    for k, i in enumerate(got.i):
        x[k, i] = 1.0
    x[:, -2], x[:, -1] = got.u, got.v
    return Chain(feats, markers, x, got.n.to_numpy(), got.y.to_numpy())


def score(docs: DataFrame, chain: Chain | None, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` with p_<category> for the chain and ``is_toxic``."""
    new = [f"p_{c}" for c in CHAIN] + ["is_toxic"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in new]
    src = docs.select(*[docs[f"`{c}`"] for c in keep], docs[f"`{text_col}`"].alias("__tx_text"))
    schema = T.StructType([src.schema[c] for c in keep] + [T.StructField(n, T.DoubleType()) for n in new[:-1]] + [T.StructField("is_toxic", T.BooleanType())])

    def run(batches):
        for b in slices(batches, "__tx_text"):
            texts = b.column("__tx_text").to_pylist()
            p = np.zeros((len(texts), len(CHAIN)))
            for a in range(0, len(texts), 256 if chain else len(texts) + 1):
                if chain:
                    p[a:a + 256] = chain.predict([bag(t) for t in texts[a:a + 256]])
            p[[not (t or "").strip() for t in texts]] = 0.0
            hit = p[:, -1] >= (chain.threshold if chain else 2.0)
            cols = [pa.array(p[:, k]) for k in range(len(CHAIN))] + [pa.array(hit & (p[:, -1] > 0))]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in keep] + cols, names=[*keep, *new])
    return src.mapInArrow(run, schema)


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    """Chain probabilities and verdict for every document, learned from ``labels``."""
    d = documents(spark, sf_dir)
    return score(d, fit(d, spark.read.parquet(f"{sf_dir}/labels.parquet")), keep=["doc_id"])
