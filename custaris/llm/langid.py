"""Language identification by a byte convolutional network trained here.

Windows of ``WINDOW`` bytes pass a byte embedding, filters of several widths with a rectifier, a maximum over the window
and a softmax.  The fit uses ``FIT_WINDOWS`` windows of labelled texts of smallest hash (a documented bound).  A text is
cut into windows from end to end; its prediction is the mean of their log-probabilities, weighted by their bytes.

For prediction the embedding and the filters are folded into lookup tables over byte pairs, which gives the same numbers
as the convolution with few gathers.

Defined results: a null text or one without a letter is ``und`` with score 0; without labelled rows every text is;
equal rows are separate documents; an empty table gives no rows; other columns pass through :func:`predict`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_mod, documents, slices, thinned

WINDOW = 256
FIT_WINDOWS = 9_000
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBED = 8
EPOCHS = 4
BATCH = 64


class ByteNet:
    """Multi-width byte convolution, maximum over time, softmax; Adam on the cross entropy."""

    def __init__(self, classes: list[str], seed: int = 7):
        r = np.random.default_rng(seed)
        self.classes = classes
        self.p = {"e": r.normal(0, 0.3, (256, EMBED)).astype(np.float32)}
        for w in WIDTHS:
            self.p[f"w{w}"] = r.normal(0, (2 / (w * EMBED)) ** 0.5, (w * EMBED, FILTERS)).astype(np.float32)
            self.p[f"b{w}"] = np.zeros(FILTERS, np.float32)
        self.p["o"] = r.normal(0, 0.1, (FILTERS * len(WIDTHS), len(classes))).astype(np.float32)
        self.p["c"] = np.zeros(len(classes), np.float32)

    def _loss(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients for windows ``x`` (n, WINDOW) of labels ``y``."""
        p, n = self.p, len(x)
        emb = p["e"][x]
        pooled, back = [], []
        for w in WIDTHS:
            cols = np.lib.stride_tricks.sliding_window_view(emb, w, axis=1)          # n, t, EMBED, w
            cols = cols.transpose(0, 1, 3, 2).reshape(n, WINDOW - w + 1, w * EMBED)
            z = cols @ p[f"w{w}"] + p[f"b{w}"]
            at = z.argmax(1)                                                        # n, FILTERS
            top = np.take_along_axis(z, at[:, None, :], 1)[:, 0]
            pooled.append(np.maximum(top, 0))
            back.append((w, cols, at, top > 0))
        h = np.hstack(pooled)
        s = h @ p["o"] + p["c"]
        s = np.exp(s - s.max(1, keepdims=True))
        s /= s.sum(1, keepdims=True)
        s[np.arange(n), y] -= 1
        s /= n
        g = {"o": h.T @ s, "c": s.sum(0), "e": np.zeros_like(p["e"])}
        dh = s @ p["o"].T
        for k, (w, cols, at, live) in enumerate(back):
            d = dh[:, k * FILTERS:(k + 1) * FILTERS] * live                          # only the maxima pass the gradient
            hit = np.take_along_axis(cols, at[:, :, None], 1)                        # n, FILTERS, w*EMBED
            g[f"w{w}"] = np.einsum("nf,nfk->kf", d, hit)
            g[f"b{w}"] = d.sum(0)
            de = (d[:, :, None] * p[f"w{w}"].T[None]).reshape(-1, EMBED)             # n*FILTERS*w, EMBED
            bytes_at = x[np.arange(n)[:, None, None], at[:, :, None] + np.arange(w)].reshape(-1)
            np.add.at(g["e"], bytes_at, de)
        g["e"][0] = 0                                                               # padding
        return g

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, rate: float = 3e-3, seed: int = 7) -> ByteNet:
        r, step = np.random.default_rng(seed), 0
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.p["e"][0] = 0
        for _ in range(epochs):
            o = r.permutation(len(x))
            for a in range(0, len(x), BATCH):
                step += 1
                for k, g in self._loss(x[o[a:a + BATCH]], y[o[a:a + BATCH]]).items():
                    m[k] += 0.1 * (g - m[k])
                    v2[k] += 0.01 * (g * g - v2[k])
                    self.p[k] -= (rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v2[k] / (1 - 0.99 ** step)) + 1e-7)).astype(np.float32)
        return self

    def fold(self) -> ByteNet:
        """Lookup tables: a filter's value at a place is the sum of what each byte (pair) adds."""
        self.tables = {}
        for w in WIDTHS:
            one = [self.p["e"] @ self.p[f"w{w}"][k * EMBED:(k + 1) * EMBED] for k in range(w)]
            pairs = [(one[k][:, None] + one[k + 1][None]).reshape(65536, FILTERS) for k in range(0, w - 1, 2)]
            pairs[0] = pairs[0] + self.p[f"b{w}"]
            self.tables[w] = (pairs, one[-1] if w % 2 else None)
        return self

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        """(n, classes) for windows (n, WINDOW) of bytes."""
        pair = x[:, :-1].astype(np.int32) * 256 + x[:, 1:]
        h = []
        for w in WIDTHS:
            pairs, last = self.tables[w]
            t = WINDOW - w + 1
            z = pairs[0].take(pair[:, :t], axis=0)
            for k, q in enumerate(pairs[1:], 1):
                z += q.take(pair[:, 2 * k:2 * k + t], axis=0)
            if last is not None:
                z += last.take(x[:, w - 1:w - 1 + t], axis=0)
            h.append(np.maximum(z.max(1), 0))
        s = np.hstack(h) @ self.p["o"] + self.p["c"]
        s -= s.max(1, keepdims=True)
        return s - np.log(np.exp(s).sum(1, keepdims=True))


def windows(data: bytes) -> np.ndarray:
    """All windows of a text; the last one is padded with zero bytes."""
    n = max(1, -(-len(data) // WINDOW))
    return np.frombuffer(data.ljust(n * WINDOW, b"\0"), np.uint8).reshape(n, WINDOW)


def fit(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", rows: int = FIT_WINDOWS) -> ByteNet | None:
    """Network fitted on a bounded, hash-ordered sample of windows of the labelled texts of ``docs``."""
    raw = F.col(text_col).cast("binary")
    labelled = docs.where(F.col(lang_col).isNotNull())
    d = labelled.where(F.col(text_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("y"), raw.alias("raw"), F.octet_length(raw).alias("n"),
        F.explode(F.array(F.xxhash64(F.col(text_col), F.lit(1)), F.xxhash64(F.col(text_col), F.lit(2)))).alias("h"))
    at = F.pmod(F.col("h"), F.greatest(F.col("n") - F.lit(WINDOW - 1), F.lit(1)))
    d = thinned(d.where("n > 0"), F.col("h"), 2 * labelled.count(), rows).select("y", F.expr("h").alias("h"), F.substring(F.col("raw"), (at + 1).cast("int"), F.lit(WINDOW)).alias("x"))
    got = d.groupBy("y", "x").agg(F.min("h").alias("h")).orderBy("h", "y", "x").limit(rows).collect()
    classes = sorted({r.y for r in got})
    if not classes:
        return None
    x = np.vstack([windows(bytes(r.x))[:1] for r in got])
    y = np.array([classes.index(r.y) for r in got])
    return ByteNet(classes).fit(x, y).fold()


def read_texts(texts: list[str | None], net: ByteNet | None) -> list[tuple[str, float]]:
    """(language, score) of whole texts; windows go through the network in batches."""
    out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
    own = [i for i, t in enumerate(texts) if t and net is not None and any(map(str.isalpha, t))]
    data = [texts[i].encode("utf-8", "surrogatepass") for i in own]
    if not data:
        return out
    x = np.vstack([windows(d) for d in data])
    lp = np.vstack([net.log_probabilities(x[a:a + 512]) for a in range(0, len(x), 512)])
    weight = np.concatenate([np.append(np.full(len(d) // WINDOW, WINDOW), [len(d) % WINDOW] * (len(d) % WINDOW > 0)) for d in data])
    first = np.cumsum([0] + [-(-len(d) // WINDOW) for d in data[:-1]])
    mean = np.add.reduceat(lp * weight[:, None], first) / np.add.reduceat(weight, first)[:, None]
    p = np.exp(mean - mean.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    for i, r in zip(own, p):
        out[i] = (net.classes[int(r.argmax())], float(min(1.0, r.max())))
    return out


def predict(docs: DataFrame, net: ByteNet | None, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` with ``lang_pred`` and ``score``."""
    new = ["lang_pred", "score"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in new]
    src = docs.select(*[docs[f"`{c}`"] for c in keep], docs[f"`{text_col}`"].alias("__li_text"))
    schema = T.StructType([src.schema[c] for c in keep] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches):
        for b in slices(batches, "__li_text"):
            got = read_texts(b.column("__li_text").to_pylist(), net)
            yield pa.RecordBatch.from_arrays([b.column(c) for c in keep] + [
                pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=[*keep, *new])
    return src.mapInArrow(run, schema)


def op3_language(spark, sf_dir: str) -> DataFrame:
    """Language of every document, learned from rows whose crc32(doc_id) modulo 4 is not 2."""
    d = documents(spark, sf_dir)
    held = crc_mod("doc_id", 4) == 2
    return predict(d.withColumn("held_out", held), fit(d.where(~held)), keep=["doc_id", "held_out"])
