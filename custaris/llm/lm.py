"""Language-model scoring by a log-bilinear neural model, trained in numpy with noise-contrastive estimation.

The model predicts the next word from the two before it: ``q = r[w1] C1 + r[w2] C2``, and words score by ``q . v + b``.
The output is in two levels, a class of the word and the word in its class, so that batched matrix products give
normalised log-probabilities over the whole short list.  The short list holds the commonest training words; all others
share one symbol and their smoothed unigram shares, so every text gets a normalised probability.

Counts are exact and cover all training documents.  Training covers them too: each document belongs to one round; in a
round every task trains from the same start on its own documents, and the models are averaged, weighted by tokens, in a
tree of bounded groups.  Only the model (fixed size) and the ``HEAD`` commonest words are broadcast; counts of all other
words reach their documents by a join.  That join has no hot key, since the commonest words never enter it.

Defined results: null text is empty and has only the end token; equal rows are separate documents; without training
documents every probability is 1; an empty table gives no rows; extra columns are left out of the query.
"""

from __future__ import annotations

from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, documents, materialize, slices, words

END = b"\n"                # no word holds it
CLASSES, CLASS_SIZE, DIM = 64, 64, 16
SHORT = CLASSES * CLASS_SIZE
HEAD = 262_144             # words whose counts are broadcast at most
ROUNDS = 2
NOISE = 5
BATCH = 4096
RATE = 0.3
FAN = 64                   # models averaged in one group at most
MANY_WORDS = 400_000       # words a task counts before it hands them on
LOG10 = 1 / np.log(10)


def counted(docs: DataFrame) -> DataFrame:
    """(word, n) over ``docs`` (text): words and end tokens; tasks hand on partial counts."""
    def run(batches):
        have: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(have.keys()), pa.binary()), pa.array(list(have.values()), pa.int64())], names=["word", "n"])
        for b in slices(batches):
            for t in b.column("text").to_pylist():
                have.update(words(t))
            have[END] += b.num_rows
            if len(have) > MANY_WORDS:
                yield out()
                have.clear()
        yield out()
    return docs.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Lexicon:
    """The head words with counts; the first SHORT - 1 of them are the short list (ids 1 ..; 0 is every other word)."""

    def __init__(self, head: list[tuple[bytes, int]], total: int, distinct: int):
        head = sorted(head, key=lambda x: (-x[1], x[0]))
        self.total, self.distinct = total, distinct
        self.words, self.n = [w for w, _ in head], np.array([n for _, n in head], np.int64)
        short = self.n[:SHORT - 1]
        self.rest_total, self.rest_distinct = total - int(short.sum()), distinct - len(short)
        freq = np.concatenate([[max(self.rest_total, 0.5)], short, np.zeros(SHORT - 1 - len(short))])
        freq = freq.reshape(CLASSES, CLASS_SIZE)
        self.live = freq > 0
        with np.errstate(divide="ignore", invalid="ignore"):
            self.p_class = freq.sum(1) / freq.sum()
            self.p_in = np.where(freq.sum(1, keepdims=True) > 0, freq / freq.sum(1, keepdims=True), 0)

    def index(self) -> dict[bytes, int]:
        return {w: k for k, w in enumerate(self.words, 1)}


def fresh(lex: Lexicon, seed: int = 5) -> dict[str, np.ndarray]:
    """Start: exactly the unigram model, with small random vectors."""
    r = np.random.default_rng(seed)
    with np.errstate(divide="ignore"):
        return {"r": r.normal(0, 0.1, (SHORT, DIM)).astype(np.float32), "c1": np.eye(DIM, dtype=np.float32), "c2": (0.5 * np.eye(DIM)).astype(np.float32),
                "u": r.normal(0, 0.1, (CLASSES, DIM)).astype(np.float32), "ub": np.maximum(np.log(lex.p_class), -50).astype(np.float32),
                "v": r.normal(0, 0.1, (SHORT, DIM)).astype(np.float32), "vb": np.maximum(np.log(lex.p_in), -50).reshape(-1).astype(np.float32)}


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _sum_rows(rows: int, at: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Rows of ``x`` summed by their number ``at``."""
    out = np.zeros((rows, x.shape[1]), np.float32)
    order = np.argsort(at.astype(np.uint16), kind="stable")
    key = at[order]
    start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    out[key[start]] = np.add.reduceat(x[order], start, axis=0)
    return out


class Trainer:
    """AdaGrad on the noise-contrastive loss of class and of word in class."""

    def __init__(self, p: dict[str, np.ndarray], lex: Lexicon, seed: int):
        self.p = {k: v.copy() for k, v in p.items()}
        self.sum2 = {k: np.full_like(v, 90.0 if k in ("ub", "vb") else 0.3) for k, v in p.items()}   # biases start right
        self.rng, self.tokens = np.random.default_rng(seed), 0
        self.p_class, self.cum = lex.p_class, np.cumsum(lex.p_in, 1)
        with np.errstate(divide="ignore"):
            self.log_class = np.maximum(np.log(NOISE * lex.p_class), -60).astype(np.float32)
            self.log_in = np.maximum(np.log(NOISE * lex.p_in), -60).astype(np.float32)

    def step(self, w: np.ndarray, c1: np.ndarray, c2: np.ndarray) -> None:
        p, n = self.p, len(w)
        order = np.argsort(w.astype(np.uint16), kind="stable")
        w, c1, c2 = w[order], c1[order], c2[order]
        cls = w // CLASS_SIZE
        r1, r2 = p["r"][c1], p["r"][c2]
        q = r1 @ p["c1"] + r2 @ p["c2"]
        first = np.flatnonzero(np.append(True, cls[1:] != cls[:-1]))
        there = cls[first]
        # class against NOISE classes of the unigram
        noise = self.rng.choice(CLASSES, NOISE, p=self.p_class)
        un = p["u"][noise]
        u = p["u"][cls]
        gd = 1 - _sigmoid((q * u).sum(1) + p["ub"][cls] - self.log_class[cls])
        gn = -_sigmoid(q @ un.T + (p["ub"][noise] - self.log_class[noise]))
        dq = gd[:, None] * u + gn @ un
        g = {"u": np.zeros_like(p["u"]), "ub": np.zeros_like(p["ub"])}
        g["u"][there] = np.add.reduceat(gd[:, None] * q, first, axis=0)
        g["ub"][there] = np.add.reduceat(gd, first)
        np.add.at(g["u"], noise, gn.T @ q)
        np.add.at(g["ub"], noise, gn.sum(0))
        # word against NOISE words of its class
        pick = (self.rng.random((CLASSES, NOISE, 1)) * self.cum[:, None, -1:] > self.cum[:, None]).sum(2).clip(0, CLASS_SIZE - 1)
        at = pick + np.arange(CLASSES)[:, None] * CLASS_SIZE
        vt, vn = p["v"][w], p["v"][at][cls]                                   # n, DIM and n, NOISE, DIM
        flat = self.log_in.reshape(-1)
        hd = 1 - _sigmoid((q * vt).sum(1) + p["vb"][w] - flat[w])
        hn = -_sigmoid(np.matmul(vn, q[:, :, None])[:, :, 0] + (p["vb"] - flat)[at][cls])
        dq += hd[:, None] * vt + np.matmul(hn[:, None], vn)[:, 0]
        g["v"] = _sum_rows(SHORT, w, hd[:, None] * q)
        g["vb"] = np.bincount(w, hd, SHORT).astype(np.float32)
        np.add.at(g["v"], at[there].reshape(-1), np.add.reduceat((hn[:, :, None] * q[:, None]).reshape(n, -1), first, axis=0).reshape(-1, DIM))
        np.add.at(g["vb"], at[there].reshape(-1), np.add.reduceat(hn, first, axis=0).reshape(-1))
        g["c1"], g["c2"] = r1.T @ dq, r2.T @ dq
        g["r"] = _sum_rows(SHORT, c1, dq @ p["c1"].T) + _sum_rows(SHORT, c2, dq @ p["c2"].T)
        scale = np.float32(n ** -0.5)     # sums over a batch, scaled so that AdaGrad sees steps of one size
        for k, x in g.items():
            x *= scale
            self.sum2[k] += x * x
            p[k] -= np.float32(-RATE) * x / np.sqrt(self.sum2[k])
        self.tokens += n


class Scorer:
    """Normalised log-probabilities by batched matrix products."""

    def __init__(self, p: dict[str, np.ndarray], lex: Lexicon):
        self.a, self.b = p["r"] @ p["c1"], p["r"] @ p["c2"]
        self.u, self.ub = p["u"].T.copy(), np.where(lex.live.any(1), p["ub"], -1e9).astype(np.float32)
        self.v = p["v"].reshape(CLASSES, CLASS_SIZE, DIM).transpose(0, 2, 1).copy()
        self.vb = np.where(lex.live, p["vb"].reshape(CLASSES, CLASS_SIZE), -1e9).astype(np.float32)

    @staticmethod
    def _log_softmax_at(s: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Scores are held within +-80, so that single precision neither overflows nor loses a row; padding stays out."""
        np.minimum(s, 80, out=s)
        np.maximum(s, np.where(s[:1] < -1e8, -1e9, -80).astype(np.float32), out=s)
        mine = s[np.arange(len(s)), at]
        np.exp(s, out=s)
        return mine - np.log(s @ np.ones(s.shape[1], np.float32))

    def __call__(self, w: np.ndarray, c1: np.ndarray, c2: np.ndarray) -> np.ndarray:
        out = np.empty(len(w), np.float64)
        for a in range(0, len(w), 65536):
            x, y = w[a:a + 65536], slice(a, a + 65536)
            cls = x // CLASS_SIZE
            order = np.argsort(cls.astype(np.uint16), kind="stable")
            cls = cls[order]
            q = self.a[c1[y][order]] + self.b[c2[y][order]]
            got = np.empty(len(x), np.float32)
            for k in range(0, len(x), 4096):       # in cache
                got[k:k + 4096] = self._log_softmax_at(q[k:k + 4096] @ self.u + self.ub, cls[k:k + 4096])
            inside = x[order] - cls * CLASS_SIZE
            start = np.searchsorted(cls, np.arange(CLASSES + 1))
            for c in range(CLASSES):
                for k in range(start[c], start[c + 1], 4096):
                    z = min(k + 4096, start[c + 1])
                    got[k:z] += self._log_softmax_at(q[k:z] @ self.v[c] + self.vb[c], inside[k:z])
            out[a + order] = got
        return out


def _ids(texts, index: dict[bytes, int]):
    """Head numbers (0: not in the head) of all tokens with their ends, and the token count of each text."""
    get = index.get
    seqs = [[get(x, 0) for x in (*words(t), END)] for t in texts]
    return np.array([k for s in seqs for k in s], np.int64), np.array([len(s) for s in seqs], np.int64)


def _contexts(short: np.ndarray, n: np.ndarray, end_id: int):
    """The one and the two words before each token; the end token stands before a text."""
    first = np.cumsum(n) - n
    c1, c2 = np.roll(short, 1), np.roll(short, 2)
    c1[first] = end_id
    c2[first] = end_id
    second = first[n > 1] + 1
    c2[second] = end_id
    return c1, c2


@lru_cache(maxsize=1)
def _index_of(key: int, broadcast) -> tuple[Lexicon, dict[bytes, int]]:
    lex = broadcast.value
    return lex, lex.index()


def train(docs: DataFrame, lexicon, id_col: str = "doc_id") -> dict[str, np.ndarray]:
    """Model parameters after ROUNDS of parallel training; each document is in one round."""
    spark = docs.sparkSession
    p = fresh(lexicon.value)
    names = sorted(p)
    shapes = {k: p[k].shape for k in names}
    for rnd in range(ROUNDS):
        start = spark.sparkContext.broadcast(p)

        def run(batches, rnd=rnd, start=start):
            lex, index = _index_of(lexicon.id if hasattr(lexicon, "id") else 0, lexicon)
            end_id = index.get(END, 0)
            end_id = end_id if end_id < SHORT else 0
            t = Trainer(start.value, lex, 100 + rnd)
            rest = None
            for b in slices(batches):
                k, n = _ids(b.column("text").to_pylist(), index)
                w = np.where(k < SHORT, k, 0)
                own = (w, *_contexts(w, n, end_id))
                own = own if rest is None else tuple(np.concatenate(x) for x in zip(rest, own))
                cut = len(own[0]) - len(own[0]) % BATCH
                for a in range(0, cut, BATCH):
                    t.step(*[x[a:a + BATCH] for x in own])
                rest = tuple(x[cut:] for x in own)
            if rest is not None and len(rest[0]):
                t.step(*rest)
            if t.tokens:
                yield pa.RecordBatch.from_arrays([
                    pa.array(names), pa.array([float(t.tokens)] * len(names)),
                    pa.array([(t.p[k].astype(np.float64) * t.tokens).astype(np.float32).tobytes() for k in names], pa.binary())],
                    names=["name", "tokens", "x"])
        part = docs.where(F.pmod(F.xxhash64(id_col, "text"), F.lit(ROUNDS)) == rnd).select("text")
        models = materialize(part.mapInArrow(run, "name string, tokens double, x binary").withColumn(
            "g", F.spark_partition_id()), f"models{rnd}")
        groups = models.agg(F.max("g")).first()[0]
        while groups is not None:
            models = models.withColumn("g", F.floor(F.col("g") / FAN).cast("int"))
            models = models.groupBy("name", "g").applyInArrow(_sum_models, "name string, g int, tokens double, x binary")
            groups = groups // FAN
            if groups == 0:
                break
            models = materialize(models, f"models{rnd}")
        for r in models.collect():                       # one row a parameter
            p[r.name] = (np.frombuffer(r.x, np.float32).astype(np.float64) / r.tokens).astype(np.float32).reshape(shapes[r.name])
    return p


def _sum_models(t: pa.Table) -> pa.Table:
    """Sum of at most FAN weighted parameter blocks."""
    x = sum(np.frombuffer(b.as_py(), np.float32).astype(np.float64) for b in t.column("x"))
    return pa.table({"name": t.column("name")[:1], "g": t.column("g")[:1], "tokens": pa.array([sum(t.column("tokens").to_pylist())]),
                     "x": pa.array([x.astype(np.float32).tobytes()], pa.binary())})


def lexicon_of(counts: DataFrame) -> Lexicon:
    """Totals and the head: the words from the least count whose words fit into HEAD (counts in bins of an eighth octave)."""
    n = counts.agg(F.sum("n"), F.count("*")).first()
    bins = counts.groupBy(F.floor(F.log2("n") * 8).cast("int").alias("bin")).agg(F.count("*").alias("k")).collect()   # at most 512
    least, have = None, 0
    for b in sorted(bins, key=lambda r: -r.bin):
        have += b.k
        if have > HEAD:
            break
        least = b.bin
    head = counts.where(F.floor(F.log2("n") * 8) >= least).toArrow() if least is not None else None
    rows = list(zip(head.column("word").to_pylist(), head.column("n").to_pylist())) if head is not None else []
    return Lexicon(rows, int(n[0] or 0), int(n[1]))


def scored(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), held_out.alias("held_out"))
    counts = materialize(counted(d.where(~F.col("held_out")).select("text")), "counts")
    lex = lexicon_of(counts)
    lexicon = spark.sparkContext.broadcast(lex)
    params = spark.sparkContext.broadcast(train(d.where(~F.col("held_out")), lexicon, "doc_id"))
    base_of = float(lex.total + lex.distinct + 1)
    rest_of = float(lex.rest_total + lex.rest_distinct + 1)

    def run(batches):
        lex, index = _index_of(lexicon.id if hasattr(lexicon, "id") else 0, lexicon)
        model = Scorer(params.value, lex)
        end_id = index.get(END, 0)
        end_id = end_id if end_id < SHORT else 0
        c_of = np.concatenate([[0], lex.n]).astype(np.float64)
        base_log, rest_log = np.log10((c_of + 1) / base_of), np.log10((c_of + 1) / rest_of)
        for b in slices(batches):
            texts = b.column("text").to_pylist()
            k, n = _ids(texts, index)
            w = np.where(k < SHORT, k, 0)
            lp = model(w, *_contexts(w, n, end_id)) * LOG10
            lp += np.where((w == 0) & (k > 0), rest_log[k], 0)      # words in the head but not on the short list
            base = np.where(k > 0, base_log[k], 0)
            first = np.cumsum(n) - n
            tails, reps = [], []
            for t, f, m in zip(texts, first.tolist(), n.tolist()):
                miss = np.flatnonzero(k[f:f + m] == 0)
                if len(miss):
                    ws = [*words(t), END]
                    c = Counter([ws[i] for i in miss])
                    tails.append(list(c.keys()))
                    reps.append(list(c.values()))
                else:
                    tails.append([])
                    reps.append([])
            yield pa.RecordBatch.from_arrays([
                b.column("doc_id"), b.column("held_out"), pa.array(n), pa.array(np.add.reduceat((k > 0).astype(np.int64), first)),
                pa.array(np.add.reduceat(base, first)), pa.array(np.add.reduceat(lp, first)),
                pa.array(tails, pa.list_(pa.binary())), pa.array(reps, pa.list_(pa.int64()))],
                names=["doc_id", "held_out", "n_tokens", "known", "base", "lp", "tail", "reps"])
    kind = dict(d.dtypes)["doc_id"]
    x = d.mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, known long, base double, lp double, tail array<binary>, reps array<long>")
    x = materialize(x.withColumn("rid", F.monotonically_increasing_id()), "scores")
    tail = x.select("rid", F.explode(F.arrays_zip("tail", "reps")).alias("z")).select("rid", F.col("z.tail").alias("word"), F.col("z.reps").alias("m"))
    tail = tail.join(counts.select("word", "n"), "word", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("double"))
    tail = tail.groupBy("rid").agg(
        F.sum(F.when(F.col("n") > 0, F.col("m")).otherwise(F.lit(0))).alias("k2"), F.sum(F.col("m") * F.log10((F.col("n") + 1) / F.lit(base_of))).alias("b2"),
        F.sum(F.col("m") * F.log10((F.col("n") + 1) / F.lit(rest_of))).alias("r2"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return x.join(tail, "rid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + zero("k2")).cast("long").alias("n_known"), F.lit(lex.total).cast("long").alias("train_tokens"),
        (F.col("base") + zero("b2")).alias("base_score"), (F.col("lp") + zero("r2")).alias("score"))


def op2_lm(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents, learned from those whose crc32(doc_id) modulo 7 is not 2."""
    return scored(documents(spark, sf_dir), crc_mod("doc_id", 7) == 2)
