import math
import zlib
from collections import Counter

import numpy as np

from custaris.llm import lm
from custaris.llm.common import words


def test_contract_and_held_out(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").toPandas()
    got = lm.op2_lm(spark, "/root/testdata/sf0.01").toPandas().set_index("doc_id")
    c = Counter()
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in d.doc_id}
    for i, t in zip(d.doc_id, d.text):
        if not held[i]:
            c.update([*words(t), b"\n"])
    n, v = sum(c.values()), len(c)
    assert len(got) == len(d) and (got.train_tokens == n).all()
    for i, t in zip(d.doc_id, d.text):
        w = [*words(t), b"\n"]
        r = got.loc[i]
        assert r.held_out == held[i] and r.n_tokens == len(w) and r.n_known == sum(c[x] > 0 for x in w)
        assert math.isclose(r.base_score, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
    out = got[got.held_out]
    assert out.score.sum() > out.base_score.sum()


def test_probabilities_sum_to_one():
    lex = lm.Lexicon([(b"w%d" % k, 5000 - k) for k in range(300)] + [(b"\n", 99)], 10 ** 6, 2000)
    p = lm.fresh(lex)
    r = np.random.default_rng(0)
    p = {k: v + r.normal(0, 0.3, v.shape).astype(np.float32) for k, v in p.items()}
    s = lm.Scorer(p, lex)
    w = np.arange(302)
    total = np.exp(s(w, np.full(302, 7), np.full(302, 11))).sum()
    assert abs(total - 1) < 1e-4


def test_training_learns_a_context():
    r = np.random.default_rng(2)
    a = np.repeat(r.integers(1, 40, 30_000), 2)           # every word comes twice
    lex = lm.Lexicon([(b"w%d" % k, int((a == k).sum())) for k in range(1, 40)], len(a) + 10, 45)
    order = np.argsort([-int((a == k).sum()) for k in range(1, 40)], kind="stable")
    rank = np.empty(40, int)
    rank[order + 1] = np.arange(1, 40)
    w = rank[a]
    c1, c2 = lm._contexts(w.copy(), np.array([len(w)]), 0)
    before = lm.Scorer(lm.fresh(lex), lex)(w, c1, c2).mean()
    t = lm.Trainer(lm.fresh(lex), lex, 1)
    for _ in range(20):
        for k in range(0, len(w), 2048):
            t.step(w[k:k + 2048], c1[k:k + 2048], c2[k:k + 2048])
    assert lm.Scorer(t.p, lex)(w, c1, c2).mean() > before + 0.3


def test_small_heads_take_the_join(spark, docs_of, monkeypatch):
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(["a b c a", "a b", None, "zz top", "a"] * 6)] + [(None, "b b b", "en", "s", 0)]
    from pyspark.sql import functions as F
    d = docs_of(rows)
    want = {r.doc_id: r for r in lm.scored(d, F.coalesce(F.col("doc_id") % 7, F.lit(0)) == 2).collect()}
    monkeypatch.setattr(lm, "HEAD", 2)
    got = {r.doc_id: r for r in lm.scored(d, F.coalesce(F.col("doc_id") % 7, F.lit(0)) == 2).collect()}
    assert len(got) == len(want) == len(rows)
    for i in want:
        assert got[i].n_known == want[i].n_known and math.isclose(got[i].base_score, want[i].base_score, rel_tol=1e-9)


def test_empty_and_untrained(spark, docs_of):
    from pyspark.sql import functions as F
    assert lm.scored(docs_of([]), F.lit(False)).count() == 0
    out = lm.scored(docs_of([(1, "a b", "en", "s", 0)]), F.lit(True)).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in out] == [(3, 0, 0, 0.0)] and abs(out[0].score) < 1e-6
