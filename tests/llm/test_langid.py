import numpy as np

from custaris.llm import langid


def test_held_out_accuracy_and_contract(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.op3_language(spark, "/root/testdata/sf0.01").toPandas().merge(d.toPandas(), on="doc_id")
    import zlib
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()
    out = got[got.held_out]
    assert len(got) == 1000 and (out.lang_pred == out.lang).mean() > 0.95
    assert got.score.between(0, 1).all()


def test_tables_equal_convolution():
    net = langid.ByteNet(["a", "b"]).fold()
    x = np.random.default_rng(0).integers(0, 256, (5, langid.WINDOW)).astype(np.uint8)
    emb = net.p["e"][x]
    h = []
    for w in langid.WIDTHS:
        z = np.stack([emb[:, t:t + w].reshape(5, -1) @ net.p[f"w{w}"] + net.p[f"b{w}"] for t in range(langid.WINDOW - w + 1)], 1)
        h.append(np.maximum(z.max(1), 0))
    s = np.hstack(h) @ net.p["o"] + net.p["c"]
    want = s - np.log(np.exp(s).sum(1, keepdims=True))
    assert np.allclose(net.log_probabilities(x), want, atol=1e-4)


def test_gradient():
    r = np.random.default_rng(3)
    net = langid.ByteNet(["a", "b", "c"])
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, y = r.integers(1, 256, (4, langid.WINDOW)), np.array([0, 1, 2, 1])

    def loss():
        net.fold()
        return -net.log_probabilities(x)[np.arange(4), y].mean()
    g = net._loss(x, y)
    for k in ("o", "w3", "b2", "e"):
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        net.p[k][at] += 1e-6
        up = loss()
        net.p[k][at] -= 2e-6
        down = loss()
        net.p[k][at] += 1e-6
        assert abs((up - down) / 2e-6 - g[k][at]) < 1e-4


def test_nulls_repeats_long_and_empty(spark, docs_of):
    rows = [(1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, "12 34 !", "en", "s", 0), (None, "the cat " * 3000, None, "s", 0)]
    rows += [(10 + i, "the cat and the dog " * 20, "en", "s", 0) for i in range(30)] + [(50 + i, "der hund und die katze " * 20, "de", "s", 0) for i in range(30)]
    net = langid.fit(docs_of(rows))
    out = langid.predict(docs_of(rows).withColumnRenamed("n_chars", "score"), net).collect()
    by = {r.doc_id: (r.lang_pred, r.score) for r in out}
    assert by[1] == by[2] == by[3] == ("und", 0.0) and by[None][0] == "en" and len(out) == len(rows)
    assert langid.fit(docs_of([])) is None
    assert {r.lang_pred for r in langid.predict(docs_of(rows), None).collect()} == {"und"}
