import numpy as np

from custaris.llm import toxicity


def test_held_out(spark):
    """Chain fitted on even ids finds the marked toxic documents among odd ids and few clean ones."""
    import pandas as pd
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    lab = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    chain = toxicity.fit(d.where("doc_id % 2 = 0"), lab)
    odd = toxicity.score(d.where("doc_id % 2 = 1").join(lab.select("doc_id"), "doc_id", "left_semi"), chain, keep=["doc_id", "text"]).toPandas()
    x = odd.merge(lab.toPandas(), on="doc_id")
    marked = x.text.map(lambda t: len(chain.markers & set(toxicity.bag(t))) > 0)
    assert x.is_toxic[marked & (x.toxic == 1)].mean() > 0.95
    assert x.is_toxic[x.toxic == 0].mean() < 0.01
    assert isinstance(x, pd.DataFrame)


def test_chain_uses_earlier_probabilities():
    rng = np.random.default_rng(1)
    bags, y = [], []
    for i in range(400):
        b = toxicity.Counter({b"w%d" % k: 1 for k in rng.integers(0, 200, 30)})
        y.append(i % 4 == 0)
        if y[-1]:
            b[b"vile"] += int(rng.integers(1, 5))
        bags.append(b)
    feats = {b"vile": 0, b"w1": 1}
    x = toxicity.matrix(bags, feats, {b"vile"})
    c = toxicity.Chain(list(feats), {b"vile"}, x, np.array([sum(b.values()) for b in bags]), np.array(y, float))
    p = c.predict(bags)
    assert p.shape == (400, 3)
    assert ((p[:, 2] >= c.threshold) == np.array(y)).mean() > 0.99
    assert [len(w) for w in c.weights] == [len(feats) + 3 + k for k in range(3)]


def test_nulls_empty_and_no_labels(spark, docs_of):
    rows = [(1, None, None, None, None), (None, "", "en", "s", 0), (2, "a b", "en", "s", 3), (2, "a b", "en", "s", 3)]
    lab = spark.createDataFrame([(1, 0, 1)], "doc_id long, quality int, toxic int")
    d = docs_of(rows).withColumnRenamed("n_chars", "p_toxic")
    out = toxicity.score(d, toxicity.fit(d, lab)).collect()
    assert len(out) == 4 and not any(r.is_toxic for r in out)
    assert toxicity.score(docs_of([]), None).count() == 0
