from custaris.llm import toxicity


def test_short_texts_stay_separate_in_the_sample(spark, docs_of):
    """Labelled texts under five words count each, equal ones once; enough of them fit a chain."""
    texts = [f"vile a{i % 7} b{i}" if i % 4 == 0 else f"kind a{i % 7} b{i}" for i in range(200)] + ["vile a0 b0", "KIND a1 B1", ""]
    docs = docs_of([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)])
    lab = spark.createDataFrame([(i, 0, int(t.startswith("vile"))) for i, t in enumerate(texts)], "doc_id long, quality int, toxic int")
    got = toxicity.sample(docs, lab, "doc_id", "text", "toxic", 1000).collect()
    assert sorted(r.text.lower() for r in got) == sorted({t.lower() for t in texts})
    chain = toxicity.fit(docs, lab)
    hit = {r.doc_id: r.is_toxic for r in toxicity.score(docs, chain, keep=["doc_id"]).collect()}
    assert all(hit[i] == t.startswith("vile") for i, t in enumerate(texts))
