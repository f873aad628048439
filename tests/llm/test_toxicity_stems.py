from collections import Counter

import pytest

from custaris.llm import toxicity


def test_stems_count_different_words():
    got = toxicity.features(Counter({"réeuxpa".encode(): 5, "réeuxré".encode(): 1, "réeu".encode(): 1, b"ab": 2, b"": 1}))
    stem = "réeu".encode()
    assert got == {"réeuxpa".encode(), "réeuxré".encode(), stem, b"ab", stem + b" 1", stem + b" 2"}


@pytest.mark.parametrize("fitted", [0, 1])
def test_held_out_recall_by_language(spark, fitted):
    """Fitted on half of the ids, the chain finds toxic documents of every language in the other half."""
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    lab = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    chain = toxicity.fit(d.where(f"doc_id % 2 = {fitted}"), lab)
    held = d.where(f"doc_id % 2 <> {fitted}").join(lab.select("doc_id", "toxic"), "doc_id")
    x = toxicity.score(held, chain, keep=["lang", "toxic"]).toPandas()
    recall = x[x.toxic == 1].groupby("lang").is_toxic.mean()
    print(x.groupby(["lang", "toxic"]).is_toxic.agg(["sum", "count"]))
    assert (recall > 0.7).all() and set(recall.index) == {"de", "en", "es", "fr"}
    assert x[x.toxic == 0].is_toxic.mean() < 0.01
