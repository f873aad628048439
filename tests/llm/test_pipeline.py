import corpus_pipeline as cp
import sentencepiece

from custaris.llm import mixing, pieces

from .test_neardup import brute as components
from .test_pii import brute as personal
from .test_quality_mixing import counts

LIB = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())


def make():
    text = lambda i, n=90: " ".join(f"word{(i * 31 + k * k * (i % 13 + 1)) % 1999}" for k in range(n))
    rows = [(i, text(i), "en" if i % 3 else "de", f"s{i % 3}", 500) for i in range(240)]
    rows += [(300 + i, text(i), "en", "s1", 500) for i in range(5)]                                   # copies
    rows += [(310 + i, text(i) + " added", "en", "s1", 500) for i in range(5)]                         # near copies
    rows += [(400, text(77) + " mail me.x@host.example.com", "en", "s0", 500), (401, "too short", "en", "s0", 9), (402, None, None, None, None)]
    rows += [(403, " ".join(w + "###" for w in text(501).split()), "en", "s0", 500), (404, text(502) + " call +1 (017) 555-7713", "en", "s2", 500)]
    return rows


def test_stages_against_brute_force(spark, docs_of):
    docs = docs_of(make())
    cols = docs.columns
    assert [len(cp.STAGES), callable(cp.run)] == [5, True]
    # 1 quality: base failures and junk go, clean stay
    one = cp.STAGES[0][1](spark, docs, None).collect()
    assert {r.doc_id for r in one} == {i for i, t, *_ in make() if t and counts(t)[0] >= 50 and "###" not in t}
    # 2 near-dedup
    two = cp.STAGES[1][1](spark, spark.createDataFrame(one, docs.schema), None).collect()
    root = components([(r.doc_id, r.text) for r in one])
    assert sorted(r.doc_id for r in two) == sorted({c for _, c in root.values()})
    # 3 redaction: no base span is left, other texts as they were
    three = cp.STAGES[2][1](spark, spark.createDataFrame(two, docs.schema), None).collect()
    before = {r.doc_id: r.text for r in two}
    for r in three:
        assert not personal(r.text) and r.n_chars == len(r.text)
        assert r.text == before[r.doc_id] or personal(before[r.doc_id])
    # 4 mixing: copies as the operator says, at most three
    d3 = spark.createDataFrame(three, docs.schema)
    four = cp.STAGES[3][1](spark, d3, None).collect()
    want = {r.doc_id: r.mix_copies for r in mixing.mix(d3).collect()}
    assert {i: n for i, n in want.items() if n} == {i: sum(r.doc_id == i for r in four) for i in {r.doc_id for r in four}}
    # 5 tokens
    five = cp.STAGES[4][1](spark, spark.createDataFrame(four, docs.schema), None).collect()
    assert len(five) == len(four)
    for r in five[:50]:
        assert r.piece_ids == LIB.encode(r.text) and r.piece_text == LIB.decode(r.piece_ids)
    for r in (one, two, three, four):
        assert list(r[0].asDict()) == cols


def test_run_and_empty(spark, folder_of):
    got = cp.run(spark, folder_of(make()))
    assert got.count() > 100 and {"doc_id", "text", "piece_ids", "piece_text"} <= set(got.columns)
    assert cp.run(spark, folder_of([])).count() == 0
