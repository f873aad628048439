import hashlib

import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from custaris.llm import pieces

PATH = pieces.default_model()
LIB = sentencepiece.SentencePieceProcessor(model_file=PATH)
M = pieces.PieceModel(PATH)


def same(text):
    ids, decoded = M.encode_decode(text)
    want = LIB.encode(text)
    assert [int(x) for x in ids.split(",")] if ids else [] == want, text
    assert ids == ",".join(map(str, want))
    assert decoded == LIB.decode(want)
    M.check()


def test_odd_texts():
    for t in ["", " ", "  ", "a", " a  b\n c▁d\te", "ﬁ é 　 x y \x00 z", "<s> </s> <unk> <0x41>", "▁", "\n\n",
              "a" * 3000, "\U0001f600\U0001f600 你好", "x   ", "   x", "###&&& $$$", "a▁ b"]:
        same(t)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    same(text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abth e\n.,▁éß1", max_size=80))
def test_close_alphabet(text):
    same(text)


def test_query_whole_table(spark, sample):
    got = {r.doc_id: r for r in pieces.op7_pieces(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(sample)
    for i, t in zip(sample.doc_id, sample.text):
        ids = LIB.encode(t)
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(LIB.decode(ids).encode()).hexdigest()


def test_nulls_repeats_clashes_and_empty(spark, docs_of):
    rows = [(1, None, None, None, None), (None, "a b", "en", "s", 3), (2, "a b", "en", "s", 3), (2, "a b", "en", "s", 3)]
    d = docs_of(rows).withColumnRenamed("n_chars", "piece_text")
    out = pieces.encode_decode(d, PATH).collect()
    assert [(r.doc_id, r.piece_text) for r in sorted(out, key=lambda r: (r.doc_id is not None, r.doc_id))] == [
        (None, "a b"), (1, ""), (2, "a b"), (2, "a b")]
    assert pieces.encode_decode(docs_of([]), PATH).count() == 0
