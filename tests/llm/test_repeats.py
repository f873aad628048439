import hashlib
import random

from custaris.llm import repeats


def brute(texts):
    """Count every 200-byte string; cover those met twice."""
    seen = {}
    raw = [(t or "").encode() for t in texts]
    for t in raw:
        for k in range(len(t) - 199):
            s = t[k:k + 200]
            seen[s] = seen.get(s, 0) + 1
    out = []
    for t in raw:
        gone = bytearray(len(t))
        for k in range(len(t) - 199):
            if seen[t[k:k + 200]] > 1:
                gone[k:k + 200] = b"\1" * 200
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out.append((len(t), sum(gone), sum(g and (not k or not gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return out


def make(seed=1, n=60):
    r = random.Random(seed)
    letters = "abcdefghij klmnop"
    word = lambda m: "".join(r.choice(letters) for _ in range(m))
    passages = [word(m) for m in (199, 200, 201, 260, 400, 1500)]
    texts = [None, "", "x" * 150, "y" * 450, "ab" * 300, word(500)]
    texts.append(texts[-1])
    for _ in range(n):
        t = word(r.randrange(0, 300))
        for _ in range(r.randrange(0, 4)):
            p = r.choice(passages)
            a = r.randrange(0, 40)
            t += p[a:len(p) - r.randrange(0, 40)] + word(r.randrange(0, 300)) + "é"
        texts.append(t)
    return texts


def run(docs_of, texts, ids=None):
    rows = [(ids[i] if ids else i, t, "en", "s", 0) for i, t in enumerate(texts)]
    out = repeats.dedup(docs_of(rows)).collect()
    return sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out)


def test_brute_force(docs_of):
    texts = make()
    assert run(docs_of, texts) == [(i, *w) for i, w in enumerate(brute(texts))]


def test_hot_grams_take_the_counting_path(docs_of, monkeypatch):
    monkeypatch.setattr(repeats, "HOT_GRAM", 1)
    texts = make(7, 40)
    assert run(docs_of, texts) == [(i, *w) for i, w in enumerate(brute(texts))]


def test_long_texts_in_pieces_have_the_same_anchors(monkeypatch):
    texts = [(t or "").encode() for t in make(5, 20)]
    want = set(zip(*[x.tolist() for x in repeats.text_anchors(texts)]))
    monkeypatch.setattr(repeats, "PIECE", 700)
    assert set(zip(*[x.tolist() for x in repeats.text_anchors(texts)])) == want


def test_equal_ids_and_nulls(docs_of):
    t = make(3, 0)[5]
    texts = [t, t, t + "z", None, "short"]
    ids = [1, 1, 1, None, None]
    want = sorted((i if i is not None else -1, *w) for i, w in zip(ids, brute(texts)))
    assert run(docs_of, texts, ids) == want
    assert run(docs_of, []) == []


def test_sample_table(spark, sample):
    got = {r.doc_id: r for r in repeats.op6_repeats(spark, "/root/testdata/sf0.001").collect()}
    for i, w in zip(sample.doc_id, brute(sample.text)):
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == w
