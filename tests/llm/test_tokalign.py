import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from custaris.llm import tokalign as K


@pytest.fixture(scope="module")
def both():
    import sentencepiece
    from tokenizers import Tokenizer
    a, b = K.default_paths()
    t = Tokenizer.from_file(a)
    t.encode_special_tokens = True
    return t, sentencepiece.SentencePieceProcessor(model_file=b)


def piece_bytes(sp, i):
    p = sp.id_to_piece(i)
    return bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode()


def level_bytes(t, i, table):
    return bytes(table[c] for c in t.id_to_token(i))


def brute(rows, both):
    """The contract by sets of byte ends."""
    t, sp = both
    table = K._byte_of()
    docs, pairs = [], Counter()
    for d, text, *_ in rows:
        a = t.encode(" " + text, add_special_tokens=False).ids if text else []
        b = sp.encode(text) if text else []
        ba, bb = [level_bytes(t, i, table) for i in a], [piece_bytes(sp, i) for i in b]
        if not text or b"".join(ba) != (" " + text).encode() or b"".join(bb) != (" " + text).encode():
            a, b, ba, bb = [], [], [], []
        ends = []
        for parts in (ba, bb):
            at, e = 0, []
            for p in parts:
                at += len(p)
                e.append(at)
            ends.append(e)
        shared = sorted(set(ends[0]) & set(ends[1]))
        groups, links, low = [], [], 0
        for s in shared:
            ga = [i for i, e in zip(a, ends[0]) if low < e <= s]
            gb = [i for i, e in zip(b, ends[1]) if low < e <= s]
            groups.append(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)))
            links.append((ga[-1], gb[-1]))
            low = s
        pairs.update(links)
        docs.append((d, len(a), len(b), groups, links))
    best = {}
    for (x, y), n in pairs.items():
        best[y] = max(best.get(y, 0), n)
    return sorted([(d, na, nb, len(g), len(li), sum(pairs[p] == best[p[1]] for p in li), sum(pairs[p] for p in li),
                    hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for d, na, nb, g, li in docs], key=str)


def rows_of(df):
    return sorted([tuple(r) for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()], key=str)


HARD = ["", " ", "  two  spaces ", "tab\tand\nline\n\n  x", "ünïcödé naïve 日本語のテキスト 😀🏳️‍🌈 é", "▁ already marked", "a▁b", "<|endoftext|> plain <s> </s> <unk>",
        "x" * 3000, " " * 500, "1234567890 " * 30, "don't we're I'll", " nbsp em", "\x00\x1f control", "same same same same", "ſtrange ﬁ ligature Ａ"]


def soup(rng):
    return "".join(rng.choice([" ", "  ", "the", " of", "ing", "é", "日本", "\n", "Foo", "123", ".", "😀", "ß", "\t", "'s", "antidis"]) for _ in range(rng.randint(1, 60)))


def test_brute_force(spark, folder_of, both):
    rng = random.Random(11)
    texts = [None, *HARD, *[soup(rng) for _ in range(120)]]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)] + [(3, "same same", "en", "s", 1)] * 3 + [(None, "no id", None, None, None)]
    assert rows_of(K.op11_alignment(spark, folder_of(rows))) == brute(rows, both)


def test_test_table(spark, both, sample):
    rows = list(zip(sample.doc_id.tolist(), sample.text))
    assert rows_of(K.op11_alignment(spark, "/root/testdata/sf0.001")) == brute(rows, both)


def test_rare_pairs_are_joined(spark, docs_of, both, sample):
    rows = [(int(d), t, "en", "s", 1) for d, t in zip(sample.doc_id[:40], sample.text[:40])]
    got = K.compare(docs_of(rows), *K.default_paths(), keep=["doc_id"], digests=True, common=50)
    assert rows_of(got) == brute(rows, both)


def test_segments_change_nothing(both):
    rng = random.Random(4)
    v = K.Pair(*K.default_paths())
    for _ in range(60):
        text = soup(rng) * 3
        parts = K.segments(text, 5)
        assert " ".join(parts) == text
        a, b = [], []
        for p in parts:
            a += v.a.encode_ordinary(" " + p)
            b += v.b.encode(p)
        assert a == v.a.encode_ordinary(" " + text) and b == v.b.encode(text)


@pytest.mark.parametrize("text", ["a" * 300_000, " " * 300_000, "word " * 200_000, "é" * 200_000])
def test_very_long_texts(text):
    v = K.vocabularies(*K.default_paths())
    counts, said, pairs = K._aligned(v, [text], False)
    assert counts[0, 2] == said[0].count(";") + 1 == sum(p["n"].as_py() for p in pairs.values)
    back = b"".join(v.a_bytes[int(i)] for g in said[0].split(";") for i in g.split("|")[0].split(","))
    assert back == b" " + text.encode()


def test_memory_starts_anew(monkeypatch, sample):
    texts = sample.text[:30].tolist()
    v = K.Pair(*K.default_paths())
    want = K._aligned(v, texts, True)
    monkeypatch.setattr(K, "REMEMBERED", 7)
    got = K._aligned(K.Pair(*K.default_paths()), texts, True)
    assert (want[0] == got[0]).all() and want[1] == got[1] and want[2].equals(got[2])


def test_tokens_falling_together_are_told_apart(sample, monkeypatch):
    """The windows' mixed key may collide: an exact comparison follows."""
    v = K.Pair(*K.default_paths())
    texts = sample.text[:10].tolist()
    want = K._aligned(v, texts, True)[1]
    monkeypatch.setattr(K, "_mixed", lambda x, y: (x + y) % K.np.uint64(3))
    assert K._aligned(K.Pair(*K.default_paths()), texts, True)[1] == want


def test_empty_table_clashing_columns_and_groups(spark, folder_of, docs_of):
    assert K.op11_alignment(spark, folder_of([])).count() == 0
    d = docs_of([(1, "the cat", "en", "s", 7)]).withColumn("pairs", F.lit(1)).withColumn("n_a", F.lit("x")).withColumn("n_best", F.lit(3)).withColumn("pair", F.lit(9))
    got = K.compare(d, *K.default_paths())
    assert got.columns.count("n_a") == 1 and got.columns.count("n_best") == 1
    (r,) = got.collect()
    assert (r.pair, r.n_chars, r.n_a, r.n_groups) == (9, 7, 2, 2) and r.groups.count("|") == 2
