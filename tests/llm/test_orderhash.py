import hashlib
import re
import struct

import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from custaris.llm import orderhash as oh


def h64(*parts):
    """Spark's xxhash64: each column hashed with the hash before it as the seed."""
    seed = 42
    for p in parts:
        data = p.encode() if isinstance(p, str) else struct.pack("<i" if isinstance(p, bool) else "<q", p) if not isinstance(p, I32) else struct.pack("<i", p)
        seed = xxhash.xxh64_intdigest(data, seed)
    return seed


class I32(int):
    """An int column (four bytes)."""


def brute(text):
    t = re.findall(r"[^\x20\x09-\x0D]{1,16}", text)
    if not t:
        return ""
    grams = [tuple((t[i + k] if i + k < len(t) else "\n") for k in range(oh.K)) for i in range(max(1, len(t) - oh.K + 1))]
    seen, ring = {}, []
    for place, g in enumerate(grams):
        h = h64(*g) >> (1 + oh._POS)
        o = seen.get(h, 0)
        seen[h] = o + 1
        ring.append((h64(h, I32(o)) >> (1 + oh._POS), place))
    ring.sort()
    out = []
    for j in range(oh.COMPONENTS):
        point = (j << oh._RING) // oh.COMPONENTS
        a = sum(r < point for r, _ in ring)
        got = sorted((ring[(a + k) % len(ring)][1], ring[(a + k) % len(ring)][0]) for k in range(oh.ELL))
        out.append(f"{h64(*[r for _, r in got]) >> 32:08x}")
    return "".join(out)


def near(a, b):
    if not a or not b:
        return float(a == b)
    return sum(a[k:k + 8] == b[k:k + 8] for k in range(0, len(a), 8)) / oh.COMPONENTS


def expected(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    out = {}
    for k, (i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1] or ""
        t = t or ""
        half = len(t) // 2
        edited = t[:len(t) - half] + nxt[:half]
        a, b, c = brute(t), brute(edited), brute(nxt)
        out[i] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), a, b, near(a, b), near(a, c))
    return out


def test_sample_table(spark, sample):
    got = {r[0]: tuple(r[1:]) for r in oh.op8_orderhash(spark, "/root/testdata/sf0.001").collect()}
    want = expected(list(zip(sample.doc_id, sample.text)))
    assert got == want
    mean = lambda k: sum(r[k] for r in got.values()) / len(got)
    assert mean(4) > 0.05 and mean(4) > 5 * mean(5)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="ab \n.é", max_size=40), min_size=1, max_size=6))
def test_odd_texts(spark, docs_of, texts):
    rows = [(3 * i - 5, t) for i, t in enumerate(texts)]
    got = {r[0]: tuple(r[1:]) for r in oh.edited_pairs(docs_of([(i, t, "en", "s", 0) for i, t in rows])).collect()}
    assert got == expected(rows)


def test_order_matters(spark):
    w = [f"w{k}" for k in range(200)]
    swapped = w[100:] + w[:100]
    d = spark.createDataFrame([(" ".join(w), " ".join(swapped))], "a string, b string")
    r = d.select(oh.likeness(oh.fingerprint(F.col("a")), oh.fingerprint(F.col("b")))).first()[0]
    assert 0.3 < r < 0.75            # the same k-mers but two, half of the pairs turned round


def test_nulls_repeats_and_empty(docs_of):
    rows = [(None, "x y", None, None, None), (1, None, None, None, None), (2, "a b c d", "en", "s", 1), (2, "a b c d", "en", "s", 1), (2, "q", "en", "s", 1)]
    out = oh.edited_pairs(docs_of(rows)).collect()
    assert len(out) == 5 and len({r.fingerprint for r in out if r.n_chars == 7}) == 1
    assert sorted(r.near_next for r in out if r.n_chars == 7)[-1] == 1.0
    assert oh.edited_pairs(docs_of([])).count() == 0
    one = oh.edited_pairs(docs_of([(1, "a b c", "en", "s", 1)])).first()
    assert one.near_next == 1.0
