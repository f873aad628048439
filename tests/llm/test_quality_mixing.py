import re
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from custaris.llm import mixing, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    tri = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    c = Counter(tri)
    hit = {i + k for i, t in enumerate(tri) if c[t] > 1 for k in range(3)}
    return (len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in text), len(lines) - len(set(lines)), len(hit))


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text(alphabet="ab \n#é\t", max_size=60), min_size=1, max_size=12))
def test_counts(docs_of, texts):
    d = docs_of([(i, t, "en", "s", 0) for i, t in enumerate(texts)])
    got = {r.doc_id: tuple(r.c) for r in quality.features(d).select("doc_id", F.struct(*[F.col(f"__q.{n}") for n in NAMES]).alias("c")).collect()}
    assert got == {i: counts(t) for i, t in enumerate(texts)}


def test_rules_drop_junk_and_keep_clean(docs_of):
    clean = [(i, " ".join(f"word{(i * 7 + k * k) % 997}" for k in range(80)), "en", f"s{i % 2}", 0) for i in range(500)]
    junk = [(1000, " ".join(f"w{k}ab###" for k in range(80)), "en", "s0", 0), (1001, "same line of words here\n" * 30, "en", "s0", 0), (1002, "few words", "en", "s1", 0)]
    d = docs_of(clean + junk + [(1003, None, None, None, None)])
    kept = {r.doc_id for r in quality.filter_documents(d).collect()}
    assert kept == {i for i, *_ in clean}
    assert quality.filter_documents(docs_of([])).count() == 0
    assert quality.filter_documents(d).columns == d.columns


def test_small_groups_use_merged_sketches(docs_of):
    """A group of one takes its language's fences; an own language takes those of all."""
    clean = [(i, " ".join(f"word{(i * 7 + k * k) % 997}" for k in range(80)), "en", "s", 0) for i in range(300)]
    lone = [(900, clean[0][1], "en", "new", 0), (901, clean[1][1].replace("word", "w###"), "en", "new", 0), (902, clean[2][1], None, None, 0)]
    kept = {r.doc_id for r in quality.filter_documents(docs_of(clean + lone)).collect()}
    assert {900, 902} <= kept and 901 not in kept


def test_targets():
    """Shares by weight, stopped at three sizes, the excess reshared."""
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    sizes = {"a": 10, "b": 500, "c": 300, "d": 40, None: 150}
    got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()}
    weight = dict(zip(["a", "b", "c", "d", None], [5, 2, 1, 5, 2]))
    want, open_ = {}, set(sizes)
    total = float(sum(sizes.values()))
    while True:
        left = total - sum(want.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            want |= share
            break
        for s in over:
            want[s] = 3.0 * sizes[s]
        open_ -= over
    assert {s: round(v, 6) for s, v in got.items()} == {s: round(v, 6) for s, v in want.items()}


def test_mix_near_targets_and_reruns_agree(spark):
    a = mixing.op10_mixing(spark, "/root/testdata/sf0.01").collect()
    b = mixing.op10_mixing(spark, "/root/testdata/sf0.01").collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))
    d = {r.doc_id: r.source for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "source").collect()}
    taken, target, size = defaultdict(int), {}, defaultdict(int)
    for r in a:
        taken[d[r.doc_id]] += r.taken
        size[d[r.doc_id]] += r.size
        target[d[r.doc_id]] = r.target
        assert r.taken <= 3 * r.size
    largest = max(r.size for r in a)
    for s in target:
        assert abs(taken[s] - target[s]) < 0.12 * target[s] + largest
        assert target[s] <= 3 * size[s]
    assert abs(sum(target.values()) - sum(size.values())) < 1


def test_copies_nulls_repeats_and_empty(docs_of):
    rows = [(None, "a b", None, None, None), (1, None, None, "s", 0), (1, "a b c", None, "s", 0), (1, "a b c", None, "s", 0), (2, "", "en", "s", 0)]
    d = docs_of(rows).withColumnRenamed("n_chars", "mix_copies")
    m = mixing.mix(d).collect()
    assert len(m) == 5 and all(0 <= r.mix_copies <= 3 for r in m)
    assert mixing.emit(mixing.mix(docs_of(rows))).columns == docs_of(rows).columns
    assert mixing.emit(mixing.mix(docs_of(rows))).count() == sum(r.mix_copies for r in mixing.mix(docs_of(rows)).collect())
    assert mixing.mix(docs_of([])).count() == 0
