"""Thresholds come from each group's own sketch: against quantiles worked out by hand, and they move with the group."""

import math

import pytest

from custaris.llm import quality

G = math.log(1.02)


def text(i, n=120, lens=(3, 4, 5, 6), symbols=0, repeats=0):
    words = [("abcdefghij"[(i + k) % 10] * lens[(i * 7 + k) % len(lens)]) + str(1000 + (i * 31 + k) % 8999) for k in range(n)]
    words[:symbols] = ["#" + w for w in words[:symbols]]
    return " ".join(words + words[:repeats])


def bucketed(v):
    return 0.0 if v <= 0 else math.exp(math.ceil(math.log(v) / G) * G)


def quantile(values, pc):
    v = sorted(values)
    return bucketed(v[math.ceil(len(v) * pc / 100) - 1])


def by_hand(rows):
    """High thresholds of one group of 200 documents or more, and the low one of the word length."""
    out = {}
    for k, (lo, hi, times, _, two) in quality.RULES.items():
        x = [r[k] for r in rows]
        a, b = quantile(x, lo), quantile(x, hi)
        out[f"{k}_hi"] = b + times * (b - a)
        if two:
            out[f"{k}_lo"] = a - times * (b - a)
    return out


def make():
    prose = [(i, text(i), "en", "prose", 0) for i in range(300)]
    code = [(1000 + i, text(i, symbols=20 + i % 30, repeats=i % 25), "en", "code", 0) for i in range(300)]
    long = [(2000 + i, text(i, lens=(6, 9, 12, 15)), "de", "prose", 0) for i in range(250)]
    return prose + code + long


def test_thresholds_by_hand_and_by_group(spark, docs_of):
    d = quality.features(docs_of(make())).select("doc_id", "lang", "source", "__q.*")
    rows = d.select("doc_id", "lang", "source", *[v.alias(k) for k, v in quality.ratios().items()]).collect()
    got = {(r["__tl"], r["__ts"]): r.asDict() for r in quality.thresholds(d).collect()}
    assert len(got) == 3
    for (lang, source), t in got.items():
        group = [r for r in rows if (r["lang"], r["source"]) == (lang, source)]
        for k, want in by_hand(group).items():
            assert t[f"__t_{k}"] == pytest.approx(want, rel=1e-9, abs=1e-12)
    assert got[("en", "code")]["__t_symbol_share_hi"] > 0.5 > got[("en", "prose")]["__t_symbol_share_hi"]
    assert got[("de", "prose")]["__t_word_len_hi"] > got[("en", "prose")]["__t_word_len_hi"] + 2


def test_the_same_text_is_judged_by_its_group(docs_of):
    """Forty symbols in 120 words are usual among code and unheard of among prose."""
    odd = text(7, symbols=40)
    few = text(8, symbols=9)
    docs = make() + [(5000, odd, "en", "code", 0), (5001, odd, "en", "prose", 0), (5002, few, "en", "prose", 0),
                     (5003, few, "en", "prose", 0)]
    kept = {r.doc_id for r in quality.filter_documents(docs_of(docs)).collect()}
    assert 5000 in kept and 5001 not in kept and {5002, 5003} <= kept
    assert len([i for i in kept if i < 5000]) == len(make())


def test_short_texts_may_stray_further(docs_of):
    rows = [(i, text(i, n=400), "en", "s", 0) for i in range(300)]
    stray = [(900, text(3, n=52, lens=(6, 6, 6, 7)), "en", "s", 0), (901, text(3, n=4000, lens=(9, 10, 11, 12)), "en", "s", 0)]
    kept = {r.doc_id for r in quality.filter_documents(docs_of(rows + stray)).collect()}
    assert 901 not in kept and set(range(300)) <= kept


def test_clashing_columns_and_repeated_rows(spark, docs_of):
    from pyspark.sql import functions as F
    d = docs_of(make()[:300] + make()[:1])
    wide = d.withColumn("n_words", F.lit("mine")).withColumn("kept", F.lit("x")).withColumn("__t_word_len_hi", F.lit(1.0))
    out = quality.filter_documents(wide)
    assert out.columns == wide.columns
    got = out.collect()
    assert len(got) == 301 and {r.n_words for r in got} == {"mine"} and sum(r.doc_id == 0 for r in got) == 2
