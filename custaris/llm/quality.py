"""Quality rules with adaptive thresholds (DataFrame only).

Per (language, source) each ratio is summarised by a mergeable quantile sketch: counts in logarithmic buckets
(``ceil(ln v / ln 1.02)``, zero apart), about 1 % relative error, merged by adding counts.  A threshold is the upper
quantile of the sketch plus a multiple of the distance between two of its quantiles (``RULES``: which quantiles, how
many distances); no cutoff is a fixed number.  Groups of under 200 documents take their language's merged sketch, small
languages that of all.  Each ratio is a count over the document's words or lines, so a document fails only if
its ratio less three standard errors of that count (its square root) exceeds the threshold: a short text may stray
further than a long one, and in a group without symbols, whose threshold is 0, nine are still let by.

Defined results: null or empty text has no words and fails the base rules; null language or source form groups of
their own; equal rows are separate documents; an empty table gives no rows; other columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import bounded_broadcast
from .common import SPACE_RE, WORD_RE, documents, let, materialize

GAMMA = 1.02
MIN_GROUP = 200
ZERO = -100000
#: ratio: (lower and upper quantile in percent, distances beyond them, denominator, low side too)
RULES = {"word_len": (25, 75, 6, "n_words", True), "symbol_share": (50, 90, 3, "n_words", False),
         "dup_line_share": (50, 95, 3, "n_lines", False), "repeat_share": (50, 90, 3, "n_words", False)}
ERRORS = 3     # standard errors of its own ratio that a document is allowed


def word_list(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE_RE, -1), "")


def repeat_words(words: Column) -> Column:
    """Words covered by three-word windows that occur twice or more, from an array of words."""
    def covered(tri):
        def marked(sp):
            twin = lambda s, i: ((i > 0) & (F.try_element_at(sp, i.cast("int"))["h"] == s["h"])) | (
                (i < F.size(sp) - 1) & (F.try_element_at(sp, (i + 2).cast("int"))["h"] == s["h"]))
            # try_element_at is 1-based: i is the neighbour before, i + 2 the one after; index 0 never evaluates alone
            pos = F.sort_array(F.transform(F.filter(sp, lambda s, i: F.when(i == 0, (F.size(sp) > 1) & (
                F.try_element_at(sp, F.lit(2))["h"] == s["h"])).otherwise(twin(s, F.greatest(i, F.lit(1))))),
                lambda s: s["p"]))
            return let(pos, lambda p: F.aggregate(
                F.zip_with(p, F.slice(p, 2, F.greatest(F.size(p), F.lit(1))),
                           lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3)))),
                F.lit(0), lambda acc, x: acc + x))
        pairs = F.sort_array(F.transform(tri, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(tri)) == F.size(tri), F.lit(0)).otherwise(let(pairs, marked))

    def windows(w):
        return F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.xxhash64(
            F.element_at(w, i), F.element_at(w, i + 1), F.element_at(w, i + 2)))
    return F.when(F.size(words) < 3, F.lit(0)).otherwise(let(words, lambda w: let(windows(w), covered)))


def features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with a struct column ``__q`` of counts."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD_RE))

    def counts(w, ln):
        return F.struct(
            F.size(w).cast("long").alias("n_words"), F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            (F.size(ln) - F.size(F.array_distinct(ln))).cast("long").alias("n_dup_lines"),
            repeat_words(w).cast("long").alias("n_repeat_words"), F.size(ln).cast("long").alias("n_lines"))
    return docs.withColumn("__q", let(word_list(text), lambda w: let(lines, lambda ln: counts(w, ln))))


def ratios() -> dict[str, Column]:
    n = F.col("n_words").cast("double")
    return {"word_len": F.col("word_chars") / n, "symbol_share": F.col("n_symbols") / n,
            "dup_line_share": F.col("n_dup_lines") / F.col("n_lines").cast("double"),
            "repeat_share": F.col("n_repeat_words") / n}


def sketch(counts: DataFrame) -> DataFrame:
    """(lang, source, metric, bucket, n) of documents that have words: the mergeable sketches."""
    bucket = lambda v: F.when(v <= 0, F.lit(ZERO)).otherwise(F.ceil(F.log(v) / F.lit(GAMMA_LN)).cast("int"))
    arr = F.array(*[F.struct(F.lit(k).alias("metric"), bucket(v).alias("bucket")) for k, v in ratios().items()])
    x = counts.where("n_words > 0").select("lang", "source", F.explode(arr).alias("x"))
    return x.groupBy("lang", "source", "x.metric", "x.bucket").agg(F.count("*").alias("n"))


GAMMA_LN = 0.01980262729617973     # ln 1.02


def _quantiles(sk: DataFrame, keys: list[str]) -> DataFrame:
    """keys + metric + total, q_lo, q_hi from merged bucket counts (buckets of a group are bounded by the value range)."""
    m = sk.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))
    arr = F.sort_array(F.collect_list(F.struct("bucket", "n")))
    g = m.groupBy(*keys, "metric").agg(F.sum("n").alias("total"), arr.alias("b"))

    def percent(at):
        return F.coalesce(*[F.when(F.col("metric") == k, F.lit(r[at])) for k, r in RULES.items()])

    def quantile(pc):
        hit = F.aggregate("b", F.struct(F.lit(0).cast("long").alias("c"), F.lit(None).cast("int").alias("k")),
                          lambda a, x: F.struct((a["c"] + x["n"]).alias("c"), F.when(
                              a["k"].isNull() & ((a["c"] + x["n"]) * 100 >= F.col("total") * pc), x["bucket"]).otherwise(a["k"]).alias("k")))
        k = hit["k"]
        return F.when(k == ZERO, F.lit(0.0)).otherwise(F.exp(k * F.lit(GAMMA_LN)))
    return g.select(*keys, "metric", "total", quantile(percent(0)).alias("q_lo"), quantile(percent(1)).alias("q_hi"))


def _levels(q: DataFrame, keys: list[str], tag: str) -> DataFrame:
    """One row a group: its documents and, for every ratio, both quantiles."""
    out = []
    for k in RULES:
        here = F.col("metric") == k
        out += [F.max(F.when(here, F.col(c))).alias(f"{tag}_{k}_{c}") for c in ("q_lo", "q_hi")]
    return q.groupBy(*keys).agg(F.max("total").alias(f"{tag}_n"), *out)


def thresholds(counts: DataFrame) -> DataFrame:
    """(lang, source) with the thresholds that hold there; one row a group."""
    sk = materialize(sketch(counts), "sketch")
    own = _levels(_quantiles(sk, ["lang", "source"]), ["lang", "source"], "s")
    lang = _levels(_quantiles(sk, ["lang"]), ["lang"], "l").withColumnRenamed("lang", "__lang")
    every = _levels(_quantiles(sk, []), [], "a").first().asDict()     # one row of a few numbers
    t = own.join(lang, own["lang"].eqNullSafe(lang["__lang"]), "left")

    def pick(c):
        return F.coalesce(F.when(F.col("s_n") >= MIN_GROUP, F.col(f"s_{c}")), F.when(F.col("l_n") >= MIN_GROUP, F.col(f"l_{c}")),
                          F.lit(every[f"a_{c}"]).cast("double"))

    out = []
    for k, (_, _, times, _, two) in RULES.items():
        lo, hi = pick(f"{k}_q_lo"), pick(f"{k}_q_hi")
        out.append((hi + (hi - lo) * F.lit(float(times))).alias(f"__t_{k}_hi"))
        if two:
            out.append((lo - (hi - lo) * F.lit(float(times))).alias(f"__t_{k}_lo"))
    return t.select(F.col("lang").alias("__tl"), F.col("source").alias("__ts"), *out)


def judge(counts: DataFrame, limits: DataFrame | None = None) -> DataFrame:
    """``counts`` (with lang, source and the count columns) plus base_failed and kept; ``limits``: their thresholds."""
    t = bounded_broadcast(thresholds(counts) if limits is None else limits, 200_000)
    j = counts.join(t, counts["lang"].eqNullSafe(t["__tl"]) & counts["source"].eqNullSafe(t["__ts"]), "left")
    bad = F.lit(False)
    for k, v in ratios().items():
        stray = ERRORS * F.sqrt(v / F.col(RULES[k][3]).cast("double"))
        bad = bad | F.coalesce(v - stray > F.col(f"__t_{k}_hi"), F.lit(False))
        if RULES[k][4]:
            bad = bad | F.coalesce(v + stray < F.col(f"__t_{k}_lo"), F.lit(False))
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    j = j.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & F.when(F.col("n_words") > 0, ~bad).otherwise(F.lit(False)))
    return j.drop(*[c for c in t.columns])


def filter_documents(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with their columns; repeated rows stay repeated."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__d")
    x = features(docs.select(whole).select("__d", "__d.text", "__d.lang", "__d.source"), "text").select("__d", "lang", "source", "__q.*")
    # only the sketches are written between the two passes: texts are counted twice and never copied
    limits = materialize(thresholds(x.drop("__d")), "thresholds")
    return judge(x, limits).where("kept").select("__d.*")


def op5_quality(spark, sf_dir: str) -> DataFrame:
    """Counts, base rules and the adaptive verdict for every document."""
    d = features(documents(spark, sf_dir)).select("doc_id", "lang", "source", "__q.*")
    return judge(materialize(d, "quality")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_RATIO_SQL = {"word_len": "word_chars / n_words::DOUBLE", "symbol_share": "n_symbols / n_words::DOUBLE",
              "dup_line_share": "n_dup_lines / n_lines::DOUBLE", "repeat_share": "n_repeat_words / n_words::DOUBLE"}


def _oracle() -> str:
    sketch_sql = " UNION ALL ".join(
        f"SELECT lang, source, '{k}' AS metric, CASE WHEN {v} <= 0 THEN {ZERO} ELSE CAST(ceil(ln({v}) / {GAMMA_LN}) AS INT) END AS bucket "
        "FROM c WHERE n_words > 0" for k, v in _RATIO_SQL.items())

    pc = lambda at: "CASE metric " + " ".join(f"WHEN '{k}' THEN {r[at]}" for k, r in RULES.items()) + " END"

    def level(tag, keys):
        ks = "".join(f"{k}, " for k in keys)
        part = f"PARTITION BY {ks}metric"
        cols = ", ".join(f"max(CASE WHEN metric = '{k}' THEN {c} END) AS {k}_{c}" for k in RULES for c in ("q_lo", "q_hi"))
        group = f"GROUP BY {ks[:-2]}" if keys else ""
        return f"""
{tag}_b AS (SELECT {ks}metric, bucket, sum(n) AS n FROM sk GROUP BY {ks}metric, bucket),
{tag}_r AS (SELECT *, sum(n) OVER ({part} ORDER BY bucket) AS cum, sum(n) OVER ({part}) AS total FROM {tag}_b),
{tag}_k AS (SELECT {ks}metric, any_value(total) AS total, min(CASE WHEN cum * 100 >= total * ({pc(0)}) THEN bucket END) AS k_lo,
   min(CASE WHEN cum * 100 >= total * ({pc(1)}) THEN bucket END) AS k_hi FROM {tag}_r GROUP BY {ks}metric),
{tag}_q AS (SELECT *, CASE WHEN k_lo = {ZERO} THEN 0 ELSE exp(k_lo * {GAMMA_LN}::DOUBLE) END AS q_lo,
   CASE WHEN k_hi = {ZERO} THEN 0 ELSE exp(k_hi * {GAMMA_LN}::DOUBLE) END AS q_hi FROM {tag}_k),
{tag}_f AS (SELECT {ks}max(total) AS n, {cols} FROM {tag}_q {group})"""

    def at_level(c):
        return f"coalesce(CASE WHEN s_f.n >= {MIN_GROUP} THEN s_f.{c} END, CASE WHEN l_f.n >= {MIN_GROUP} THEN l_f.{c} END, a_f.{c})"

    pick, tests = [], []
    for k, (_, _, times, unit, two) in RULES.items():
        v, lo, hi = _RATIO_SQL[k], at_level(f"{k}_q_lo"), at_level(f"{k}_q_hi")
        pick.append(f"{hi} + ({hi} - {lo}) * {times}::DOUBLE AS {k}_hi")
        stray = f"{ERRORS} * sqrt(({v}) / {unit}::DOUBLE)"
        tests.append(f"coalesce(({v}) - {stray} > {k}_hi, false)")
        if two:
            pick.append(f"{lo} - ({hi} - {lo}) * {times}::DOUBLE AS {k}_lo")
            tests.append(f"coalesce(({v}) + {stray} < {k}_lo, false)")
    pick, bad = ", ".join(pick), " OR ".join(tests)
    return rf"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
   list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ln FROM t),
tri AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM tri) WHERE n > 1),
rep AS (SELECT rid, count(DISTINCT i + j) AS n FROM dup, (SELECT unnest([0, 1, 2]) AS j) GROUP BY rid),
c AS (SELECT t.rid, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
   CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
   CAST(len(ln) - len(list_distinct(ln)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, len(ln) AS n_lines
   FROM t JOIN w USING (rid) LEFT JOIN rep USING (rid)),
sk AS (SELECT lang, source, metric, bucket, count(*) AS n FROM ({sketch_sql}) GROUP BY ALL),
{level('s', ['lang', 'source'])},{level('l', ['lang'])},{level('a', [])},
th AS (SELECT s_f.lang, s_f.source, {pick} FROM s_f LEFT JOIN l_f ON s_f.lang IS NOT DISTINCT FROM l_f.lang LEFT JOIN a_f ON true),
v AS (SELECT c.*, n_words < 50 OR n_repeat_words * 100 > n_words * 50 AS base_failed,
   n_words > 0 AND NOT ({bad}) AS fine FROM c LEFT JOIN th ON c.lang IS NOT DISTINCT FROM th.lang AND c.source IS NOT DISTINCT FROM th.source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND fine AS kept FROM v
"""


ORACLE = _oracle()
