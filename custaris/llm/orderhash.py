"""Document fingerprints by Order MinHash (DataFrame only).

A text's tokens are its words, runs of ``[^\\x20\\x09-\\x0D]``.  A word of up to ``K * 16`` characters is cut every 16
characters, so an edit inside shifts no more than ``K`` tokens.  A longer one (a text without spaces, a long URL, base64)
gives the ``WINDOW`` characters from each of its characters on, overlapping, so that tokens line up again right after an
edit.  The k-mers are ``K`` tokens in a row (fewer tokens: one k-mer of all).  Each k-mer is numbered by its occurrence,
so repeats count, and (k-mer, occurrence) is hashed to a place on a ring.  A component of the fingerprint starts at a
fixed point of the ring, takes the ``ELL`` next numbered k-mers, puts them back into text order and hashes the tuple.
Two texts agree in a component if they share the least numbered k-mers there and have them in the same order, so
likeness falls with edits and with reordering.

Everything is a built-in expression over the row's own arrays: no text is exploded, and nothing but the next document's
prefix and fingerprint crosses the shuffle.

Defined results: null text is empty; a text without words has the empty fingerprint; likeness of two empty fingerprints
is 1, of an empty and another 0; the next document of the last is the first, of the only one itself; rows are ordered by
id, equal ids by a hash of the text, equal rows anyhow, null ids first; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.joins import bounded_broadcast
from .common import documents, let, materialize

K = 3
ELL = 2
COMPONENTS = 64
SPLITS = 1024              # ranges of ids for the order of documents
WINDOW = 8                 # characters of a token of a long word
_CHAR = r"[^\x20\x09-\x0D]"
_TOKEN = rf"({_CHAR}{{1,16}})"
_LONG = rf"{_CHAR}{{{K * 16 + 1}}}"
_WINDOW = rf"(?=({_CHAR}{{1,{WINDOW}}})){_CHAR}"
_POS = 24                  # low bits for the place in the text; longer texts wrap, which only blurs their order
_RING = 63 - _POS          # high bits for the place on the ring
_MASK = (1 << _POS) - 1


def _longs(values) -> Column:
    return F.array(*[F.lit(v).cast("long") for v in values])


def tokens(text: Column) -> Column:
    """Array of the tokens of ``text``, in text order."""
    found = lambda t, pattern: F.regexp_extract_all(t, F.lit(pattern), F.lit(1))
    by_word = F.flatten(F.transform(found(text, f"({_CHAR}+)"), lambda w: F.when(w.rlike(_LONG), found(w, _WINDOW)).otherwise(found(w, _TOKEN))))
    return F.when(text.rlike(_LONG), by_word).otherwise(found(text, _TOKEN))


def fingerprint(text: Column) -> Column:
    """Array of COMPONENTS 32-bit hashes of ``text``; empty without words."""
    points = _longs([((j << _RING) // COMPONENTS) << _POS for j in range(COMPONENTS)])
    high = lambda h: F.shiftleft(F.shiftrightunsigned(h, 1 + _POS), _POS)
    low = lambda x: x.bitwiseAND(F.lit(_MASK))

    def kmers(t):
        n = F.greatest(F.size(t) - (K - 1), F.lit(1))
        return F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(*[
            F.coalesce(F.try_element_at(t, i + k), F.lit("\n")) for k in range(K)]))

    def sorted_kmers(h):
        """High bits of the k-mer's hash, low bits its place; equal k-mers stand together in text order."""
        return F.sort_array(F.transform(h, lambda x, i: high(x).bitwiseOR(low(i.cast("long")))))

    def occurrences(s):
        """0, 1, .. within each run of equal k-mers of the sorted array."""
        head = lambda i: F.shiftright(F.element_at(s, i), _POS)
        starts = F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: (i == 1) | (head(i) != head(F.greatest(i - 1, F.lit(1)))))

        def runs(st):
            after = F.concat(F.slice(st, 2, F.size(st)), F.array(F.size(s) + 1))
            return F.flatten(F.zip_with(st, after, lambda a, b: F.sequence(F.lit(0), b - a - 1)))
        return let(starts, lambda st: F.when(F.size(st) == F.size(s), F.array_repeat(F.lit(0), F.size(s))).otherwise(runs(st)))

    def ring(s, occ):
        """High bits: place of (k-mer, occurrence) on the ring; low bits: place in the text."""
        return F.sort_array(F.zip_with(s, occ, lambda x, o: high(F.xxhash64(F.shiftright(x, _POS), o)).bitwiseOR(low(x))))

    def component(r, at):
        """Hash of the ELL elements of the ring from index ``at`` on, in text order."""
        got = F.sort_array(F.array(*[let(F.element_at(r, (F.pmod(at + k, F.size(r)) + 1).cast("int")), lambda x: F.struct(
            low(x).alias("p"), F.shiftright(x, _POS).alias("h"))) for k in range(ELL)]))
        return let(got, lambda g: F.shiftright(F.xxhash64(*[g[k]["h"] for k in range(ELL)]), 32).cast("int"))

    def components(r):
        # sorted in among the elements, the j-th point at index i has i - j elements before it
        return let(F.sort_array(F.concat(r, points)), lambda both: F.transform(
            points, lambda p, j: component(r, F.array_position(both, p).cast("int") - 1 - j)))

    return let(tokens(text), lambda t: F.when(F.size(t) == 0, F.array().cast("array<int>")).otherwise(
        let(kmers(t), lambda h: let(sorted_kmers(h), lambda s: let(occurrences(s), lambda o: let(ring(s, o), components))))))


def spell(fp: Column) -> Column:
    """The fingerprint as hexadecimal text, 8 digits a component."""
    return F.array_join(F.transform(fp, lambda x: F.lpad(F.lower(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal components."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when(
        (F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(same.cast("double") / F.lit(float(COMPONENTS)))


def neighbours(ids: DataFrame) -> DataFrame:
    """``ids`` with next_did, next_th, next_nth along (did, th, nth); the last row's next is the first.

    Ids go to at most SPLITS ranges by approximate quantiles; windows run within a range, and one row a range links on.
    """
    cut = ids.agg(F.percentile_approx("did", [k / SPLITS for k in range(1, SPLITS)], 20 * SPLITS)).first()[0] or []
    cut = sorted(set(cut))
    part = F.size(F.filter(F.array(*[F.lit(c) for c in cut]), lambda c: c < F.col("did"))) if cut else F.lit(0)
    x = ids.withColumn("part", part)
    key = F.struct("did", "th", "nth")
    w = Window.partitionBy("part").orderBy("did", "th", "nth")
    x = x.withColumn("next", F.lead(key).over(w))
    heads = x.groupBy("part").agg(F.min(key).alias("head"))              # one row a range
    link = heads.select("part", F.coalesce(F.lead("head").over(Window.orderBy("part")),
                                           F.min("head").over(Window.partitionBy())).alias("link"))
    x = x.join(bounded_broadcast(link, SPLITS), "part")
    nxt = F.coalesce("next", "link")
    return x.select(*ids.columns, nxt["did"].alias("next_did"), nxt["th"].alias("next_th"), nxt["nth"].alias("next_nth"))


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row: id, n_chars, edited_sha256, both fingerprints, likeness to the edited and to the next text.

    One shuffle of the texts by key serves both sides: the lender of a prefix and the row that is edited.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("did"),
                    F.xxhash64(text).alias("th"))
    fp = materialize(d.select("did", "th", "doc_id", F.char_length("text").alias("n_chars"), fingerprint(F.col("text")).alias("fp")), "prints")
    # rows that agree in id and text are numbered, so that each has its own place in the order
    copies = fp.groupBy("did", "th").agg(F.count("*").alias("c"), F.first("n_chars").alias("n_chars"), F.first("doc_id").alias("doc_id"))
    order = materialize(neighbours(materialize(copies.select(
        "did", "th", "n_chars", "doc_id", F.explode(F.sequence(F.lit(1), F.col("c").cast("int"))).alias("nth")), "ids")), "order")
    fp = fp.select("did", "th", "fp").repartition("did", "th").dropDuplicates(["did", "th"])
    texts = d.select("did", "th", "text").repartition("did", "th").dropDuplicates(["did", "th"])
    want = order.groupBy(F.col("next_did").alias("did"), F.col("next_th").alias("th")).agg(F.collect_list(F.struct(
        F.col("did").alias("to_did"), F.col("th").alias("to_th"), "doc_id", F.floor(F.col("n_chars") / 2).cast("int").alias("half"))).alias("w"))
    lent = texts.join(want, ["did", "th"]).join(fp, ["did", "th"]).select("text", F.col("fp").alias("next_fp"), F.explode("w").alias("w"))
    lent = lent.select(F.col("w.to_did").alias("did"), F.col("w.to_th").alias("th"), "w.doc_id", "w.half", F.expr("left(text, w.half)").alias("lent"), "next_fp")
    out = lent.join(texts, ["did", "th"]).join(fp, ["did", "th"]).select(
        "doc_id", F.char_length("text").cast("long").alias("n_chars"), "fp", "next_fp",
        F.expr("concat(left(text, char_length(text) - half), lent)").alias("edited"))
    made = let(F.col("edited"), lambda e: let(fingerprint(e), lambda q: F.struct(
        F.sha2(e, 256).alias("edited_sha256"), spell(F.col("fp")).alias("fingerprint"), spell(q).alias("edited_fingerprint"),
        likeness(F.col("fp"), q).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"))))
    return out.select("doc_id", "n_chars", made.alias("z")).select("doc_id", "n_chars", "z.*")


def op8_orderhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return edited_pairs(documents(spark, sf_dir))
