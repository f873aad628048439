"""Suffix-array dedup: removal of every byte covered by a 200-byte string that also starts anywhere else.

Sorting every suffix of a corpus would move each byte hundreds of times, so the suffixes sorted are those at anchors:
for each 200-byte string, the place of its least 64-byte gram by hash, leftmost on a tie.  The choice depends on the
string alone, so equal strings have their anchors at the same offset and meet under the same gram; no repeat is missed.
An anchor's context (136 bytes before it, 200 from it on) holds all strings that may have chosen it.

Anchors with equal contexts cover them wholly.  For a context that is unique although its gram is not, the forward
suffixes and the reversed prefixes of the gram's contexts are sorted by deep-shallow sorting (:mod:`suffixes`); a string
of offset ``o`` repeats where two contexts share ``200 - o`` bytes forward and ``o`` backward, which the two orders with
their common-prefix lengths tell for all offsets.  Grams with over ``HOT_GRAM`` different contexts, which one task should
not hold, count their strings' hashes by (gram, offset) in the shuffle instead.

Defined results: null text is empty; texts under 200 bytes lose nothing; rows are documents of their own, also with
equal ids, null ids or equal texts; an empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, materialize, slices
from .neardup import groups
from .suffixes import deep_shallow

LENGTH = 200
GRAM = 64
BACK = LENGTH - GRAM       # bytes of context before an anchor
PIECE = 900_000            # bytes of a text that are hashed at once
HOT_GRAM = 50_000
AT_ONCE = 100_000          # contexts sorted together

_MUL = 0x9E3779B97F4A7C15
_INV = pow(_MUL, -1, 1 << 64)
_BYTES = np.random.default_rng(11).integers(1, 2 ** 64, 256, dtype=np.uint64)
_LOW = np.uint64((1 << 20) - 1)


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


_UP = _powers(_MUL, (1 << 20) + 1)
_DOWN = _powers(_INV, (1 << 20) + 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def anchors(data: np.ndarray, first: np.ndarray, end: np.ndarray):
    """Anchors of texts laid end to end in ``data`` (under 2^20 bytes): place, gram hash, context hash, text number.

    ``first``, ``end``: bounds of the texts.  Strings that cross a bound don't count.
    """
    n = len(data)
    empty = np.zeros(0, np.int64)
    if n < LENGTH:
        return empty, empty.astype(np.uint64), empty.astype(np.uint64), empty
    h = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTES[data] * _UP[:n], out=h[1:])
    gram = _mix((h[GRAM:] - h[:-GRAM]) * _DOWN[:n - GRAM + 1])
    key = (gram & ~_LOW) | np.arange(len(gram), dtype=np.uint64)
    low, width = key, 1
    while width * 2 <= BACK + 1:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    rest = BACK + 1 - width
    if rest:
        low = np.minimum(low[:-rest], low[rest:])
    text = np.repeat(np.arange(len(first)), end - first)[:len(low)]
    place = (low & _LOW).astype(np.int64)[np.arange(len(low)) + LENGTH <= end[text]]
    place = place[np.append(True, place[1:] != place[:-1])] if len(place) else place
    of = np.searchsorted(first, place, side="right") - 1
    a, b = np.maximum(place - BACK, first[of]), np.minimum(place + LENGTH, end[of])
    ctx = _mix((h[b] - h[a]) * _DOWN[a]) ^ _mix((place - a).astype(np.uint64) * np.uint64(1009) + (b - place).astype(np.uint64))
    return place, gram[place], _mix(ctx), of


def text_anchors(texts: list[bytes]):
    """(text number, place, gram, context) arrays for whole texts; long ones go in overlapping pieces."""
    out, buf, size = [], [], 0

    def flush():
        nonlocal buf, size
        if buf:
            ln = np.array([len(texts[i]) for i in buf])
            end = np.cumsum(ln)
            p, g, c, of = anchors(np.frombuffer(b"".join([texts[i] for i in buf]), np.uint8), end - ln, end)
            out.append((np.array(buf)[of], p - (end - ln)[of], g, c))
        buf, size = [], 0
    for i, t in enumerate(texts):
        if len(t) < LENGTH:
            continue
        if len(t) > PIECE:
            found = []
            for a in range(0, len(t) - GRAM + 1, PIECE):        # anchors in a .. a + PIECE
                lo, hi = max(0, a - BACK - LENGTH), min(len(t), a + PIECE + 2 * LENGTH)
                d = np.frombuffer(t[lo:hi], np.uint8)
                p, g, c, _ = anchors(d, np.array([0]), np.array([len(d)]))
                inner = (p + lo >= a) & (p + lo < a + PIECE)
                found.append((p[inner] + lo, g[inner], c[inner]))
            p, g, c = (np.concatenate(x) for x in zip(*found))
            out.append((np.full(len(p), i), p, g, c))
            continue
        if size + len(t) > PIECE:
            flush()
        buf.append(i)
        size += len(t)
    flush()
    if not out:
        z = np.zeros(0, np.int64)
        return z, z, z.astype(np.uint64), z.astype(np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out))


def _raw(texts) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in texts]


def _find_anchors(batches):
    """Rows (did, th, place, gram, ctx, twice); of equal contexts in a batch all but one are settled (gram null)."""
    for b in slices(batches, limit=16 << 20):
        i, place, gram, ctx = text_anchors(_raw(b.column("text").to_pylist()))
        by = np.lexsort((ctx, gram))
        i, place, gram, ctx = i[by], place[by], gram[by], ctx[by]
        new = np.append(True, (gram[1:] != gram[:-1]) | (ctx[1:] != ctx[:-1])) if len(i) else np.zeros(0, bool)
        label = np.cumsum(new) - 1
        twice = np.bincount(label)[label] > 1 if len(i) else new
        take = pa.array(i)
        yield pa.RecordBatch.from_arrays([
            b.column("did").take(take), b.column("th").take(take), pa.array(place.astype(np.int32)), pa.array(gram.view(np.int64), mask=~new),
            pa.array(ctx.view(np.int64), mask=~new), pa.array(twice)], names=["did", "th", "place", "gram", "ctx", "twice"])


def _cut_contexts(batches):
    """Rows (gram, did, th, place, single, before, after) for the wanted places of texts."""
    for b in slices(batches):
        raw = _raw(b.column("text").to_pylist())
        take, gram, place, single, before, after = [], [], [], [], [], []
        for i, (t, want) in enumerate(zip(raw, b.column("want").to_pylist())):
            for w in want:
                p = w["place"]
                take.append(i)
                gram.append(w["gram"])
                place.append(p)
                single.append(w["single"])
                before.append(t[max(0, p - BACK):p])
                after.append(t[p:p + LENGTH])
        take = pa.array(take, pa.int64())
        yield pa.RecordBatch.from_arrays([
            pa.array(gram, pa.int64()), b.column("did").take(take), b.column("th").take(take), pa.array(place, pa.int32()),
            pa.array(single, pa.bool_()), pa.array(before, pa.binary()), pa.array(after, pa.binary())],
            names=["gram", "did", "th", "place", "single", "before", "after"])


def _padded(strings: list[bytes], width: int, reverse: bool = False) -> np.ndarray:
    s = [x[::-1] for x in strings] if reverse else strings
    return np.frombuffer(b"".join([x.ljust(width, b"\0") for x in s]), np.uint8).reshape(len(s), width)


def repeated_offsets(before: list[bytes], after: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest offset o (bytes before the anchor) of strings that two contexts share; -1 where none is."""
    n = len(before)
    la, ra = np.array([len(x) for x in before]), np.array([len(x) for x in after])
    fo, fl = deep_shallow(_padded(after, LENGTH))
    bo, bl = deep_shallow(_padded(before, BACK, reverse=True))
    low, high = np.full(n, -1), np.full(n, -1)
    for o in range(BACK + 1):
        rank_f, rank_b = np.empty(n, np.int64), np.empty(n, np.int64)
        rank_f[fo] = np.cumsum(fl < LENGTH - o)
        rank_b[bo] = np.cumsum(bl < o)
        ok = np.flatnonzero((la >= o) & (ra >= LENGTH - o))
        if len(ok) < 2:
            continue
        pair = rank_f[ok] * (n + 1) + rank_b[ok]
        by = np.argsort(pair, kind="stable")
        same = pair[by][1:] == pair[by][:-1]
        hit = ok[by[np.append(same, False) | np.append(False, same)]]
        low[hit] = np.where(low[hit] < 0, o, low[hit])
        high[hit] = o
    return low, high


def _compare_contexts(batches):
    """Covered spans (did, th, a, b) of single contexts, from rows sorted by gram."""
    for t in groups(batches, "gram"):
        gram = t.column("gram").to_numpy()
        start = np.append(np.flatnonzero(np.append(True, gram[1:] != gram[:-1])), len(gram))
        cuts = [0]
        for s in start[1:]:
            if s - cuts[-1] >= AT_ONCE or s == len(gram):
                cuts.append(int(s))
        for a, z in zip(cuts[:-1], cuts[1:]):
            part = t.slice(a, z - a)
            low, high = repeated_offsets(part.column("before").to_pylist(), part.column("after").to_pylist())
            hit = np.flatnonzero((low >= 0) & part.column("single").to_numpy(zero_copy_only=False))
            place = part.column("place").to_numpy()[hit]
            take = pa.array(hit)
            part = part.combine_chunks()
            yield pa.RecordBatch.from_arrays([
                part.column("did").take(take).combine_chunks(), part.column("th").take(take).combine_chunks(),
                pa.array((place - high[hit]).astype(np.int32)), pa.array((place + LENGTH - low[hit]).astype(np.int32))], names=["did", "th", "a", "b"])


def _string_hashes(batches):
    """Rows (gram, o, string hash, did, th, place, single): every string of a hot gram's contexts."""
    for b in batches:
        rows = []
        cols = [b.column(c).to_pylist() for c in ("gram", "did", "th", "place", "single", "before", "after")]
        for g, did, th, p, single, x, y in zip(*cols):
            s = x + y
            for o in range(max(0, LENGTH - len(y)), len(x) + 1):
                d = hashlib.blake2b(s[len(x) - o:len(x) - o + LENGTH], digest_size=8).digest()
                rows.append((g, o, int.from_bytes(d, "little", signed=True), did, th, p, single))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 7, (
            pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_()))], names=["gram", "o", "s", "did", "th", "place", "single"])


def covered(docs: DataFrame) -> DataFrame:
    """(did, th, spans): byte spans to remove in texts (did, th, text)."""
    found = materialize(docs.where(F.octet_length("text") >= LENGTH).mapInArrow(
        _find_anchors, "did long, th long, place int, gram long, ctx long, twice boolean"), "anchors")
    gram, both = Window.partitionBy("gram"), Window.partitionBy("gram", "ctx")
    met = (found.where("gram is not null")
           .withColumn("same", (F.count("*").over(both) > 1) | F.max("twice").over(both))
           .withColumn("nth", F.row_number().over(both.orderBy("did", "th", "place")))
           .withColumn("many", F.min("ctx").over(gram) != F.max("ctx").over(gram))
           .where("same or many"))
    met = materialize(met, "met")
    whole = found.where("gram is null").select("did", "th", "place").union(met.where("same").select("did", "th", "place"))
    spans = whole.select("did", "th", (F.col("place") - BACK).alias("a"), (F.col("place") + LENGTH).alias("b"))
    # contexts to compare: the single ones, and one of each kind of repeated ones
    want = met.where("many and (not same or nth = 1)").select("did", "th", F.struct("gram", "place", (~F.col("same")).alias("single")).alias("w"))
    want = want.groupBy("did", "th").agg(F.collect_list("w").alias("want"))
    ctx = docs.join(want, ["did", "th"]).select("did", "th", "text", "want").mapInArrow(
        _cut_contexts, "gram long, did long, th long, place int, single boolean, before binary, after binary")
    hot = materialize(met.where("many").groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") > HOT_GRAM).select("gram"), "hotgrams")
    if hot.isEmpty():
        spans = spans.union(_sorted_spans(ctx))
    else:
        ctx = materialize(ctx, "contexts")
        strings = ctx.join(hot, "gram", "left_semi").mapInArrow(
            _string_hashes, "gram long, o int, s long, did long, th long, place int, single boolean")
        strings = materialize(strings, "strings")
        more = strings.groupBy("gram", "o", "s").agg(F.count("*").alias("n")).where("n > 1").drop("n")
        hit = strings.where("single").join(more, ["gram", "o", "s"]).groupBy("did", "th", "place").agg(F.min("o").alias("x"), F.max("o").alias("y"))
        spans = spans.union(_sorted_spans(ctx.join(hot, "gram", "left_anti"))).union(
            hit.select("did", "th", F.col("place") - F.col("y"), F.col("place") + LENGTH - F.col("x")))
    return spans.groupBy("did", "th").agg(F.collect_set(F.struct("a", "b")).alias("spans"))


def _sorted_spans(ctx: DataFrame) -> DataFrame:
    return ctx.repartition("gram").sortWithinPartitions("gram").mapInArrow(_compare_contexts, "did long, th long, a int, b int")


def merged(spans, n: int) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted((max(0, s["a"]), min(n, s["b"])) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] = ()) -> DataFrame:
    """Texts with their key (did, th); rows that agree in both are copies of each other, which the key needn't part."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(*keep, F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("did"), F.xxhash64(t).alias("th"), t.alias("text"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, kept bytes) of every row."""
    spans = covered(keyed(docs, id_col, text_col))
    d = keyed(docs, id_col, text_col, [F.col(id_col).alias("doc_id")]).join(spans, ["did", "th"], "left")

    def run(batches):
        for b in slices(batches):
            cols = ([], [], [], [], [])
            for t, s in zip(_raw(b.column("text").to_pylist()), b.column("spans").to_pylist()):
                gone, at, kept = merged(s, len(t)), 0, []
                for x, y in gone:
                    kept.append(t[at:x])
                    at = y
                rest = b"".join([*kept, t[at:]])
                for c, v in zip(cols, (len(t), len(t) - len(rest), len(gone), hashlib.sha256(rest).hexdigest(), rest)):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(c, k) for c, k in zip(cols, (
                pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))]], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
    kind = dict(docs.dtypes)[id_col]
    return d.select("doc_id", "text", "spans").mapInArrow(
        run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op6_repeats(spark, sf_dir: str) -> DataFrame:
    """What repeated 200-byte strings cover in every document."""
    return dedup(documents(spark, sf_dir)).drop("kept")
