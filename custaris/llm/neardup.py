"""MinHash near-dedup: a chosen-path set similarity join.

Documents with equal shingle sets form a class with one representative.  Representatives descend through independent
trees: a node picks two minwise coordinates, and a representative goes to one child for each, named by its minimum
there.  Nodes of one die; small nodes are compared exhaustively on sketches; larger ones branch again.  A node that
hardly shrinks (its members are alike) or is at the last depth is compared in blocks of pairs, so no node is dropped or
capped.  A pair of similarity s survives a level of a tree with probability 1 - (1 - s*q)^2, q the next level's, so each
tree finds it with at least (2s - 1) / s^2: 0.969 at 0.85, 0.938 at 0.8.  :func:`trees` takes as many as together miss
fewer than one pair in a million (4 at 0.85, 5 at 0.8).

Pairs link from ``percent`` on (op1: 85).  Sketch agreement of at least :func:`maybe` makes a candidate edge (``percent``
less 4.75 standard deviations of the agreement).  Components of the candidate graph are then compared on their full sets,
in blocks of bounded size by matrix products, and only pairs with 100 * intersection >= percent * union link.  Tasks hand
on spanning forests, not all pairs.

Defined results: documents without words are linked with nothing (component: their own id); rows with a null id take no
part in links (component null, kept); rows that share an id are one document; equal texts are one class; an empty table
gives no rows; other columns pass through :func:`deduplicate`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPREAD, components, documents, materialize, slices
from .shingles import SKETCH, shingle_set, signature, sketch

PERCENT = 85               # op1's least similarity of a link
MISSED = 1e-6              # share of pairs at the least similarity that the trees may miss
DEVIATIONS = 4.75
DEPTH = 8
SMALL_NODE = 2000          # nodes up to here are compared exhaustively in one task
DENSE = 0.7                # a child with more than this part of its parent is compared, not split
BLOCK = 512                # representatives of a candidate component compared at once ..
BLOCK_SHINGLES = 500_000  # .. and their shingles


def trees(percent: int) -> int:
    """Trees that together find a pair of ``percent`` similarity but for a share of ``MISSED``."""
    if not 50 < percent < 100:
        raise ValueError("percent must lie between 50 and 100")
    s = percent / 100
    return math.ceil(math.log(MISSED) / math.log(1 - (2 * s - 1) / s ** 2))


def maybe(percent: int) -> int:
    """Equal coordinates of two sketches that make a candidate."""
    s = percent / 100
    return math.ceil(SKETCH * s - DEVIATIONS * math.sqrt(SKETCH * s * (1 - s)))


def sketched(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, s1, s2, sketch, bits) of every row: set size, set signature, minima, their low bytes."""
    def run(batches):
        for b in slices(batches):
            sets = [shingle_set(t) for t in b.column("text").to_pylist()]
            sig = [signature(s) for s in sets]
            sk = np.stack([sketch(s) for s in sets])
            off = pa.array(np.arange(len(sets) + 1) * SKETCH, pa.int32())
            yield pa.RecordBatch.from_arrays([
                b.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([s[0] for s in sig], pa.int64()),
                pa.array([s[1] for s in sig], pa.int64()), pa.ListArray.from_arrays(off, pa.array(sk.view(np.int32).ravel())),
                pa.array([r.tobytes() for r in sk.astype(np.uint8)], pa.binary())], names=["doc_id", "n", "s1", "s2", "sketch", "bits"])
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id long, n long, s1 long, s2 long, sketch array<int>, bits binary")


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by ``key`` (many small groups at a time)."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(key).to_numpy(zero_copy_only=False)
        last = int(np.searchsorted(k, k[-1], side="left")) if k[0] <= k[-1] else 0
        if last == 0 and held and held[-1].column(key)[-1].as_py() == k[0]:
            held.append(b)
            continue
        head, tail = b.slice(0, last), b.slice(last)
        if last == 0 and held:          # a new group starts with this batch
            yield pa.Table.from_batches(held)
            held = [tail]
            continue
        held.append(head)
        if sum(x.num_rows for x in held):
            yield pa.Table.from_batches([x for x in held if x.num_rows])
        held = [tail]
    if held:
        yield pa.Table.from_batches(held)


def forest(n: int, alike) -> list[tuple[int, int]]:
    """Spanning forest of 0..n-1; ``alike(i, others)`` tells which of ``others`` link with i."""
    left, out = np.arange(n), []
    while len(left):
        front, left = [int(left[0])], left[1:]
        while front and len(left):
            i = front.pop()
            hit = alike(i, left)
            got = left[hit]
            out += [(i, int(j)) for j in got]
            front += got.tolist()
            left = left[~hit]
    return out


def _compare_sketches(batches, need: int):
    """Candidate edges of nodes: rows (key, rep, bits) sorted by key; ``need`` equal coordinates make one."""
    for t in groups(batches, "key"):
        k = t.column("key").to_numpy()
        rep = t.column("rep").to_numpy()
        bits = np.frombuffer(b"".join(t.column("bits").to_pylist()), np.uint8).reshape(len(k), SKETCH)
        start = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
        size = np.diff(np.append(start, len(k)))
        a, b = [], []
        small = np.repeat(size <= 24, size)
        for d in range(1, 24):          # all pairs of small nodes at distance d
            i = np.flatnonzero(small[:-d] & (k[d:] == k[:-d])) if d < len(k) else np.zeros(0, int)
            if not len(i):
                break
            for c in range(0, len(i), 50_000):
                j = i[c:c + 50_000]
                j = j[(bits[j] == bits[j + d]).sum(1) >= need]
                a.append(rep[j])
                b.append(rep[j + d])
        for s, z in zip(start[size > 24], size[size > 24]):
            own = bits[s:s + z]
            pairs = np.array(forest(int(z), lambda i, others: (own[others] == own[i]).sum(1) >= need), int).reshape(-1, 2)
            a.append(rep[s + pairs[:, 0]])
            b.append(rep[s + pairs[:, 1]])
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def candidates(reps: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Candidate edges (a, b) between representatives (rep, sketch, bits) by the chosen-path trees."""
    at = lambda c: F.element_at("sketch", c)
    need = maybe(percent)
    roots = F.array(*[F.xxhash64(F.lit(t), F.lit(c), at(F.lit(2 * t + c + 1))) for t in range(trees(percent)) for c in (0, 1)])
    nodes = reps.select("rep", F.explode(roots).alias("node")).withColumn("above", F.lit(None).cast("long"))
    found = []
    for depth in range(1, DEPTH + 1):
        # a node's members are counted and told its size by (node, part), so that a large node meets in many tasks
        dealt = nodes.withColumn("part", F.pmod(F.xxhash64("rep"), F.lit(SPREAD)))
        parts = dealt.groupBy("node", "part").agg(F.count("*").alias("c"), F.max("above").alias("above"))
        sizes = parts.groupBy("node").agg(F.sum("c").alias("c"), F.max("above").alias("above")).where("c > 1")
        told = parts.select("node", "part").join(sizes, "node")
        live = materialize(dealt.select("rep", "node", "part").join(told, ["node", "part"]).drop("part"), f"nodes{depth}")
        last = depth == DEPTH
        leaf = (F.col("c") <= SMALL_NODE) | F.coalesce(F.col("c") > F.col("above") * DENSE, F.lit(False)) | F.lit(last)
        ready = live.where(leaf)
        blocks = F.ceil(F.col("c") / F.lit(SMALL_NODE)).cast("int")
        own = F.pmod(F.xxhash64("rep"), blocks).cast("int")
        keys = F.when(blocks == 1, F.array(F.col("node"))).otherwise(F.transform(
            F.filter(F.sequence(F.lit(0), blocks - 1), lambda x: x != own),
            lambda x: F.xxhash64(F.col("node"), F.least(x, own), F.greatest(x, own))))
        ready = ready.select("rep", F.explode(keys).alias("key")).join(reps.select("rep", "bits"), "rep")
        ready = ready.repartition("key").sortWithinPartitions("key").select("key", "rep", "bits")
        found.append(materialize(ready.mapInArrow(lambda batches: _compare_sketches(batches, need), "a long, b long").distinct(), f"pairs{depth}"))
        big = live.where(~leaf)
        if last or big.isEmpty():
            break
        coord = lambda j: (F.pmod(F.xxhash64("node", F.lit(j)), F.lit(SKETCH)) + 1).cast("int")
        kids = F.array(*[F.xxhash64("node", F.lit(j), at(coord(j))) for j in (0, 1)])
        nodes = big.join(reps.select("rep", "sketch"), "rep").select("rep", F.col("c").alias("above"), F.explode(F.array_distinct(kids)).alias("node"))
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out


def _compare_sets(batches, percent: int):
    """Exact links from ``percent`` on: rows (key, rep, shingles) sorted by key; a spanning forest of each block."""
    for t in groups(batches, "key"):
        k = t.column("key").to_numpy()
        start = np.append(np.flatnonzero(np.append(True, k[1:] != k[:-1])), len(k))
        rep, raw = t.column("rep").to_numpy(), t.column("shingles")
        out = []
        for s, e in zip(start[:-1], start[1:]):
            ids, first = np.unique(rep[s:e], return_index=True)      # an id may have come twice
            sets = [np.frombuffer(raw[int(s + i)].as_py(), np.uint64) for i in first]
            if len(ids) > 1:
                out += [(ids[i], ids[j]) for i, j in _links(sets, percent)]
        a = np.array(out, np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], names=["a", "b"])


def _links(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    n = np.array([len(s) for s in sets])
    if len(sets) <= 6:
        def alike(i, others):
            inter = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for j in others])
            return 100 * inter >= percent * (n[i] + n[others] - inter)
        return forest(len(sets), alike)
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), n)
    shared = np.bincount(column) > 1
    column, row = (np.cumsum(shared) - 1)[column[shared[column]]], row[shared[column]]
    inter = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    step = 4096
    for c in range(0, int(shared.sum()), step):
        a, b = np.searchsorted(column, [c, c + step])
        x = np.zeros((len(sets), step), np.float32)
        x[row[a:b], column[a:b] - c] = 1
        inter += x @ x.T
    inter = inter.astype(np.int64)
    linked = 100 * inter >= percent * (n[:, None] + n[None] - inter)
    return forest(len(sets), lambda i, others: linked[i, others])


def links(docs: DataFrame, reps: DataFrame, edges: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          percent: int = PERCENT) -> DataFrame:
    """Exact links (a, b) between representatives in the components of the candidate edges."""
    member = components(edges).join(reps.select(F.col("rep").alias("node"), "n", "s1", "s2"), "node")
    size = member.groupBy("root").agg(F.count("*").alias("c"), F.sum("n").alias("t"))
    blocks = F.greatest(F.ceil(F.col("c") / F.lit(BLOCK)), F.ceil(F.col("t") / F.lit(BLOCK_SHINGLES))).cast("int")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    keys = F.when(F.col("blocks") == 1, F.array(F.xxhash64("root"))).otherwise(F.transform(
        F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: x != own),
        lambda x: F.xxhash64(F.col("root"), F.least(x, own), F.greatest(x, own))))
    member = member.join(size.select("root", blocks.alias("blocks")), "root").select(F.col("node").alias("rep"), "s1", "s2", keys.alias("keys"))
    d = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).alias("text")).join(member, "rep")

    def run(batches):
        for b in slices(batches):
            keep, raw = [], []
            for i, (t, s1, s2) in enumerate(zip(b.column("text").to_pylist(), b.column("s1").to_pylist(), b.column("s2").to_pylist())):
                s = shingle_set(t)
                if signature(s) == (s1, s2):     # rows that share the id but not the text stay out
                    keep.append(i)
                    raw.append(s.tobytes())
            sel = b.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([sel.column("rep"), sel.column("keys"), pa.array(raw, pa.binary())], names=["rep", "keys", "shingles"])
    sets = d.mapInArrow(run, "rep long, keys array<long>, shingles binary")
    blocks_of = sets.select(F.explode("keys").alias("key"), "rep", "shingles").repartition("key").sortWithinPartitions("key")
    return blocks_of.mapInArrow(lambda batches: _compare_sets(batches, percent), "a long, b long")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row; pairs link from ``percent`` similarity on."""
    d = materialize(sketched(docs, id_col, text_col), "sketch")
    known = d.where("doc_id is not null and n > 0")
    reps = known.groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.count("*").alias("copies"),
                                         F.min_by(F.struct("sketch", "bits"), "doc_id").alias("x"))
    reps = materialize(reps.select("rep", "s1", "s2", "n", "copies", "x.sketch", "x.bits"), "reps")
    exact = materialize(links(docs, reps, candidates(reps, percent), id_col, text_col, percent), "links")
    # an id on several texts joins their classes
    twice = known.groupBy("doc_id").agg(F.min("s1").alias("x"), F.max("s1").alias("y"), F.min("s2").alias("z"), F.max("s2").alias("w"))
    twice = twice.where("x <> y or z <> w").select("doc_id")
    bridge = known.join(twice, "doc_id").select("doc_id", "s1", "s2").join(reps.select("s1", "s2", "rep"), ["s1", "s2"])
    root = components(exact.union(bridge.select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))))
    top = reps.select("s1", "s2", "rep").join(root, F.col("rep") == F.col("node"), "left").select(
        F.col("s1").alias("t1"), F.col("s2").alias("t2"), F.coalesce("root", "rep").alias("component_id"))
    out = d.select("doc_id", F.col("n").alias("n_shingles"), "s1", "s2").join(
        top, (F.col("s1") == F.col("t1")) & (F.col("s2") == F.col("t2")) & (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), "left")
    comp = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", comp.alias("component_id"), F.coalesce(F.col("doc_id") == comp, F.lit(True)).alias("kept"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """``docs`` less the near copies: the document with the smallest id of each component stays, one row an id."""
    keep = classes(docs, id_col, text_col, percent).where("kept and doc_id is not null").select(F.col("doc_id").alias("__nd_id")).distinct()
    named = docs.where(F.col(id_col).isNotNull()).join(keep, F.col(id_col) == F.col("__nd_id"), "left_semi").dropDuplicates([id_col])
    return named.unionByName(docs.where(F.col(id_col).isNull()))


def op1_neardup(spark, sf_dir: str) -> DataFrame:
    """Near-copy components of all documents."""
    return classes(documents(spark, sf_dir))


ORACLE = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM t)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS root FROM r GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.root AS component_id, d.doc_id = c.root AS kept
FROM documents d JOIN c ON c.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
