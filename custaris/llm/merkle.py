"""Merkle manifest of a table: nested-interval labels.

Every row is a leaf.  Leaves of a key (the language) are ranked by id; a node of the key's tree covers the interval
``[lo, hi)`` of leaf ranks, and its parent the interval of ``fan_out`` neighbouring nodes.  Levels are bucketed in bands: the
nodes of a band under one top node lie in one row (at most ``ROW_NODES`` lowest ones), so that a tree of any size needs one
grouping a band.  Ancestors are attached from the highest band down, by a join of a band's rows with the nodes of the next
one on the bucket of the interval, checked for containment.  Within a parent, its interval less the node's own one is that
of the siblings left and right of it: these make the proof.  The trees' roots are ranked by key and are the leaves of a last
tree of the same form.

Ranks come from one range exchange over (key, id) with the counts of its parts put in front: no key is in one task.

Defined results: a null in a column is ``-`` in the leaf, an empty text ``0:``; a null id or key is a value of its own that
comes first; rows of one id stand in the order of a hash of their leaves, wholly equal rows in any order (they are alike); a
text of any length is hashed once, where it is read; an empty table has no rows; a lone leaf is its own root; other columns
play no part, whatever their names.  :meth:`Tree.nodes` gives the manifest (nodes with their intervals), :func:`proofs` the
siblings, :func:`fold` the root that a leaf and a proof give.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, materialize

FAN_OUT = 2
ROW_NODES = 256            # lowest nodes of a band in one row, at most
PART_ROWS = 1_000_000      # rows of a part of the range exchange
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<before: string, after: string>>"


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf_of(fields: list[Column]) -> Column:
    """Hash of the fields, each ``-`` if null, else its number of UTF-8 bytes, ``:`` and the value."""
    said = [F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in (f.cast("string") for f in fields)]
    return digest(F.concat(*said))


def _levels(n: Column, fan_out: int) -> Column:
    """Levels above ``n`` nodes until one remains: the number of smaller powers of ``fan_out``, exact at any size."""
    powers = F.array(*[F.lit(fan_out ** k).cast("long") for k in range(63) if fan_out ** k < 1 << 62])
    return F.size(F.filter(powers, lambda p: p < n))


def ranked(rows: DataFrame, key: str, order: list[str], name: str, part_rows: int = PART_ROWS) -> DataFrame:
    """``rows`` with ``pos``, the rank within the key by ``order`` from 0, and ``n``, the key's number of rows (written table).

    Equal rows are told apart by a running number, so that not even copies of one row meet in one part of the exchange.
    """
    rows = materialize(rows.withColumn("__at", F.monotonically_increasing_id()), f"{name}-rows")
    by = [key, *order, "__at"]
    dealt = (rows.repartitionByRange(max(1, -(-rows.count() // part_rows)), *by).sortWithinPartitions(*by).drop("__at")
             .withColumn("__row", F.monotonically_increasing_id()))  # part and row in it
    dealt = materialize(dealt, f"{name}-sorted").withColumn("__part", F.shiftright("__row", 33))
    # one row a (part, key): the parts of a key, and its rows in them, stand in order
    cells = dealt.groupBy("__part", key).agg(F.count("*").alias("c"), F.min("__row").alias("first"))
    own = Window.partitionBy(key)
    ahead = own.orderBy("__part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cells = cells.select(F.col("__part").alias("__p"), F.col(key).alias("__k"), "first",
                         (F.sum("c").over(ahead) - F.col("c")).alias("ahead"), F.sum("c").over(own).alias("n"))
    out = dealt.join(cells, (dealt["__part"] == cells["__p"]) & dealt[key].eqNullSafe(cells["__k"]))
    return materialize(out.select(*[c for c in rows.columns if c != "__at"],
                                  (F.col("ahead") + F.col("__row") - F.col("first")).alias("pos"), "n"), name)


@dataclass
class Tree:
    """Bands of the trees of all keys, lowest first.

    A band's table has a row for each bucket: key, ``bucket`` (number of its top node), ``lo, hi`` (leaf ranks it covers),
    ``n`` (nodes of the band's lowest level in the key's tree), ``is_top`` (the bucket ends at the root), ``levels`` (an
    array of node hashes for each level) and ``load`` (the leaves' other columns, in the lowest band).
    """

    key: str
    load: list[str]
    fan_out: int
    per: int               # lowest nodes of a full bucket
    depth: int             # levels of a band above its lowest
    bands: list[DataFrame]

    def width(self, band: int) -> int:
        """Leaves under a full node of the band's lowest level."""
        return self.per ** band

    def nodes(self) -> DataFrame:
        """(key, level, lo, hi, node): every node of every tree once, with the leaf ranks that it covers."""
        out = None
        for k, b in enumerate(self.bands):
            r = b.select(self.key, "lo", "hi", "is_top", F.posexplode("levels").alias("up", "at"))
            r = r.where((F.col("up") < self.depth) | F.col("is_top"))  # the last level is the next band's lowest
            w = F.pow(F.lit(float(self.fan_out)), F.col("up") + self.depth * k).cast("long")
            r = r.select(self.key, (F.col("up") + self.depth * k).alias("level"), "lo", "hi", w.alias("w"), F.posexplode("at").alias("j", "node"))
            r = r.select(self.key, "level", (F.col("lo") + F.col("j") * F.col("w")).alias("lo"),
                         F.least(F.col("hi"), F.col("lo") + (F.col("j") + 1) * F.col("w")).alias("hi"), "node")
            out = r if out is None else out.unionByName(r)
        return out

    def roots(self) -> DataFrame:
        """(key, root) of every tree."""
        out = None
        for b in self.bands:
            own = b.where("is_top").select(self.key, _last(F.col("levels")).alias("root"))
            out = own if out is None else out.unionByName(own)
        return out


def _last(levels: Column) -> Column:
    return F.element_at(F.element_at(levels, -1), 1)


def _parents(level: Column, fan_out: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(level) - 1) / fan_out).cast("int")),
                       lambda i: digest(F.array_join(F.slice(level, i * fan_out + 1, F.lit(fan_out)), "")))


def _band(nodes: DataFrame, tree: Tree, load: list[str]) -> DataFrame:
    """Buckets of the next band from its lowest nodes (key, pos, n, leaves, node and ``load``)."""
    key, per, depth = tree.key, tree.per, tree.depth
    wide = per * tree.width(len(tree.bands))
    b = nodes.groupBy(key, F.floor(F.col("pos") / per).cast("long").alias("bucket")).agg(
        F.max("n").alias("n"), F.max("leaves").alias("leaves"),
        F.array_sort(F.collect_list(F.struct("pos", "node", F.struct(F.lit(0).alias("_"), *load).alias("load")))).alias("own"))  # at most ``per``
    b = b.withColumn("is_top", F.col("n") <= per)
    # a bucket among others goes up the whole band, even where one node is left; the one that is alone ends at its root
    b = b.withColumn("up", F.when(F.col("is_top"), _levels(F.col("n"), tree.fan_out)).otherwise(depth)).withColumn("l0", F.col("own.node"))
    for k in range(depth):
        b = b.withColumn(f"l{k + 1}", F.when(F.col("up") > k, _parents(F.col(f"l{k}"), tree.fan_out)))
    lo = F.col("bucket") * wide
    return b.select(key, "bucket", "n", "leaves", "is_top", lo.alias("lo"), F.least(lo + wide, F.col("leaves")).alias("hi"),
                    F.slice(F.array(*[f"l{k}" for k in range(depth + 1)]), F.lit(1), F.col("up") + 1).alias("levels"),
                    F.col("own.load").alias("load"))


def build(leaves: DataFrame, key: str, name: str, load: list[str] | None = None, fan_out: int = FAN_OUT, row_nodes: int = ROW_NODES) -> Tree:
    """The trees of all keys from ranked leaves (key, pos, n, node, ``load``): one grouping and one written table a band."""
    depth = max(k for k in range(1, 63) if k == 1 or fan_out ** k <= row_nodes)
    tree = Tree(key, load or [], fan_out, fan_out ** depth, depth, [])
    at = leaves.withColumn("leaves", F.col("n"))
    while True:
        band = materialize(_band(at, tree, [] if tree.bands else tree.load), f"{name}-band")
        tree.bands.append(band)
        rest = band.where("not is_top")
        if rest.isEmpty():
            return tree
        at = rest.select(key, F.col("bucket").alias("pos"), F.ceil(F.col("n") / tree.per).cast("long").alias("n"), "leaves",
                         _last(F.col("levels")).alias("node"))


def _siblings(tree: Tree, j: Column) -> Column:
    """Proof steps of the bucket's lowest node ``j``: at each level the joined siblings before and after its ancestor.

    The parent covers the nodes ``[f, f + fan_out)`` of the level and the ancestor ``[c, c + 1)``: the difference of the two
    intervals is ``[f, c)`` and ``[c + 1, f + fan_out)``.
    """
    def step(level, k):
        c = F.floor(j / F.pow(F.lit(float(tree.fan_out)), k)).cast("int")
        f = (F.floor(c / tree.fan_out) * tree.fan_out).cast("int")
        return F.struct(F.array_join(F.slice(level, f + 1, c - f), "").alias("before"),
                        F.array_join(F.slice(level, c + 2, f + tree.fan_out - c - 1), "").alias("after"))
    return F.transform(F.slice("levels", F.lit(1), F.size("levels") - 1), step)


def proofs(tree: Tree, outer: DataFrame | None = None) -> DataFrame:
    """(key, pos, node, subroot, root, path and the loaded columns) of every leaf.

    ``path`` has a (before, after) pair of joined siblings for each level, lowest first.  ``outer`` gives (member, root,
    path) of the trees' roots in a tree above; without it a tree's root is the root.
    """
    key, above = tree.key, None
    for k in range(len(tree.bands) - 1, -1, -1):
        b = tree.bands[k]
        top = b.where("is_top").withColumn("subroot", _last(F.col("levels")))
        if outer is None:
            top = top.select("*", F.col("subroot").alias("root"), F.array().cast(PATH).alias("more"))
        else:
            o = outer.select(F.col("member").alias("__k"), "root", F.col("path").alias("more"))
            top = top.join(o, top[key].eqNullSafe(o["__k"])).drop("__k")
        if above is not None:
            a = above.select(F.col(key).alias("__k"), F.col("pos").alias("__p"), F.col("lo").alias("__lo"), F.col("hi").alias("__hi"),
                             "subroot", "root", F.col("path").alias("more"))
            low = b.where("not is_top")
            low = low.join(a, low[key].eqNullSafe(a["__k"]) & (low["bucket"] == a["__p"])
                           & (a["__lo"] <= low["lo"]) & (low["hi"] <= a["__hi"])).drop("__k", "__p", "__lo", "__hi")
            top = top.unionByName(low)
        # the steps are found before the rows part, so that a bucket's levels aren't copied to each of its nodes
        each = F.transform(F.sequence(F.lit(0), F.size(F.col("levels")[0]) - 1), lambda j: F.struct(
            j.alias("j"), F.get(F.col("levels")[0], j).alias("node"), _siblings(tree, j).alias("steps"), F.get(F.col("load"), j).alias("load")))
        rows = top.select(key, "bucket", "lo", "hi", "subroot", "root", "more", F.explode(each).alias("e"))
        w = tree.width(k)
        lo = F.col("lo") + F.col("e.j") * w
        above = rows.select(key, (F.col("bucket") * tree.per + F.col("e.j")).alias("pos"), "e.node", "subroot", "root",
                            F.concat("e.steps", "more").alias("path"), lo.alias("lo"), F.least(F.col("hi"), lo + w).alias("hi"),
                            *[F.col(f"e.load.{c}") for c in (tree.load if k == 0 else [])])
    return above.select(key, "pos", "node", "subroot", "root", "path", *tree.load)


def fold(node: Column, path: Column) -> Column:
    """Root that a leaf and its proof give."""
    return F.aggregate(path, node, lambda acc, s: digest(F.concat(s["before"], acc, s["after"])))


def proof_digest(path: Column) -> Column:
    return digest(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""))


def manifest(docs: DataFrame, fields=FIELDS, key: str = "lang", order: str = "doc_id", changed: dict[str, Column] | None = None,
             fan_out: int = FAN_OUT, row_nodes: int = ROW_NODES, part_rows: int = PART_ROWS) -> tuple[Tree, Tree]:
    """(trees of the keys over the rows of ``docs``, tree of their roots).

    ``changed`` gives other values of some fields; the leaves carry ``id`` and ``other``, the hash of the changed row.
    """
    own = {f: docs[f"`{f}`"] for f in fields}
    rows = docs.select(docs[f"`{key}`"].alias("key"), docs[f"`{order}`"].alias("id"), leaf_of(list(own.values())).alias("node"),
                       leaf_of([(changed or {}).get(f, c) for f, c in own.items()]).alias("other"))
    leaves = ranked(rows.withColumn("h", F.xxhash64("node")), "key", ["id", "h"], "merkle-ranked", part_rows)
    tree = build(leaves, "key", "merkle", ["id", "other"], fan_out, row_nodes)
    tops = tree.roots().select(F.lit(0).alias("all"), F.col("key").alias("member"), F.col("root").alias("node"))
    top = build(ranked(tops, "all", ["member"], "merkle-tops", part_rows), "all", "merkle-top", ["member"], fan_out, row_nodes)
    return tree, top


def verified(tree: Tree, top: Tree) -> DataFrame:
    """Leaves of the manifest with their proofs and the root that their changed row folds to."""
    return proofs(tree, proofs(top)).select("id", "node", "subroot", "root", "path", fold(F.col("other"), F.col("path")).alias("folded"))


def op12_merkle(spark, sf_dir: str) -> DataFrame:
    """Leaf, roots, proof and the check of a tampered copy for every document."""
    d = documents(spark, sf_dir)
    hit = F.crc32(d["doc_id"].cast("string").cast("binary")) % 7 == 0
    tampered = {"n_chars": F.when(hit, F.try_add(d["n_chars"], F.lit(1))).otherwise(d["n_chars"])}
    v = verified(*manifest(d, changed=tampered))
    return v.select(F.col("id").alias("doc_id"), F.col("node").alias("leaf"), "subroot", "root",
                    proof_digest(F.col("path")).alias("proof_sha256"), F.col("folded").alias("folded_root"),
                    (F.col("folded") == F.col("root")).alias("verified"))


def _sql_leaf(n_chars: str) -> str:
    def said(c):
        return f"coalesce(octet_length(encode(CAST({c} AS VARCHAR)))::VARCHAR || ':' || CAST({c} AS VARCHAR), '-')"
    return "sha256(" + " || ".join(said(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


#: the same by recursion, one level a step; crc32 bit by bit (DuckDB has none)
ORACLE = f"""
WITH RECURSIVE
bits AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)),
             lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
crc AS (SELECT doc_id AS id, any_value(xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
             lambda s: CAST(ascii(s) AS BIGINT))), lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1])))) % 7 AS r
        FROM (SELECT DISTINCT doc_id FROM documents) d, bits GROUP BY doc_id),
leaves AS (SELECT d.doc_id, d.lang, {_sql_leaf('n_chars')} AS leaf, {_sql_leaf('CASE WHEN r = 0 THEN n_chars + 1 ELSE n_chars END')} AS other
           FROM documents d LEFT JOIN crc ON crc.id = d.doc_id),
ranks AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
              dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, count(*) OVER (PARTITION BY lang) AS n FROM leaves),
low AS (SELECT g, 0 AS level, pos, n, leaf AS h FROM ranks
        UNION ALL SELECT g, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM low
                  WHERE n > 1 GROUP BY g, level, pos // 2, n),
high AS (SELECT 0 AS level, g AS pos, (SELECT count(DISTINCT g) FROM ranks) AS n, h FROM low WHERE n = 1
         UNION ALL SELECT level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM high
                   WHERE n > 1 GROUP BY level, pos // 2, n),
kin AS (SELECT a.g, a.level, a.pos, b.h AS sib FROM low a LEFT JOIN low b ON b.g = a.g AND b.level = a.level AND b.pos = xor(a.pos, 1) WHERE a.n > 1),
kin_high AS (SELECT a.level, a.pos, b.h AS sib FROM high a LEFT JOIN high b ON b.level = a.level AND b.pos = xor(a.pos, 1) WHERE a.n > 1),
up AS (SELECT g, pos AS leaf_pos, 0 AS level, pos, other AS acc, '' AS proof FROM ranks
       UNION ALL SELECT u.g, leaf_pos, u.level + 1, u.pos // 2,
                        sha256(CASE WHEN u.pos % 2 = 0 THEN acc || coalesce(sib, '') ELSE coalesce(sib, '') || acc END), proof || coalesce(sib, '')
                 FROM up u JOIN kin k ON k.g = u.g AND k.level = u.level AND k.pos = u.pos),
subs AS (SELECT g, leaf_pos, arg_max(acc, level) AS acc, arg_max(proof, level) AS proof FROM up GROUP BY g, leaf_pos),
up_high AS (SELECT g, leaf_pos, 0 AS level, g AS pos, acc, proof FROM subs
            UNION ALL SELECT u.g, leaf_pos, u.level + 1, u.pos // 2,
                        sha256(CASE WHEN u.pos % 2 = 0 THEN acc || coalesce(sib, '') ELSE coalesce(sib, '') || acc END), proof || coalesce(sib, '')
                      FROM up_high u JOIN kin_high k ON k.level = u.level AND k.pos = u.pos),
ends AS (SELECT g, leaf_pos, arg_max(acc, level) AS acc, arg_max(proof, level) AS proof FROM up_high GROUP BY g, leaf_pos)
SELECT a.doc_id, a.leaf, l.h AS subroot, t.h AS root, sha256(e.proof) AS proof_sha256, e.acc AS folded_root, e.acc = t.h AS verified
FROM ranks a JOIN ends e ON e.g = a.g AND e.leaf_pos = a.pos JOIN low l ON l.g = a.g AND l.n = 1 JOIN high t ON t.n = 1
"""
