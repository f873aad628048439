import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from custaris.llm import merkle as K


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(row, extra=0):
    d, t, lang, src, n = row[:5]
    vals = [d, src, lang, None if n is None else n + extra, t]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in vals))


def climb(nodes, fan):
    """All levels of one tree."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha("".join(last[i:i + fan])) for i in range(0, len(last), fan)])
    return levels


def steps(levels, pos, fan):
    out = []
    for level in levels[:-1]:
        first = pos // fan * fan
        out.append(("".join(level[first:pos]), "".join(level[pos + 1:first + fan])))
        pos //= fan
    return out


def folded(h, path):
    for a, b in path:
        h = sha(a + h + b)
    return h


def brute(rows, fan=2):
    """(doc_id, leaf, subroot, root, proof digest, folded root, verified) of every row."""
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append(r)
    keys = sorted(by, key=lambda k: (k is not None, (k or "").encode()))
    trees = {}
    for k in keys:
        own = sorted(by[k], key=lambda r: (r[0] is not None, r[0] or 0))
        trees[k] = own, climb([leaf(r) for r in own], fan)
    top = climb([trees[k][1][-1][0] for k in keys], fan)
    out = []
    for i, k in enumerate(keys):
        own, levels = trees[k]
        for j, r in enumerate(own):
            path = steps(levels, j, fan) + steps(top, i, fan)
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            f = folded(leaf(r, int(hit)), path)
            out.append((r[0], leaf(r), levels[-1][0], top[-1][0], sha("".join(a + b for a, b in path)), f, f == top[-1][0]))
    return sorted(out, key=str)


def rows_of(df):
    return sorted([tuple(r) for r in df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()], key=str)


ROWS = ([(i * 3, f"text {i} é", "en", f"s{i % 3}", i) for i in range(23)] + [(7, "", "de", None, None), (1 << 40, None, "de", "s", 5)]
        + [(4, "x" * 100_000, None, "s", 2), (10, "lone", "fr", "s", 1), (11, "ö", "zz", "s", 3), (12, "ä", "zz", "s", 3)])


def test_brute_force(spark, folder_of):
    assert rows_of(K.op12_merkle(spark, folder_of(ROWS))) == brute(ROWS)


def test_null_id_is_a_leaf_that_stays_untampered(spark, folder_of):
    rows = ROWS[:5] + [(None, "no id", "en", "s", 4)]
    got = rows_of(K.op12_merkle(spark, folder_of(rows)))
    assert got == brute(rows)
    assert [g[6] for g in got if g[0] is None] == [True]


@pytest.mark.parametrize("fan, row_nodes, part_rows", [(2, 4, 5), (3, 9, 4), (5, 5, 1000), (16, 256, 7)])
def test_many_bands_and_wider_nodes(spark, docs_of, fan, row_nodes, part_rows):
    tree, top = K.manifest(docs_of(ROWS), fan_out=fan, row_nodes=row_nodes, part_rows=part_rows)
    got = sorted([(r.id, r.node, r.subroot, r.root, sha("".join(s.before + s.after for s in r.path)))
                  for r in K.verified(tree, top).collect()], key=str)
    assert got == sorted([b[:5] for b in brute(ROWS, fan)], key=str)


def test_nodes_cover_their_ranks(spark, docs_of):
    tree, _ = K.manifest(docs_of(ROWS), row_nodes=4, part_rows=6)
    nodes = [r for r in tree.nodes().collect() if r.key == "en"]
    levels = climb([leaf(r) for r in sorted(ROWS[:23])], 2)
    assert sorted((r.level, r.lo, r.hi, r.node) for r in nodes) == sorted(
        (k, j << k, min((j + 1) << k, 23), h) for k, lev in enumerate(levels) for j, h in enumerate(lev))


def test_repeated_rows_and_ties(spark, folder_of):
    rows = [(1, "same", "en", "s", 4)] * 9 + [(1, "other", "en", "s", 5), (2, "b", "en", "s", 1)]
    got = rows_of(K.op12_merkle(spark, folder_of(rows)))
    again = rows_of(K.op12_merkle(spark, folder_of(list(reversed(rows)))))
    assert got == again and len(got) == 11
    assert len({g[3] for g in got}) == 1 and len({g[1] for g in got}) == 3


def test_empty_table_and_single_row(spark, folder_of):
    assert K.op12_merkle(spark, folder_of([])).count() == 0
    one = rows_of(K.op12_merkle(spark, folder_of([(5, "t", "en", "s", 1)])))
    assert one == brute([(5, "t", "en", "s", 1)])
    assert one[0][1] == one[0][2] == one[0][3] and one[0][4] == sha("")


def test_columns_with_clashing_names(spark, docs_of):
    d = docs_of(ROWS)
    for c in ("key", "id", "node", "other", "h", "pos", "n", "bucket", "levels", "load", "root", "__at", "__row"):
        d = d.withColumn(c, F.lit("clash"))
    tree, top = K.manifest(d)
    assert {r.root for r in K.verified(tree, top).collect()} == {brute(ROWS)[0][3]}


def test_any_change_breaks_the_proof(spark, docs_of):
    d = docs_of(ROWS)
    tree, top = K.manifest(d, changed={"text": F.concat(d["text"], F.lit("."))})
    got = {r.id: r.folded == r.root for r in K.verified(tree, top).collect()}
    assert got == {r[0]: r[1] is None for r in ROWS}   # a null text stays null
