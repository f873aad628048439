import random
from collections import defaultdict

from custaris.llm import neardup
from custaris.llm.common import words


def brute(rows):
    """Components by comparing all sets."""
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    inv = defaultdict(set)
    for i, s in sets.items():
        for g in s:
            inv[g].add(i)
    seen = set()
    for i in sets:
        for j in {j for g in sets[i] for j in inv[g] if j > i}:
            if (i, j) not in seen:
                seen.add((i, j))
                n = len(sets[i] & sets[j])
                if 100 * n >= 85 * len(sets[i] | sets[j]):
                    a, b = sorted((find(i), find(j)))
                    root[b] = a
    return {i: (len(s), find(i)) for i, s in sets.items()}


def make(n=260, seed=4):
    r = random.Random(seed)
    vocab = [f"w{k}" for k in range(400)]
    rows, passage = [], [r.choice(vocab) for _ in range(70)]
    for i in range(n):
        kind = r.random()
        if rows and kind < 0.5:                      # near copy: change a few words
            w = rows[r.randrange(len(rows))][1].split()
            for _ in range(r.randrange(0, 5)):
                if w:
                    w[r.randrange(len(w))] = r.choice(vocab)
        elif kind < 0.6:                             # shared passage
            w = [r.choice(vocab) for _ in range(60)] + passage + [r.choice(vocab) for _ in range(60)]
        else:
            w = [r.choice(vocab) for _ in range(r.choice([0, 1, 3, 5, 40, 120, 200]))]
        rows.append((i, " ".join(w)))
    return rows


def check(spark, docs_of, rows):
    got = {r.doc_id: r for r in neardup.classes(docs_of([(i, t, "en", "s", 0) for i, t in rows])).collect()}
    want = brute(rows)
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (r.component_id == i) for i, r in got.items())


def test_brute_force(spark, docs_of):
    check(spark, docs_of, make())


def test_small_limits_take_the_other_paths(spark, docs_of, monkeypatch):
    """Branching, dense blocks and set blocks give the same components."""
    monkeypatch.setattr(neardup, "SMALL_NODE", 4)
    monkeypatch.setattr(neardup, "BLOCK", 3)
    check(spark, docs_of, make(160, 9))


def test_nulls_repeats_and_empty(spark, docs_of):
    text = " ".join(f"a{k}" for k in range(40))
    rows = [(5, text, None, None, None), (3, text.upper(), "en", "s", 1), (None, text, "en", "s", 1), (7, None, "en", "s", 1),
            (8, " ", "en", "s", 1), (3, text, "en", "s", 1), (9, "x", "en", "s", 1), (9, "y", "en", "s", 1), (10, "y", "en", "s", 1), (11, "x", "en", "s", 1)]
    d = docs_of(rows)
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in neardup.classes(d).collect()), key=str)
    want = [(5, 3, False), (3, 3, True), (None, None, True), (7, 7, True), (8, 8, True), (3, 3, True), (9, 9, True), (9, 9, True), (10, 9, False), (11, 9, False)]
    assert got == sorted(want, key=str)
    assert sorted(str(r.doc_id) for r in neardup.deduplicate(d).collect()) == ["3", "7", "8", "9", "None"]
    assert neardup.classes(docs_of([])).count() == 0
