import random

import corpus_pipeline as cp
from custaris.llm import neardup
from custaris.llm.common import words


def brute(rows, percent):
    """Smallest id of each component, by comparing all pairs of sets."""
    sets = {i: {tuple(words(t)[k:k + 5]) for k in range(len(words(t)) - 4)} for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    pairs = set()
    for i in sets:
        for j in sets:
            n = len(sets[i] & sets[j])
            if i < j and 100 * n >= percent * len(sets[i] | sets[j]):
                pairs.add((i, j))
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {find(i) for i in sets}, pairs


def make():
    """Texts of 105 words; copies with up to four words changed: similarity about 0.9, 0.82, 0.74 and 0.66."""
    r = random.Random(8)
    rows = []
    for i in range(60):
        w = [f"w{r.randrange(5000)}" for _ in range(105)]
        rows.append((10 * i, " ".join(w)))
        c = list(w)
        for k in range(i % 5):
            c[10 + 20 * k] = f"new{i}x{k}"
        rows.append((10 * i + 1, " ".join(c)))
    return rows


def test_stage_links_from_080_and_op1_from_085(spark, docs_of):
    rows = make()
    docs = docs_of([(i, t, "en", "s", len(t)) for i, t in rows])
    (at80, pairs80), (at85, pairs85) = brute(rows, 80), brute(rows, 85)
    assert len(pairs80) > len(pairs85) > 0
    assert {r.doc_id for r in cp.STAGES[1][1](spark, docs, None).collect()} == at80
    assert {r.doc_id for r in neardup.classes(docs).where("kept").collect()} == at85


def test_bounds_follow_the_percentage():
    assert [neardup.trees(p) for p in (80, 85)] == [5, 4]
    assert [neardup.maybe(p) for p in (80, 85)] == [81, 90]
