"""Connected components against union-find: hubs of either end of the order, chains, random graphs, no edges."""
import random

from custaris.llm.common import components


def by_union_find(edges):
    up = {}

    def top(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x
    for a, b in edges:
        x, y = top(a), top(b)
        up[max(x, y)] = min(x, y)
    return {x: top(x) for x in up}


def test_hubs_chains_and_random(spark):
    rng = random.Random(3)
    edges = [(5000, k) for k in range(1000, 1600)]                # the hub is the largest node ..
    edges += [(k, 10) for k in range(6000, 6600)]                 # .. or the smallest
    edges += [(k, k + 1) for k in range(8000, 8030)]
    edges += [(rng.randrange(20_000, 20_300), rng.randrange(20_000, 20_300)) for _ in range(200)]
    edges += edges[:50] + [(b, a) for a, b in edges[:50]]         # repeats, both ways
    edges = [(a, b) for a, b in edges if a != b]
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.root for r in got} == by_union_find(edges) and len(got) == len({r.node for r in got})


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
