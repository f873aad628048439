"""Exact KS p-values against all orders of small samples; many current sets against one reference."""

from itertools import combinations

import numpy as np
import pytest

from custaris.operators import drift as D


def by_hand(n1, n2):
    """Largest integer gap of every order of n1 and n2 rows."""
    gaps = []
    for places in combinations(range(n1 + n2), n1):
        i = j = g = 0
        for k in range(n1 + n2):
            i, j = (i + 1, j) if k in places else (i, j + 1)
            g = max(g, abs(i * n2 - j * n1))
        gaps.append(g)
    return np.array(gaps)


@pytest.mark.parametrize("n1,n2", [(3, 5), (5, 3), (6, 6), (4, 7), (1, 6), (6, 4)])
def test_exact_p_value_counts_orders(n1, n2):
    gaps = by_hand(n1, n2)
    for g in range(n1 * n2 + 1):
        assert D.ks_pvalue(g / (n1 * n2), n1, n2) == pytest.approx(float((gaps >= g).mean()), abs=1e-12)


def test_exact_p_value_joins_the_series_at_large_sizes():
    exact = D.ks_exact(0.02, 10_000, 10_000)
    series = D.ks_pvalue(0.02, 10_001, 10_001)
    assert exact == pytest.approx(series, rel=0.02) and 0.03 < exact < 0.04


def test_many_windows_against_one_reference(spark):
    rng = np.random.default_rng(3)
    ref = [("a", float(v)) for v in rng.integers(0, 30, 300)] + [("b", float(v)) for v in rng.normal(0, 1, 200)]
    cur = [(w, f, v + w) for w in (0, 1, 5) for f, v in
           [("a", float(x)) for x in rng.integers(0, 30, 120)] + [("b", float(x)) for x in rng.normal(0, 1, 90)]]
    r = spark.createDataFrame(ref, "feature string, value double").groupBy("feature", "value").count().withColumnRenamed("count", "r")
    c = (spark.createDataFrame(cur, "w int, feature string, value double").groupBy("w", "feature", "value").count()
         .withColumnRenamed("count", "c"))
    got = {(x["w"], x["feature"]): x for x in D.ks_against(r, c, ["w"]).collect()}
    assert len(got) == 6
    for (w, f), row in got.items():
        x = np.sort([v for g, v in ref if g == f])
        y = np.sort([v for k, g, v in cur if k == w and g == f])
        at = np.concatenate([x, y])
        want = np.abs(np.searchsorted(x, at, "right") / len(x) - np.searchsorted(y, at, "right") / len(y)).max()
        assert row["ks_stat"] == pytest.approx(want, abs=1e-12)
        assert (row["n_ref"], row["n_cur"]) == (len(x), len(y))
        assert row["ref_mean"] == pytest.approx(x.mean()) and row["cur_mean"] == pytest.approx(y.mean())
