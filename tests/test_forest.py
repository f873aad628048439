"""Random forests on binned rows: cuts, draws, folds, and which fits are left to MLlib."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from custaris.operators import boosting as B
from custaris.operators import forest as RF
from custaris.operators import models as M
from custaris.plans import training as T


def table(spark, n=400, seed=4, parts=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4))
    y = (x[:, 0] + x[:, 1] * x[:, 2] + 0.3 * rng.normal(size=n) > 0).astype(int)
    data = [(i, *map(float, r), int(t), 1.5 if t else 0.75, i % 5, float(2 * r[0] + r[3])) for i, (r, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(data, "CustomerID long, a double, b double, c double, d double, Churn int, weight double, fold int, label double")
    return VectorAssembler(inputCols=list("abcd"), outputCol="features").transform(df).repartition(parts, "CustomerID")


def brute_cut(bins, y, w, k):
    """Impurity that the best cut takes away, by trying all cuts."""
    def lost(at):
        n, one = (w * k)[at].sum(), (w * k * y)[at].sum()
        return one * (n - one) / n if n else 0.0
    here = k > 0
    return max(lost(here) - lost(here & (bins[:, f] <= c)) - lost(here & (bins[:, f] > c)) for f in range(bins.shape[1]) for c in range(bins[:, f].max()))


@pytest.mark.parametrize("weights", ["one", "class", "row"])
def test_a_tree_takes_the_best_cuts_of_its_sample(weights):
    rng = np.random.default_rng(1)
    bins = rng.integers(0, 20, (600, 5)).astype(np.uint8)
    y = (bins[:, 1] + bins[:, 3] + rng.integers(0, 12, 600) > 25).astype(float)
    w = {"one": np.ones(600), "class": np.where(y == 1, 1.7, 0.6), "row": rng.random(600) + 0.5}[weights]
    key, last = rng.integers(-2 ** 62, 2 ** 62, 600), [np.arange(19)] * 5
    tree = next(iter(RF.fit_trees(B.Packed(bins), last, y, w, key, RF.Forest(1, 1), [0])))
    k = RF.draws(key, 42, 0)
    low = bins[:, tree.feature[0]] <= tree.cut[0]
    assert brute_cut(bins, y, w, k) == pytest.approx(tree.gain[0])
    for at, rows in ((tree.low[0], low), (tree.high[0], ~low)):
        assert tree.value[at] == pytest.approx((w * k * y)[rows].sum() / (w * k)[rows].sum())


def test_draws_are_poisson_and_follow_the_key():
    key = np.arange(40_000) * 7919
    k = RF.draws(key, 42, 3)
    assert k.mean() == pytest.approx(1, abs=0.02) and k.var() == pytest.approx(1, abs=0.04) and (k == 0).mean() == pytest.approx(np.exp(-1), abs=0.01)
    assert (RF.draws(key[::-1], 42, 3)[::-1] == k).all() and (RF.draws(key, 42, 4) != k).any()


def test_rows_of_one_key_are_drawn_apart():
    key = np.array([-9, 5, 5, 5, 8, *[11] * 4000])
    got = RF.apart(key)
    assert len(set(got.tolist())) == len(key) and (got[[0, 1, 4, 5]] == key[[0, 1, 4, 5]].astype(np.uint64)).all()
    k = RF.draws(got, 42, 0)[5:]
    assert k.mean() == pytest.approx(1, abs=0.08) and k.var() == pytest.approx(1, abs=0.15)
    assert len(RF.apart(key[:0])) == 0


def test_a_node_has_its_share_of_the_features_and_joined_leaves_differ():
    rng = np.random.default_rng(2)
    bins = rng.integers(0, 9, (3000, 9)).astype(np.uint8)
    y = (bins.sum(1) + rng.integers(0, 9, 3000) > 40).astype(float)
    args = [np.arange(8)] * 9, y, np.ones(3000), np.arange(3000)
    first = [t.feature[0] for t in RF.fit_trees(B.Packed(bins), *args, RF.Forest(40, 1, 1, "sqrt"), range(40))]
    assert len(set(first)) >= 6 and RF.Forest(1, 1, 1, "sqrt").features(42) == 7 and RF.Forest(1, 1, 1, "0.5").features(37) == 19
    for t in RF.fit_trees(B.Packed(bins), *args, RF.Forest(3, 5, 1, "sqrt", True), range(3)):
        for at, f in enumerate(t.feature):
            if f >= 0 and t.feature[t.low[at]] < 0 and t.feature[t.high[at]] < 0:
                assert (t.value[t.low[at]] > 0.5) != (t.value[t.high[at]] > 0.5)


def test_coarse_bins_hold_even_counts():
    rng = np.random.default_rng(3)
    bins = np.stack([rng.integers(0, 255, 20_000), rng.integers(0, 5, 20_000), np.where(rng.random(20_000) < 0.8, 0, rng.integers(0, 255, 20_000))], 1).astype(np.uint8)
    last = RF.coarse(bins, [254, 4, 254])
    assert len(last[0]) == 31 and last[1].tolist() == [0, 1, 2, 3] and 4 <= len(last[2]) <= 31
    share = np.bincount(np.searchsorted(last[0], bins[:, 0]), minlength=32) / 20_000
    assert share.max() < 2 / 32 and share.min() > 0.4 / 32


def results(df):
    return sorted((r.model, r.fold, r[2], r.p) for r in df.collect())


def test_folds_dont_depend_on_partitions_or_tasks(spark, monkeypatch):
    specs = {"a": RF.Forest(6, 3, 1, "sqrt", True), "b": RF.Forest(3, 2)}
    want = results(RF.cross_validate(B.bin_rows(table(spark), "features", "Churn", "CustomerID", "weight"), specs, range(5), "Churn"))
    assert len(want) == 800 and {r[0] for r in want} == {"a", "b"}
    monkeypatch.setattr(RF, "JOB_TREES", 2)
    got = results(RF.cross_validate(B.bin_rows(table(spark, parts=7), "features", "Churn", "CustomerID", "weight"), specs, range(5), "Churn"))
    assert [r[:3] for r in got] == [r[:3] for r in want] and np.allclose([r[3] for r in got], [r[3] for r in want])


def test_compared_forests_are_one_stage_and_as_good_as_mllibs(spark, monkeypatch):
    """200 trees and five folds don't take MLlib's jobs a level and fold."""
    df = table(spark, 1500)
    churn, revenue = {"n_estimators": 40, "max_depth": 6}, {"n_estimators": 20, "max_depth": 8}
    def scores():
        a = M.cross_validate(df, {"f": ("Random Forest", churn)}).agg(F.avg("pr_auc")).first()[0]
        return a, M.cross_validate_regression(df, {"f": ("Random Forest", revenue)}).agg(F.avg("r2")).first()[0]
    with monkeypatch.context() as m:
        m.setattr(M, "forest", lambda *a, **k: pytest.fail("fitted by MLlib"))
        got = scores()
    monkeypatch.setattr(RF, "MOST_DEPTH", 0)
    assert got == pytest.approx(scores(), abs=0.02)


def test_deep_or_distributed_forests_are_left_to_mllib(spark, monkeypatch):
    df = table(spark, 100)
    monkeypatch.setattr(RF, "cross_validate", lambda *a: pytest.fail("fitted in memory"))
    deep = {"n_estimators": 2, "max_depth": None}
    assert M.fold_predictions(df, {"f": ("Random Forest", deep)}).count() == 100
    monkeypatch.setattr(B, "LOCAL_BYTES", 0)
    assert M.fold_predictions(df, {"f": ("Random Forest", {"n_estimators": 2, "max_depth": 2})}).count() == 100


@pytest.mark.parametrize("name, key", [("Hist Gradient Boosting", "max_iter"), ("Random Forest", "n_estimators")])
def test_both_tuners_bin_the_rows_once(spark, monkeypatch, name, key):
    df, calls, bin_rows = table(spark, 120), [], B.bin_rows
    monkeypatch.setattr(B, "bin_rows", lambda *a: calls.append(1) or bin_rows(*a))
    monkeypatch.setattr(T, "N_RANDOM_TRIALS", 2)
    binned = M.Binned(df, "features", "Churn", "CustomerID", "weight")
    got = T.both_tuners(lambda points: M.search(df, name, points, binned=binned), {key: [2, 3], "max_depth": [2]}, {key: M.whole(2, 4), "max_depth": M.whole(1, 2)})
    assert len(calls) == 1 and [len(got[k]) for k in ("grid", "random")] == [2, 2]
    best = max(s for _, s in got["grid"] + got["random"])
    assert got["params"] in [p for p, s in got[got["tuner"]] if s == best]
