import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler

from custaris.operators import boosting as B


def table(spark, n=500, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4))
    m = 1.5 * x[:, 0] + np.where(x[:, 1] > 0.3, 2, -1) + x[:, 2] * x[:, 0]
    y = (rng.random(n) < 1 / (1 + np.exp(-m))).astype(int)
    data = [(i, *map(float, r), int(t), float(1 + (i % 3)), i % 5, float(v)) for i, (r, t, v) in enumerate(zip(x, y, m))]
    df = spark.createDataFrame(data, "k long, a double, b double, c double, d double, Churn int, weight double, fold int, label double")
    return VectorAssembler(inputCols=list("abcd"), outputCol="features").transform(df).repartition(3, "k")


@pytest.fixture(scope="module")
def rows(spark):
    return B.bin_rows(table(spark), "features", "Churn", "k", "weight")


@pytest.fixture(scope="module")
def reals(spark):
    return B.bin_rows(table(spark), "features", "label", "k")


def same(a, b):
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert (x.feature, x.cut, x.low, x.high) == (y.feature, y.cut, y.low, y.high)
        assert np.allclose(x.value, y.value, atol=1e-9)


@pytest.mark.parametrize("spec, leave", [
    (B.Boost(rounds=5, depth=3), None), (B.Boost(rounds=3, depth=4, l2=7.0, least=3, leaves=6), 2),
    (B.Boost(rounds=4, depth=2, subsample=0.6, least=1, leaves=None), 1)])
def test_broadcast_and_distributed_rows_give_the_same_trees(rows, monkeypatch, spec, leave):
    near = B.fit(rows, spec, leave)
    monkeypatch.setattr(B, "LOCAL_BYTES", 0)
    monkeypatch.setattr(B, "REFRESH", 2)
    far = B.fit(rows, spec, leave)
    assert near.start == pytest.approx(far.start)
    same(near.trees, far.trees)


def test_folds_of_both_ways_agree_and_prefixes_are_shorter_runs(reals, monkeypatch):
    specs = {"a": B.Boost("squared", 4, 0.3, 3, least=5), "b": B.Boost("squared", 2, 0.3, 3, least=5), "c": B.Boost("squared", 3, 0.1, 2, least=5)}
    def means(df):
        return {(r["model"], r["fold"]): r["s"] for r in df.groupBy("model", "fold").agg({"p": "sum"}).withColumnRenamed("sum(p)", "s").collect()}
    near = means(B.cross_validate(reals, specs, range(5), "label"))
    alone = means(B.cross_validate(reals, {"b": specs["b"]}, range(5), "label"))
    monkeypatch.setattr(B, "LOCAL_BYTES", 0)
    monkeypatch.setattr(B, "REFRESH", 2)
    far = means(B.cross_validate(reals, specs, range(5), "label"))
    assert set(near) == {(m, f) for m in "abc" for f in range(5)}
    assert near == pytest.approx(far) and all(near["b", f] == pytest.approx(alone["b", f]) for f in range(5))


def brute_stump(x, g, h, l2, least):
    """Best cut of one node by trying every pair of neighbouring values."""
    best = (0, None, None)
    for j in range(x.shape[1]):
        for v in np.unique(x[:, j])[:-1]:
            left = x[:, j] <= v
            if min(left.sum(), (~left).sum()) >= least:
                gain = g[left].sum() ** 2 / (h[left].sum() + l2) + g[~left].sum() ** 2 / (h[~left].sum() + l2) - g.sum() ** 2 / (h.sum() + l2)
                if gain > best[0] + 1e-9:
                    best = (gain, j, left)
    return best


@pytest.mark.parametrize("l2", [0.0, 5.0])
def test_a_stump_is_the_best_cut(spark, l2):
    df = table(spark, 90)                        # fewer rows than bins: cut points at every value
    got = B.fit(B.bin_rows(df, "features", "Churn", "k", "weight"), B.Boost(rounds=1, rate=1.0, depth=1, l2=l2, least=5))
    data = df.collect()
    x = np.array([r.features.toArray() for r in data])
    y, w = np.array([r.Churn for r in data], float), np.array([r.weight for r in data])
    p = (w @ y) / w.sum()
    g, h = w * (y - p), w * p * (1 - p)
    _, j, left = brute_stump(x, g, h, l2, 5)
    t = got.trees[0]
    assert t.feature[0] == j
    assert t.value[t.low[0]] == pytest.approx(g[left].sum() / (h[left].sum() + l2))
    assert t.value[t.high[0]] == pytest.approx(g[~left].sum() / (h[~left].sum() + l2))


def test_loss_falls_and_l2_shrinks(spark, rows, reals):
    df = table(spark)
    long = B.fit(reals, B.Boost("squared", 60, 0.2, 3, least=5))
    err = [float(np.mean([(r.p - r.label) ** 2 for r in B.BoostedTrees("squared", long.start, long.trees[:k], long.edges).score(df, "p").collect()]))
           for k in (0, 10, 60)]
    assert err[0] > 3 * err[1] > 6 * err[2]
    free, held = B.fit(rows, B.Boost(rounds=1, depth=3)), B.fit(rows, B.Boost(rounds=1, depth=3, l2=100.0))
    assert max(map(abs, held.trees[0].value)) < max(map(abs, free.trees[0].value))


def test_limits_of_a_tree(rows):
    m = B.fit(rows, B.Boost(rounds=2, depth=6, least=4, leaves=7))
    for t in m.trees:
        assert t.feature.count(-1) <= 7
    whole = B.fit(rows, B.Boost(rounds=1, depth=3, least=10_000))
    assert whole.trees[0].feature == [-1]


def test_saved_model_scores_alike(spark, rows):
    df = table(spark, 50, 9)
    m = B.fit(rows, B.Boost(rounds=6, depth=2))
    import json
    again = B.BoostedTrees.from_dict(json.loads(json.dumps(m.to_dict())))
    a, b = ([r.p for r in x.score(df, "p").orderBy("k").collect()] for x in (m, again))
    assert a == b and sum(m.importances()) == pytest.approx(1) and len(m.importances()) == 4


def test_missing_values_and_constant_columns(spark):
    data = [(i, float("nan") if i % 4 == 0 else float(i), 1.0, int(i % 4 == 0), 1.0, i % 5) for i in range(80)]
    df = VectorAssembler(inputCols=["a", "b"], outputCol="features", handleInvalid="keep").transform(
        spark.createDataFrame(data, "k long, a double, b double, Churn int, weight double, fold int"))
    m = B.fit(B.bin_rows(df, "features", "Churn", "k", "weight"), B.Boost(rounds=20, depth=2, least=5, rate=0.3))
    p = {r.k: r.p for r in m.score(df, "p").collect()}
    assert min(p[i] for i in range(0, 80, 4)) > max(p[i] for i in range(80) if i % 4)
