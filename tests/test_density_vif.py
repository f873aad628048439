import numpy as np
import pytest
from pyspark.sql import functions as F

from custaris.operators import association as A
from custaris.operators import density as KD


def exact(v, points=1000):
    h = v.std(ddof=1) * len(v) ** -0.2
    r = v.max() - v.min()
    x = np.linspace(v.min() - r / 2, v.max() + r / 2, points)
    return x, np.exp(-0.5 * ((x[:, None] - v) / h) ** 2).sum(1) / (len(v) * h * np.sqrt(2 * np.pi))


@pytest.mark.parametrize("make", [lambda r: r.normal(size=700), lambda r: np.exp(2 * r.normal(size=700)), lambda r: np.round(r.random(700) * 4)])
def test_density_against_the_exact_sum(spark, make):
    v = make(np.random.default_rng(2))
    df = spark.createDataFrame([(float(x), i % 2) for i, x in enumerate(v)] + [(None, 1)], "a double, y int")
    got = KD.kernel_density(df, ["a"], "y").toPandas().sort_values(["y", "point"])
    for y in (0, 1):
        x, want = exact(v[y::2])
        own = got[got.y == y]
        assert len(own) == 1000 and np.allclose(own.x, x)
        assert np.abs(own.density - want).max() < 1e-3 * want.max()


def test_density_needs_spread(spark):
    df = spark.createDataFrame([(1.0, 0), (1.0, 0), (3.0, 1), (2.0, None), (4.0, None)], "a double, y int")
    got = KD.kernel_density(df, ["a"], "y", 11).groupBy("y").agg(F.count("*").alias("n")).collect()
    assert [(r.y, r.n) for r in got] == [(None, 11)]


def vif(spark, x, names):
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{n} double" for n in names))
    return {r.feature: (r.vif, r.severity) for r in A.compute_vif(df, names).collect()}


def test_dependent_columns_are_infinite(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 4)) + 1
    x = np.hstack([x, x[:, :1], x[:, 1:2] + x[:, 2:3], np.zeros((200, 1))])
    got = vif(spark, x, list("abcdefg"))
    assert all(got[c] == (float("inf"), "severe") for c in "abcef")       # a = e, f = b + c
    g = x[:, [0, 1, 2, 3]].T @ x[:, [0, 1, 2, 3]]
    assert got["d"][0] == pytest.approx(g[3, 3] * np.linalg.inv(g)[3, 3])
    assert got["g"][0] is None


def test_independent_columns_as_by_regression(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 3))
    x[:, 2] = x[:, 0] * 0.9 + x[:, 2] * 0.3
    got = vif(spark, x, list("abc"))
    for i, c in enumerate("abc"):
        rest = np.delete(x, i, 1)
        resid = x[:, i] - rest @ np.linalg.lstsq(rest, x[:, i], rcond=None)[0]
        assert got[c][0] == pytest.approx((x[:, i] @ x[:, i]) / (resid @ resid))
