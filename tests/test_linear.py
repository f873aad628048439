import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from custaris.operators import linear as L


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(600, 4)) * [1, 3, 0.2, 1]
    p = 1 / (1 + np.exp(-(0.4 + x @ [1.0, -0.5, 2.0, 0.0])))
    y = (rng.random(600) < p).astype(int)
    data = [(*map(float, r), int(t), float(1 + t), int(i % 5), float(2 + r[0] - r[1] + rng.normal() * 0.1)) for i, (r, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(data, "a double, b double, c double, d double, Churn int, weight double, fold int, label double")
    return VectorAssembler(inputCols=list("abcd"), outputCol="features").transform(df).repartition(3).persist()


@pytest.mark.parametrize("c", [0.01, 1.0, 100.0])
def test_newton_equals_the_library(rows, c):
    jobs = [L.LogisticJob("t", c, f) for f in (0, 3)] + [L.LogisticJob("t", c)]
    got = L.fit_logistic(rows, jobs)
    for j, m in zip(jobs, got):
        own = rows if j.leave is None else rows.where(F.col("fold") != j.leave)
        w = own.agg(F.sum("weight")).first()[0]
        want = LogisticRegression(regParam=1 / (c * w), elasticNetParam=0.0, standardization=False, maxIter=2000, tol=1e-14,
                                  weightCol="weight", labelCol="Churn").fit(own)
        assert np.allclose(m.coefficients, want.coefficients.toArray(), atol=1e-6)
        assert abs(m.intercept - want.intercept) < 1e-6


def test_jobs_do_not_depend_on_each_other(rows):
    jobs = [L.LogisticJob(str(c), c, f) for c in (0.1, 10.0) for f in range(5)]
    together = L.fit_logistic(rows, jobs)
    for j, m in zip(jobs, together):
        (alone,) = L.fit_logistic(rows, [j])
        assert np.allclose(alone.coefficients, m.coefficients, atol=1e-9)


def test_separable_rows_and_dependent_columns(spark):
    data = [(float(i), float(2 * i), int(i > 5), 1.0, i % 2) for i in range(12)]
    df = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(
        spark.createDataFrame(data, "a double, b double, Churn int, weight double, fold int"))
    (m,) = L.fit_logistic(df, [L.LogisticJob("t", 1e6)])
    p = [r.p for r in m.score(df, "p").orderBy("a").collect()]
    assert p[5] < 0.01 and p[6] > 0.99


def test_folds_predict_only_rows_left_out(rows):
    jobs = [L.LogisticJob(t, c, f) for t, c in (("x", 0.1), ("y", 5.0)) for f in range(5)]
    models = L.fit_logistic(rows, jobs)
    got = L.predict_folds(rows, {(j.tag, j.leave): m for j, m in zip(jobs, models)})
    assert got.count() == 2 * 600
    by = dict(zip([(j.tag, j.leave) for j in jobs], models))
    one = rows.where("fold = 2")
    want = sorted(r.p for r in by["y", 2].score(one, "p").collect())
    assert np.allclose(want, sorted(r.p for r in got.where("model = 'y' and fold = 2").collect()))


def test_ridge_folds_equal_the_library(rows):
    grams = L.fold_grams(rows)
    models = L.ridge_folds(grams, [0.1, 50.0])
    for (alpha, f), m in models.items():
        own = rows.where(F.col("fold") != f)
        n, sd = own.agg(F.count("*"), F.stddev_pop("label")).first()
        want = LinearRegression(solver="normal", regParam=alpha / n, elasticNetParam=0.0, standardization=False).fit(own)
        x = np.array([r.features.toArray() for r in own.collect()])
        y = np.array([r.label for r in own.collect()])
        xc, yc = x - x.mean(0), y - y.mean()
        b = np.linalg.solve(xc.T @ xc + alpha * np.eye(4), xc.T @ yc)
        assert np.allclose(m.coefficients, b, atol=1e-8) and abs(m.intercept - (y.mean() - x.mean(0) @ b)) < 1e-8
        if alpha < 1:  # the library scales its penalty by the label's spread; small ones agree closely
            assert np.allclose(m.coefficients, want.coefficients.toArray(), atol=1e-2)


def test_a_fold_without_other_rows_is_an_error(spark):
    df = VectorAssembler(inputCols=["a"], outputCol="features").transform(
        spark.createDataFrame([(1.0, 1, 1.0, 0)], "a double, Churn int, weight double, fold int"))
    with pytest.raises(ValueError):
        L.fit_logistic(df.where("fold = 9"), [L.LogisticJob("t", 1.0)])


def test_penalised_intercept(rows):
    """The intercept as one more column of ones whose penalty is the others'."""
    (m,) = L.fit_logistic(rows, [L.LogisticJob("t", 0.01, None, True)])
    (free,) = L.fit_logistic(rows, [L.LogisticJob("t", 0.01)])
    assert abs(m.intercept) < abs(free.intercept)
    x = np.array([[1, *r.features.toArray()] for r in rows.orderBy("a").collect()])
    y, w = (np.array([r[c] for r in rows.orderBy("a").collect()]) for c in ("Churn", "weight"))
    b = np.array([m.intercept, *m.coefficients])
    g = x.T @ (w * (1 / (1 + np.exp(-x @ b)) - y)) + b / 0.01
    assert np.abs(g).max() < 1e-4
