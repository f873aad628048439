import numpy as np
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import functions as F

from custaris.operators import isotonic as I
from custaris.operators import kmeans as K


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(1)
    mid = rng.normal(size=(6, 3)) * 6
    x = np.concatenate([m + rng.normal(size=(60, 3)) for m in mid])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "k long, a double, b double, c double")
    return VectorAssembler(inputCols=list("abc"), outputCol="features").transform(df).repartition(3, "k").persist(), x


def cost(x, centers):
    return ((x[:, None] - np.array(centers)[None]) ** 2).sum(2).min(1).sum()


def test_no_worse_than_the_library(points):
    df, x = points
    got = K.fit_many(df, range(2, 9), "k")
    for k, m in got.items():
        assert m.cost == pytest.approx(cost(x, m.centers)) and len(m.centers) == k
        theirs = min(KMeans(k=k, seed=s, maxIter=300).fit(df).summary.trainingCost for s in range(42, 47))
        assert m.cost <= theirs * (1 + 1e-6)
    assert all(got[k + 1].cost < got[k].cost for k in range(2, 8))


def test_same_result_on_any_partitioning(points):
    df, _ = points
    a = K.fit_many(df, [3, 5], "k", seeds=(1, 2))
    b = K.fit_many(df.repartition(7), [3, 5], "k", seeds=(1, 2))
    for k in (3, 5):
        assert np.allclose(a[k].centers, b[k].centers)


def test_centres_are_the_means_of_their_rows(points):
    df, _ = points
    m = K.fit_many(df, [4], "k")[4]
    means = m.transform(df).groupBy("Cluster").agg(*[F.avg(c).alias(c) for c in "abc"]).orderBy("Cluster").collect()
    assert np.allclose([[r.a, r.b, r.c] for r in means], m.centers, atol=0.05)


def test_copies_and_fewer_values_than_clusters(spark):
    df = VectorAssembler(inputCols=["a"], outputCol="features").transform(
        spark.createDataFrame([(i, float(i % 2)) for i in range(20)], "k long, a double"))
    m = K.fit_many(df, [3], "k", seeds=(1,))[3]
    assert m.cost == 0 and {r.Cluster for r in m.transform(df).collect()} <= {0, 1, 2}
    assert K.Centers.from_dict(m.to_dict()).centers == m.centers


def pav(rows):
    blocks = []
    for s, y in sorted(rows):
        blocks.append([s, s, 1, y])
    by = {}
    for s, _, w, y in blocks:
        by.setdefault(s, [0, 0])
        by[s][0] += w
        by[s][1] += y
    return I.pool([(s, s, w, y) for s, (w, y) in sorted(by.items())])


@pytest.mark.parametrize("parts", [1, 8, 64])
def test_ranges_pool_to_the_same_blocks(spark, parts):
    rng = np.random.default_rng(5)
    p = np.round(rng.random(800), 3)
    y = (rng.random(800) < p ** 2).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(p, y)], "p double, Churn int").repartition(5)
    got = I.fit(df, parts=parts)
    want = pav(list(zip(p.tolist(), y.tolist())))
    assert got.at == tuple(sorted({x for b in want for x in b[:2]}))
    theirs = IsotonicRegression(featuresCol="p", labelCol="Churn", weightCol="w", predictionCol="q").fit(
        df.groupBy("p").agg(F.avg("Churn").alias("Churn"), F.count("*").cast("double").alias("w")))
    both = theirs.transform(got.transform(df)).select("p_cal", "q").collect()
    assert np.allclose([r.p_cal for r in both], [r.q for r in both], atol=1e-9)


def test_one_score_nulls_and_saved_form(spark):
    df = spark.createDataFrame([(0.5, 1), (0.5, 0), (None, 1), (0.5, None)], "p double, Churn int")
    m = I.fit(df)
    assert m.value == (0.5,) and I.Isotonic.from_dict(m.to_dict()) == m
    assert [r.p_cal for r in m.transform(df).orderBy(F.col("p").asc_nulls_first()).collect()][0] is None
    with pytest.raises(ValueError):
        I.fit(df.where("p > 1"))
