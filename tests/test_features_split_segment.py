"""Fitted transform, splits and segmentation rules."""

from pyspark.sql import functions as F

from custaris.operators import features as FE
from custaris.operators import segment as SG
from custaris.operators import split as E


def test_target_encoding_literals(spark):
    df = spark.createDataFrame([("a", 1), ("a", 0), ("b", 1)], "Country string, y int")
    te = {r[0]: r[1] for r in FE.target_encoding(df, "Country", "y", 10.0).collect()}
    assert abs(te["a"] - 0.638889) < 1e-6 and abs(te["b"] - 0.696970) < 1e-6


def test_split_disjoint_exhaustive_and_exact(spark):
    df = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    s = E.hash_split(df, "k")
    assert s.count() == 1000 and s.select("k").distinct().count() == 1000
    x = E.exact_stratified_split(df, "k", "y").groupBy("y", "split").count().collect()
    got = {(r["y"], r["split"]): r["count"] for r in x}
    assert got[(1, "test")] == 67 and got[(0, "test")] == 134


def test_fitted_prep_round_trip(spark):
    import __spark_entry__  # noqa: F401  (path setup)
    from custaris.plans.catalog import c360
    df = E.hash_split(c360(spark, "/root/testdata/sf0.001"), "CustomerID")
    prep = FE.fit_prep(df, F.col("split") == "train", passthrough=["split"])
    back = FE.FittedPrep.from_json(prep.to_json())
    assert back == prep
    a = prep.transform(df).orderBy("CustomerID").limit(20).collect()
    b = back.transform(df).orderBy("CustomerID").limit(20).collect()
    assert a == b
    train = prep.transform(df.where(F.col("split") == "train"))
    means = train.agg(*[F.avg(c).alias(c) for c in prep.features[:10]]).first()
    assert all(abs(v) < 1e-9 for v in means)


def test_cluster_naming_rule():
    rows = [{"Cluster": 0, "Churn": 0.70, "Frequency": 1.0, "MonetaryTotal": 1.0},
            {"Cluster": 1, "Churn": 0.65, "Frequency": 5.0, "MonetaryTotal": 9.0},
            {"Cluster": 2, "Churn": 0.40, "Frequency": 9.0, "MonetaryTotal": 5.0}]
    names = SG.name_clusters(rows)
    assert names[0][1] == "Lost / Churned"
    assert names[1][1] == "At Risk"
    assert names[2][1] == "Loyal"


def test_final_k_rule():
    assert SG.final_k(4, {2: 0.6, 3: 0.5}) == 4
    assert SG.final_k(2, {2: 0.2, 3: 0.22}) == 3
    assert SG.final_k(2, {2: 0.3, 3: 0.5}) == 3
