"""A target-encoding map too large for the fitted state is a joined table with the same results."""

from pyspark.sql import functions as F

from custaris.operators import features as FE
from custaris.operators import split as E


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_map_as_table_equals_inline_map(spark, tmp_path, monkeypatch):
    from custaris.plans.catalog import c360
    df = E.hash_split(c360(spark, "/root/testdata/sf0.001"), "CustomerID")
    inline = FE.fit_prep(df, F.col("split") == "train", passthrough=["split"])
    monkeypatch.setattr(FE, "MAX_INLINE", 2)
    table = FE.fit_prep(df, F.col("split") == "train", passthrough=["split"])
    assert inline.te_path is None and len(inline.te_rows) > 2
    assert table.te_path and table.te_rows == []
    assert table.features == inline.features and table.scale_mean == inline.scale_mean
    want = rows(inline.transform(df))
    assert rows(table.transform(df)) == want
    plan = table.transform(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" not in plan
    table.save(spark, str(tmp_path / "state"))
    back = FE.FittedPrep.load(spark, str(tmp_path / "state"))
    assert back.te_path != table.te_path
    assert rows(back.transform(df)) == want


def test_more_countries_than_the_inline_bound(spark):
    n = FE.MAX_INLINE + 50
    train = spark.range(2 * n).select((F.col("id") % n).cast("string").alias("Country"), (F.col("id") < n).cast("int").alias("y"))
    te = FE.target_encoding(train, "Country", "y")
    assert te.count() == n
    assert te.where("abs(Country_TargetEnc - 0.5) > 1e-12").count() == 0
