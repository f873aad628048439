"""Registered source queries (S1-S7): the customer-360 builder and round trips."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import sig_col
from ..session import ensure_checkpoint_dir
from .catalog import _fingerprint, oracle, register
from .q_split import DUCK_SPLIT
from .customer360 import build_customer360


@register("s01_customer360_table", oracle("SELECT * FROM c360", "MonetaryStd"))
def s01(spark, sf):
    """Customer-360 builder over the raw tables (always rebuilt, never cached).

    Every column is exact (decimal money, integer counts, correctly rounded
    ratios) except the per-customer standard deviation, which is rounded.
    """
    df = build_customer360(spark, sf)
    return df.withColumn("MonetaryStd", sig_col(F.col("MonetaryStd")))


@register("s01_customer_csv_round_trip", oracle("""
SELECT CAST(count(*) AS BIGINT) AS n, CAST(count_if(Age IS NULL) AS BIGINT) AS n_age_null,
       CAST(sum(Frequency) AS BIGINT) AS total_orders, CAST(count(DISTINCT Country) AS BIGINT) AS n_countries,
       max(MonetaryTotal) AS max_monetary FROM c360""", "max_monetary"))
def s01csv(spark, sf):
    """The wide customer table written as header CSV and read back with the explicit schema."""
    from ..sources.tables import read_customers, write_table
    from .catalog import c360, finish
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/custaris-csv-{_fingerprint(sf)}"
    write_table(c360(spark, sf), path, fmt="csv")
    df = read_customers(spark, path)
    return finish(df.agg(F.count("*").cast("long").alias("n"), F.count_if(F.col("Age").isNull()).cast("long").alias("n_age_null"),
                         F.sum("Frequency").cast("long").alias("total_orders"),
                         F.count_distinct("Country").cast("long").alias("n_countries"),
                         F.max("MonetaryTotal").alias("max_monetary")))


@register("s03_split_parquet_round_trip", oracle(f"""
SELECT split, CAST(count(*) AS BIGINT) AS n, CAST(sum(Churn) AS BIGINT) AS n_pos
FROM (SELECT Churn, {DUCK_SPLIT} AS split FROM c360) GROUP BY split"""))
def s03(spark, sf):
    """S3: train/test written partitioned by split, read back with partition pruning."""
    from ..operators import split as E
    from ..sources.tables import write_split
    from .catalog import c360
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/custaris-split-{_fingerprint(sf)}"
    write_split(E.hash_split(c360(spark, sf), "CustomerID"), path)
    back = spark.read.parquet(path)
    return back.groupBy("split").agg(F.count("*").cast("long").alias("n"), F.sum("Churn").cast("long").alias("n_pos"))


@register("s05_fitted_state_round_trip")
def s05(spark, sf):
    """Fitted transform state saved to parquet, loaded, and re-applied (identical output)."""
    from ..operators import features as FE
    from ..operators import split as E
    from .catalog import c360
    df = E.hash_split(c360(spark, sf), "CustomerID")
    prep = FE.fit_prep(df, F.col("split") == "train", passthrough=["split"])
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/custaris-prep-{_fingerprint(sf)}"
    prep.save(spark, path)
    back = FE.FittedPrep.load(spark, path)
    a = prep.transform(df).select("CustomerID", F.array(*prep.features).alias("a"))
    b = back.transform(df).select("CustomerID", F.array(*back.features).alias("b"))
    j = a.join(b, "CustomerID")
    return j.agg(F.count("*").cast("long").alias("n"),
                 F.count_if(F.col("a") != F.col("b")).cast("long").alias("n_different"),
                 F.lit(back == prep).alias("state_equal"))
