"""Registered split / fold / weight queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import split as E
from .catalog import c360, finish, oracle, register

TEST_CUT = int(0.2 * E.HASH_SPACE)


def duck_hash(salt: str, key: str = "CustomerID") -> str:
    return f"CAST('0x' || substr(md5(CAST({key} AS VARCHAR) || ':{salt}'), 1, 8) AS BIGINT)"


DUCK_SPLIT = f"CASE WHEN {duck_hash('42')} < {TEST_CUT} THEN 'test' ELSE 'train' END"


@register("e01_stratified_split", oracle(f"SELECT CustomerID, Churn, {DUCK_SPLIT} AS split FROM c360"))
def e01(spark, sf):
    return E.hash_split(c360(spark, sf), "CustomerID").select("CustomerID", "Churn", "split")


@register("e01_split_balance", oracle(f"""
SELECT split, CAST(count(*) AS BIGINT) AS n, CAST(sum(Churn) AS BIGINT) AS n_pos, avg(CAST(Churn AS DOUBLE)) AS pos_rate
FROM (SELECT Churn, {DUCK_SPLIT} AS split FROM c360) GROUP BY split""", "pos_rate"))
def e01b(spark, sf):
    df = E.hash_split(c360(spark, sf), "CustomerID")
    return finish(df.groupBy("split").agg(F.count("*").cast("long").alias("n"),
                                          F.sum("Churn").cast("long").alias("n_pos"),
                                          F.avg(F.col("Churn").cast("double")).alias("pos_rate")))


@register("e01_exact_stratified_split", oracle(f"""
SELECT CustomerID, Churn, CASE WHEN rank() OVER (PARTITION BY Churn ORDER BY h) - 1
            < ceil(count(*) OVER (PARTITION BY Churn) * 0.2) THEN 'test' ELSE 'train' END AS split
FROM (SELECT CustomerID, Churn, {duck_hash('42')} AS h FROM c360)"""))
def e01x(spark, sf):
    return E.exact_stratified_split(c360(spark, sf), "CustomerID", "Churn").select("CustomerID", "Churn", "split")


@register("e02_hash_folds", oracle(f"""
SELECT CustomerID, CAST({duck_hash('fold42')} % 5 AS INTEGER) AS fold FROM c360"""))
def e02(spark, sf):
    return E.hash_folds(c360(spark, sf), "CustomerID").select("CustomerID", "fold")


@register("e02_fold_balance", oracle(f"""
SELECT CAST({duck_hash('fold42')} % 5 AS INTEGER) AS fold, CAST(count(*) AS BIGINT) AS n,
       avg(CAST(Churn AS DOUBLE)) AS pos_rate FROM c360 GROUP BY 1""", "pos_rate"))
def e02b(spark, sf):
    df = E.hash_folds(c360(spark, sf), "CustomerID")
    return finish(df.groupBy("fold").agg(F.count("*").cast("long").alias("n"),
                                         F.avg(F.col("Churn").cast("double")).alias("pos_rate")))


@register("e04_calibration_split", oracle(f"""
SELECT CustomerID, CASE WHEN {duck_hash('calib42')} < {TEST_CUT} THEN 'test' ELSE 'train' END AS calib_split
FROM c360 WHERE {DUCK_SPLIT} = 'train'"""))
def e04(spark, sf):
    df = E.hash_split(c360(spark, sf), "CustomerID")
    train = df.where(F.col("split") == "train")
    return E.hash_split(train, "CustomerID", salt="calib42", col="calib_split").select("CustomerID", "calib_split")


@register("e05_reference_current_halves", oracle(f"""
SELECT CustomerID, CASE WHEN {duck_hash('half42')} < {E.HASH_SPACE // 2} THEN 'reference' ELSE 'current' END AS side
FROM c360"""))
def e05(spark, sf):
    return E.time_or_hash_halves(c360(spark, sf), "CustomerID").select("CustomerID", "side")


@register("e06_balanced_weights", oracle("""
SELECT Churn, (SELECT count(*) FROM c360) / (2 * count(*)) AS weight, CAST(count(*) AS BIGINT) AS n
FROM c360 GROUP BY Churn""", "weight"))
def e06(spark, sf):
    df = E.balanced_weights(c360(spark, sf), "Churn")
    return finish(df.groupBy("Churn", "weight").agg(F.count("*").cast("long").alias("n")))


@register("e07_concat_train_test", oracle(f"""
SELECT split, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT 'train' AS split FROM c360 WHERE {DUCK_SPLIT} = 'train' UNION ALL
  SELECT 'test' FROM c360 WHERE {DUCK_SPLIT} = 'test') GROUP BY split"""))
def e07(spark, sf):
    df = E.hash_split(c360(spark, sf), "CustomerID")
    parts = [df.where(F.col("split") == s) for s in ("train", "test")]
    return E.concat_rows(parts).groupBy("split").agg(F.count("*").cast("long").alias("n"))
