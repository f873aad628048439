"""Rules of a decision tree (M16, S9): node table, root-to-leaf conditions, class counts, rule text.

The node table is the saved tree's own data.  Conditions are found by a recursive walk from the root over that table, and
class counts by routing rows with one expression; both are as large as the tree, the rows are scanned once.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def nodes(spark: SparkSession, path: str, features: Sequence[str], mean: Mapping[str, float], std: Mapping[str, float]) -> DataFrame:
    """Nodes of a saved MLlib tree: split feature, threshold (scaled and original units), children, prediction, class weights."""
    raw = spark.read.parquet(f"{path}/data")
    if "nodeData" in raw.columns:
        raw = raw.select("nodeData.*")
    names = F.array(*[F.lit(c) for c in features])
    inner = F.col("leftChild") >= 0
    x = raw.select("id", "prediction", "impurity", "gain", "leftChild", "rightChild",
                   F.when(inner, F.col("split.featureIndex")).alias("index"),
                   F.when(inner, F.element_at(names, F.col("split.featureIndex") + 1)).alias("feature"),
                   F.when(inner, F.col("split.leftCategoriesOrThreshold")[0]).alias("threshold"),
                   F.col("impurityStats")[0].alias("weight_class0"), F.col("impurityStats")[1].alias("weight_class1"))
    known = [f for f in features if f in mean and f in std]
    scale = spark.createDataFrame([(f, float(mean[f]), float(std[f])) for f in known], "feature string, mean double, std double")
    return x.join(F.broadcast(scale), "feature", "left").select(  # a row a feature
        *x.columns, (F.col("threshold") * F.col("std") + F.col("mean")).alias("threshold_original"))


def leaf_counts(rows: DataFrame, tree: DataFrame, features: str, label: str) -> DataFrame:
    """(id, n_class0, n_class1) of every leaf: rows are routed by the tree's conditions, one scan."""
    table = {r["id"]: r for r in tree.select("id", "leftChild", "rightChild", "index", "threshold").collect()}  # the tree's nodes
    x = F.col("__x")

    def leaf(i):
        n = table[i]
        if n["leftChild"] < 0:
            return F.lit(i)
        return F.when(F.get(x, F.lit(n["index"])) <= n["threshold"], leaf(n["leftChild"])).otherwise(leaf(n["rightChild"]))
    at = rows.select(vector_to_array(F.col(features)).alias("__x"), F.col(label).alias("__y")).select(leaf(0).alias("id"), "__y")
    return at.groupBy("id").agg(F.count_if(F.col("__y") != 1).alias("n_class0"), F.count_if(F.col("__y") == 1).alias("n_class1"))


def conditions(spark: SparkSession, tree: DataFrame) -> DataFrame:
    """(id, depth, condition) of every node, by a recursive walk from the root."""
    return spark.sql("""
        WITH RECURSIVE edges AS (
            SELECT id AS parent, leftChild AS child, concat(feature, ' <= ', format_number(threshold, 4)) AS said FROM {tree} WHERE leftChild >= 0
            UNION ALL
            SELECT id, rightChild, concat(feature, ' > ', format_number(threshold, 4)) FROM {tree} WHERE rightChild >= 0),
        walk(id, depth, condition) AS (
            SELECT 0, 0, CAST('' AS STRING)
            UNION ALL
            SELECT e.child, w.depth + 1, CASE WHEN w.condition = '' THEN e.said ELSE concat(w.condition, ' and ', e.said) END
            FROM walk w JOIN edges e ON e.parent = w.id)
        SELECT id, depth, condition FROM walk""", tree=tree)


def leaf_rules(spark: SparkSession, tree: DataFrame, counts: DataFrame) -> DataFrame:
    """One row a leaf: id, depth, condition, class counts of the routed rows, majority label."""
    leaves = tree.where("leftChild < 0").select("id", "prediction")
    r = conditions(spark, tree).join(leaves, "id").join(counts, "id", "left")
    return r.select("id", "depth", "condition", F.coalesce("n_class0", F.lit(0)).alias("n_class0"), F.coalesce("n_class1", F.lit(0)).alias("n_class1"),
                    F.when(F.col("prediction") == 1, "Churn").otherwise("Fidèle").alias("majority"))


def rule_text(rules: DataFrame) -> DataFrame:
    """``if ... then label (n Fidèle, m Churn)`` for every leaf, in the tree's order."""
    said = F.when(F.col("condition") == "", F.lit("always")).otherwise(F.concat(F.lit("if "), F.col("condition")))
    return rules.orderBy("id").select(F.concat(said, F.lit(" then "), F.col("majority"), F.lit(" ("), F.col("n_class0").cast("string"),
                                               F.lit(" Fidèle, "), F.col("n_class1").cast("string"), F.lit(" Churn)")).alias("rule"))


def write_rules(rules: DataFrame, path: str) -> DataFrame:
    """The rule text as a text file, read back."""
    rule_text(rules).coalesce(1).write.mode("overwrite").text(path)
    return rules.sparkSession.read.text(path).withColumnRenamed("value", "rule")
