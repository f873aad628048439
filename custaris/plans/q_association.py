"""Registered association / leakage queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import association as A
from .catalog import c360, finish, oracle, register
from .customer360 import NUMERIC_FEATURES
from .sqlfrag import pairs_sql

CORR_COLS = NUMERIC_FEATURES + ["Churn"]
PAIRS = [(CORR_COLS[i], CORR_COLS[j]) for i in range(len(CORR_COLS)) for j in range(i + 1, len(CORR_COLS))]
TARGET_PAIRS = [(c, "Churn") for c in NUMERIC_FEATURES]
VIF_COLS = NUMERIC_FEATURES


@register("c01_correlation_matrix", oracle(pairs_sql(PAIRS), "r"))
def c01(spark, sf):
    return finish(A.correlation_matrix(c360(spark, sf), CORR_COLS))


_TARGET = f"SELECT feature_a AS feature, r, abs(r) AS abs_r FROM ({pairs_sql(TARGET_PAIRS)})"


@register("c02_target_correlation", oracle(_TARGET, "r abs_r"))
def c02(spark, sf):
    return finish(A.target_correlations(c360(spark, sf), NUMERIC_FEATURES, "Churn"))


@register("c03_leak_tiers", oracle(f"""
SELECT feature, r, abs_r, CASE WHEN abs_r > 0.70 THEN 'high' WHEN abs_r > 0.40 THEN 'medium' ELSE 'low' END AS tier,
       abs_r > 0.5 AS leaky_flag, abs_r > 0.3 AS strong_flag FROM ({_TARGET})""", "r abs_r"))
def c03(spark, sf):
    return finish(A.leak_tiers(A.target_correlations(c360(spark, sf), NUMERIC_FEATURES, "Churn")))


@register("c04_point_biserial", oracle(f"""
SELECT feature_a AS feature, r, n, r * sqrt(CASE WHEN 1 - r * r <> 0 THEN (n - 2) / (1 - r * r) END) AS t,
       n - 2 AS dof FROM ({pairs_sql(TARGET_PAIRS)})""", "r t"))
def c04(spark, sf):
    return finish(A.point_biserial(c360(spark, sf), NUMERIC_FEATURES, "Churn"))


@register("c04_point_biserial_pvalue")
def c04p(spark, sf):
    """C4 with two-sided Student-t p-values (p computed on the per-feature rows)."""
    return finish(A.point_biserial_pvalues(A.point_biserial(c360(spark, sf), NUMERIC_FEATURES, "Churn")))


@register("c05_pairs_above_threshold", oracle(f"""
SELECT * FROM ({pairs_sql(PAIRS)}) WHERE abs(r) > 0.7""", "r"))
def c05(spark, sf):
    return finish(A.pairs_above(A.correlation_matrix(c360(spark, sf), CORR_COLS), 0.7))


@register("c06_multicollinear_drops", oracle(f"""
SELECT feature_b AS feature, feature_a AS partner, r FROM ({pairs_sql([p for p in PAIRS if 'Churn' not in p])})
WHERE abs(r) > 0.8""", "r"))
def c06(spark, sf):
    return finish(A.multicollinear_drops(c360(spark, sf), CORR_COLS, 0.8, exclude=["Churn"]))


def _gram_sql():
    cols = VIF_COLS
    clean = " AND ".join(f"{c} IS NOT NULL" for c in cols)
    items = ", ".join(f"{{'feature_a': '{a}', 'feature_b': '{b}', 'xtx': sum(CAST({a} AS DOUBLE) * CAST({b} AS DOUBLE)), "
                      f"'n_rows': CAST(count(*) AS BIGINT)}}"
                      for i, a in enumerate(cols) for j, b in enumerate(cols) if j >= i)
    return f"SELECT unnest(l, recursive := true) FROM (SELECT [{items}] AS l FROM c360 WHERE {clean})"


@register("c07_gram_matrix", oracle(_gram_sql(), "xtx"))
def c07g(spark, sf):
    return finish(A.gram_matrix(c360(spark, sf), VIF_COLS))


@register("c07_vif")
def c07(spark, sf):
    """VIF from the Spark-aggregated Gram matrix (k×k inverse on the driver)."""
    return finish(A.compute_vif(c360(spark, sf), VIF_COLS))
