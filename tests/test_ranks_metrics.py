"""Distributed ordered statistics against brute force on small fixtures."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from custaris.operators import drift as D
from custaris.operators import metrics as X
from custaris.operators import profile as P
from custaris.operators import ranks as R


def test_exact_quantiles_match_numpy_with_hot_value(spark):
    rng = np.random.default_rng(7)
    vals = np.concatenate([rng.normal(size=600), np.full(300, 2.5), rng.integers(0, 5, 100).astype(float)])
    groups = np.array(["a"] * 500 + ["b"] * 500)
    pdf = pd.DataFrame({"g": groups, "v": vals})
    df = spark.createDataFrame(pdf)
    probs = [0, 0.1, 0.25, 0.5, 0.75, 0.99, 1]
    got = R.exact_quantiles(df, ["g"], "v", probs).toPandas()
    for g, sub in pdf.groupby("g"):
        exp = np.quantile(sub["v"].to_numpy(), probs)
        res = got[got.g == g].sort_values("prob")["quantile"].to_numpy()
        assert np.allclose(res, exp, rtol=0, atol=1e-12)


def test_quantiles_over_many_buckets_and_without_group(spark):
    v = np.random.default_rng(3).normal(size=20_000)
    got = R.exact_quantiles(spark.createDataFrame(pd.DataFrame({"v": v})), [], "v", [0, 0.013, 0.5, 0.999, 1]).toPandas()
    assert np.allclose(got.sort_values("prob")["quantile"], np.quantile(v, [0, 0.013, 0.5, 0.999, 1]), rtol=0, atol=1e-12)


def test_null_groups_are_kept(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), (None, 5.0), (None, 7.0)], "g string, v double")
    out = {(r.g, r.v): (r["__c_before"], r["__c_total"]) for r in R.prefix_sums(R.value_counts(df, ["g"], "v"), ["g"], "v", ["__c"]).collect()}
    assert out == {("a", 1.0): (0, 2), ("a", 2.0): (1, 2), (None, 5.0): (0, 2), (None, 7.0): (1, 2)}
    assert {r.g: r.quantile for r in R.exact_quantiles(df, ["g"], "v", [0.5]).collect()} == {"a": 1.5, None: 6.0}


def test_prefix_sums_exact(spark):
    pdf = pd.DataFrame({"v": np.arange(200) % 37, "w": 1})
    vc = R.value_counts(spark.createDataFrame(pdf), [], "v")
    exp = pdf.groupby("v").size().cumsum().shift(fill_value=0).to_numpy()
    out = R.prefix_sums(vc, [], "v", ["__c"]).toPandas().sort_values("v")
    assert (out["__c_before"].to_numpy() == exp).all()
    assert (out["__c_total"] == 200).all()


def test_mode_smallest_on_ties(spark):
    df = spark.createDataFrame([(1,), (2,), (2,), (1,), (3,)], "v int")
    assert R.mode_of(df, [], "v").first()[0] == 1


def test_auc_ties_half(spark):
    df = spark.createDataFrame([(0, 0.5), (1, 0.5)], "y int, s double")
    assert X.roc_auc(df, "y", "s").first()["auc"] == 0.5


def test_auc_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 300)
    s = np.round(rng.random(300) + 0.3 * y, 2)
    df = spark.createDataFrame(pd.DataFrame({"y": y, "s": s}))
    pos, neg = s[y == 1], s[y == 0]
    brute = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))
    assert abs(X.roc_auc(df, "y", "s").first()["auc"] - brute) < 1e-12


def test_f2_threshold_floor_when_all_below(spark):
    df = spark.createDataFrame([(0, 0.1), (1, 0.2), (1, 0.3)], "y int, s double")
    assert X.f2_threshold(df, "y", "s", 0.40).first()["threshold"] == 0.40


def test_adjusted_skewness(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (9.0,), (30.0,)], "x double")
    got = P.skewness_table(df, ["x"]).first()["skew"]
    assert abs(got - 1.897467) < 1e-6


def test_correlation_constant_column_is_null(spark):
    from custaris.operators import association as A
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0), (1.0, 3.0)], "a double, b double")
    assert A.correlation_matrix(df, ["a", "b"]).first()["r"] is None


def test_qcut_repeated_edges(spark):
    df = spark.createDataFrame([(1.0, 0), (1.0, 1), (1.0, 0), (2.0, 1)], "x double, y int")
    out = P.qcut_rate(df, "y", "x", 4).collect()
    assert 1 <= len(out) < 4


def test_ks_identical_and_small(spark):
    rows = [("reference", float(i)) for i in range(10)] + [("current", float(i)) for i in range(10)]
    df = spark.createDataFrame(rows, "side string, a double")
    ks = D.ks_statistics(df, "side", ["a"]).first()
    assert ks["ks_stat"] == 0.0
    small = spark.createDataFrame([("reference", 1.0), ("current", 2.0)], "side string, a double")
    assert D.ks_statistics(small, "side", ["a"]).count() == 0
    assert D.drift_table(D.ks_statistics(small, "side", ["a"])).columns == \
        ["feature", "ks_stat", "p_value", "ref_mean", "cur_mean"]


def test_ks_pvalue_reasonable():
    assert D.ks_pvalue(0.0, 100, 100) == 1.0
    assert D.ks_pvalue(0.5, 100, 100) < 1e-8


def test_grouped_metrics_equal_single_group_metrics(spark):
    from custaris.operators import models as M
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"fold": rng.integers(0, 3, 600), "Churn": rng.integers(0, 2, 600)})
    pdf["p"] = np.round(rng.random(600) * 0.6 + 0.3 * pdf.Churn, 3)
    pdf["model"] = "m"
    g = M.grouped_binary_metrics(spark.createDataFrame(pdf), ["model", "fold"]).toPandas()
    for f, sub in pdf.groupby("fold"):
        d = spark.createDataFrame(sub)
        r = g[g.fold == f].iloc[0]
        assert abs(r.roc_auc - X.roc_auc(d, "Churn", "p").first()[0]) < 1e-12
        assert abs(r.pr_auc - X.pr_areas(d, "Churn", "p").first()[0]) < 1e-12
        c = X.prf(X.threshold_counts(d, "Churn", "p", 0.5)).first()
        assert abs(r.recall - c["recall"]) < 1e-12 and abs(r.f1 - c["f1"]) < 1e-12
