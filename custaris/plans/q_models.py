"""Registered model queries: churn (M1-M3, M8-M16), revenue (M4-M6), C8-C10, D4.

Each query asks the training's stages (see ``training``) for what it shows;
fitted state comes from the model store.  Model outputs depend on numerical
optimisation, so most of these queries have no DuckDB twin; tests check their
properties.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import association as A
from ..operators import drift as D
from ..operators import metrics as X
from ..operators import models as M
from ..operators import rules as R
from . import training as T
from .catalog import finish, register

# fixed values: suspect columns of the leak check
SUSPECTS = ["AccountStatus_Closed", "AccountStatus_Suspended", "AccountStatus_Pending", "CustomerType_Perdu",
            "CustomerType_Régulier", "CustomerType_Hyperactif", "CustomerType_Occasionnel", "CustomerType_Nouveau"]


@register("m10_cv_fold_metrics")
def m10f(spark, sf):
    """M1-M3 + M10: per model and fold PR-AUC, ROC-AUC, F1, recall (hash folds)."""
    return finish(T.churn_folds(spark, sf))


@register("m10_cv_summary")
def m10(spark, sf):
    """Mean and population std over the five folds per model."""
    return finish(M.cv_summary(T.churn_folds(spark, sf)))


@register("m11_raw_vs_pca")
def m11(spark, sf):
    """Mean PR-AUC of every model on raw features and on PCA components; ``chosen`` marks the pair that goes on."""
    c = T.churn_choice(spark, sf, True)
    kind, k = "pca" if c["use_pca"] else "raw", T.churn_pca(spark, sf)[0].getK()
    return finish(spark.createDataFrame(
        [(n, float(c["raw"][n]), float(c["reduced"][n]), int(k), kind if n == c["model"] else None) for n in M.CHURN_MODELS],
        "model string, pr_auc_raw double, pr_auc_pca double, pca_components int, chosen string"))


@register("f27_explained_variance")
def f27(spark, sf):
    """explained variance ratio and cumulative share of the first ≤ 40 components."""
    ev = T.churn_pca(spark, sf)[1]
    rows, cum = [], 0.0
    for i, v in enumerate(ev[:40]):
        cum += v
        rows.append((i + 1, float(v), float(cum)))
    return finish(spark.createDataFrame(rows, "component int, ratio double, cumulative double"))


def _trials(res, tuner):
    return [(tuner, i, str(sorted(p.items())), float(s)) for i, (p, s) in enumerate(res)]


@register("m12_grid_search")
def m12(spark, sf):
    r = T.churn_trials(spark, sf)
    return finish(spark.createDataFrame(_trials(r["grid"], "grid"), "tuner string, trial int, params string, pr_auc double"))


@register("m13_random_search")
def m13(spark, sf):
    r = T.churn_trials(spark, sf)
    return finish(spark.createDataFrame(_trials(r["random"], "random"), "tuner string, trial int, params string, pr_auc double"))


@register("m14_tuner_choice")
def m14(spark, sf):
    r = T.churn_trials(spark, sf)
    g = max(s for _, s in r["grid"])
    q = max(s for _, s in r["random"])
    return finish(spark.createDataFrame([(r["best_name"], g, q, r["tuner"], str(sorted(r["params"].items())))],
                                        "model string, grid_best double, random_best double, chosen string, params string"))


@register("m09_calibration_moments")
def m09(spark, sf):
    """M9 + X14: probability mean/std before and after isotonic calibration (test rows)."""
    t = T.churn_run(spark, sf).test()
    return finish(t.agg(F.avg("p").alias("mean_before"), F.stddev_pop("p").alias("std_before"),
                        F.avg("p_cal").alias("mean_after"), F.stddev_pop("p_cal").alias("std_after")))


@register("x07_model_f2_threshold")
def x07m(spark, sf):
    """X7 on the calibration rows (not the test rows) for the final, tuned model."""
    return finish(X.f2_threshold(T.churn_run(spark, sf).calibration(), "Churn", "p_cal", T.THRESHOLD_FLOOR))


@register("x01_x05_model_test_metrics")
def xtest(spark, sf):
    """X1-X5 of the calibrated model on the test rows at the tuned threshold."""
    r = T.churn_run(spark, sf)
    t = r.test()
    auc = X.roc_auc(t, "Churn", "p_cal").select("auc").scalar()
    ap = X.pr_areas(t, "Churn", "p_cal")
    cm = X.prf(X.threshold_counts(t, "Churn", "p_cal", r.threshold))
    return finish(cm.crossJoin(ap).withColumn("auc", auc).withColumn("threshold", F.lit(r.threshold)))


@register("x08_model_calibration_curve")
def x08m(spark, sf):
    t = T.churn_run(spark, sf).test()
    return finish(X.calibration_curve(t, "Churn", "p").withColumn("stage", F.lit("before")).unionByName(
        X.calibration_curve(t, "Churn", "p_cal").withColumn("stage", F.lit("after"))))


@register("m15_feature_importance")
def m15(spark, sf):
    r = T.churn_run(spark, sf)
    pairs = M.importances(r.model, r.feats, top=20)
    return finish(spark.createDataFrame([(f, float(v)) for f, v in pairs], "feature string, importance double"))


def _explaining_tree(spark, sf):
    """M8: tree 0 of a forest, else a depth-3 surrogate of the thresholded calibrated model, fitted on train rows."""
    r = T.churn_run(spark, sf)
    features = "pca" if r.use_pca else "features"
    if r.best_name == "Random Forest":
        inner = r.model.inner if r.use_pca else r.model
        return r, T.store(spark, sf).model("forest-tree", r.settings, lambda: inner.inner.trees[0], M.DecisionTreeClassificationModel), features
    tree = T.store(spark, sf).model("surrogate", r.settings, lambda: M.surrogate_tree(
        r.train().select("features", "prediction_cal"), "prediction_cal", 3), M.DecisionTreeClassificationModel)
    return r, tree, "features"


@register("m08_surrogate_tree_fidelity")
def m08(spark, sf):
    """M8: share of test rows on which the explaining tree agrees with the thresholded calibrated model."""
    r, tree, _ = _explaining_tree(spark, sf)
    t = r.test().select("features", "prediction_cal")
    p = tree.transform(T.churn_pca(spark, sf)[0].transform(t) if tree.getFeaturesCol() == "pca" else t)
    return finish(p.agg(F.avg((F.col("prediction") == F.col("prediction_cal")).cast("double")).alias("fidelity"),
                        F.count("*").cast("long").alias("n")))


def _tree_nodes(spark, sf):
    """Node table of the explaining tree, thresholds in scaled and original units, and its root-to-node conditions."""
    r, tree, features = _explaining_tree(spark, sf)
    path = T.store(spark, sf).path("surrogate" if features == "features" and r.best_name != "Random Forest" else "forest-tree", r.settings)
    names = r.feats if features == "features" else [f"pca_{i}" for i in range(T.churn_pca(spark, sf)[0].getK())]
    return r, tree, features, R.nodes(spark, path, names, r.prep.scale_mean, r.prep.scale_std)


@register("m16_tree_rules")
def m16(spark, sf):
    """The tree's nodes with split features, thresholds in scaled and
    original units (x·std + mean), class weights and majority label."""
    _, _, _, nodes = _tree_nodes(spark, sf)
    return finish(nodes.select("id", "feature", "threshold", "threshold_original", "leftChild", "rightChild", "prediction",
                               F.when(F.col("prediction") == 1, "Churn").otherwise("Fidèle").alias("majority"),
                               "weight_class0", "weight_class1"))


@register("m16_rule_text")
def m16t(spark, sf):
    """One rule a leaf (conditions from the root, class counts of the train rows routed there), written and read as text."""
    r, tree, features, nodes = _tree_nodes(spark, sf)
    rows = r.train().select("features", "Churn")
    rows = T.churn_pca(spark, sf)[0].transform(rows) if features == "pca" else rows
    rules = R.leaf_rules(spark, nodes, R.leaf_counts(rows, nodes, features, "Churn"))
    path = f"{T.store(spark, sf).base}/rule-text"
    return R.write_rules(rules, path)


def _leak_forest(spark, sf):
    """Importances of the 50-tree, depth-5 forest of the leak check."""
    got = T.store(spark, sf).value("leak-forest", {"trees": 50, "depth": 5}, lambda: M.ForestModel(M.RandomForestClassifier(
        numTrees=50, maxDepth=5, seed=42, labelCol="Churn").fit(T.train_rows(spark, sf))).importances())
    return sorted(zip(T.prepared(spark, sf).features, got), key=lambda t: (-t[1], t[0]))


@register("c09_forest_importance_check")
def c09(spark, sf):
    """50-tree depth-5 forest importances; dominant feature warning above 0.30."""
    pairs = _leak_forest(spark, sf)
    df = spark.createDataFrame([(f, float(v)) for f, v in pairs], "feature string, importance double")
    return finish(df.withColumn("dominant", F.col("importance") > 0.30))


def _target_corr(spark, sf):
    feats = T.prepared(spark, sf).features
    return feats, A.target_correlations(T.train_rows(spark, sf), feats, "Churn")


@register("c08_suspect_check")
def c08(spark, sf):
    """Named one-hot suspects (or the first three columns sharing their base name)."""
    feats, tc = _target_corr(spark, sf)
    return finish(A.suspect_check(tc, feats, SUSPECTS))


@register("c10_recommended_drops")
def c10(spark, sf):
    """High-tier ∪ leaky suspect variants ∪ dominant-importance variants, sorted."""
    feats, tc = _target_corr(spark, sf)
    imp = spark.createDataFrame([(f, float(v)) for f, v in _leak_forest(spark, sf)], "feature string, importance double")
    return A.recommended_drops(A.leak_tiers(tc), A.suspect_check(tc, feats, SUSPECTS), feats, imp)


@register("d04_drift_top_features")
def d04(spark, sf):
    """KS drift (train vs test) on the top-15 important features, the target and the prediction."""
    r = T.churn_run(spark, sf)
    top = [f for f, _ in M.importances(r.model, r.feats, top=15)]
    both = r.scored().select(*top, "Churn", F.col("p").alias("prediction"), F.col("split").alias("side"))
    return finish(D.ks_statistics(both, "side", [*top, "Churn", "prediction"], ref="train", cur="test"))


# ------------------------------------------------------------------ revenue (M4-M6)
@register("m12_m14_revenue_tuning")
def m12r(spark, sf):
    """M12-M14 for revenue: mean R2 of every grid and random trial of the chosen model; ``chosen`` marks the final one."""
    t = T.revenue_trials(spark, sf)
    rows = _trials(t["grid"], "grid") + _trials(t["random"], "random")
    picked = str(sorted(t["params"].items()))
    return finish(spark.createDataFrame([(*r, r[0] == t["tuner"] and r[2] == picked) for r in rows],
                                        "tuner string, trial int, params string, r2 double, chosen boolean"))


@register("m04_m06_revenue_cv")
def m04(spark, sf):
    """M4-M6 + M10 (regression): 5-fold R² and MAE of ridge, forest and boosting (log target)."""
    return finish(T.revenue_folds(spark, sf).groupBy("model").agg(
        F.avg("r2").alias("r2_mean"), F.stddev_pop("r2").alias("r2_std"),
        F.avg("mae").alias("mae_mean"), F.stddev_pop("mae").alias("mae_std")))


@register("f28_revenue_cap")
def f28(spark, sf):
    """train p99 cap and the number of rows above it per split."""
    cap = T.revenue_cap(spark, sf)
    return finish(T.split_customers(spark, sf).groupBy("split").agg(
        F.count_if(F.col("MonetaryTotal") > cap).cast("long").alias("n_above_cap"), F.count("*").cast("long").alias("n"))
        .withColumn("cap", F.lit(cap)))


@register("x09_model_revenue_metrics")
def x09m(spark, sf):
    """X9/X12 for the chosen revenue model: capped, uncapped and log scale on test."""
    r = T.revenue_run(spark, sf)
    t = r.test().withColumn("target_log", F.col("label"))
    parts = [X.regression_metrics(t, a, p).select(F.lit(s).alias("scale"), "*")
             for a, p, s in [("target_capped", "pred_raw", "capped"), ("target_raw", "pred_raw", "uncapped"),
                             ("target_log", "prediction", "log")]]
    return finish(parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumn("model", F.lit(r.best_name)))


@register("m15_revenue_importance")
def m15r(spark, sf):
    r = T.revenue_run(spark, sf)
    pairs = M.importances(r.model, r.feats, top=20)
    return finish(spark.createDataFrame([(f, float(v)) for f, v in pairs], "feature string, importance double"))
