"""Registered scoring queries (R2-R8, S8) — batch and streaming share R1."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as SF
from ..operators import metrics as X
from ..operators import models as M
from ..sources import requests as RQ
from ..streaming import scoring as ST
from .catalog import c360, finish, register
from .training import churn_run, revenue_run, side_by_side


def score_batch(spark, sf, rows, keep=()):
    """R3 with the churn model of this input."""
    return ST.score_rows(rows, churn_run(spark, sf), keep)


@register("r03_batch_predictions")
def r03(spark, sf):
    """Every customer scored by the calibrated churn model."""
    return finish(score_batch(spark, sf, c360(spark, sf)))


@register("r07_prediction_summary")
def r07(spark, sf):
    """Counts per predicted label."""
    return score_batch(spark, sf, c360(spark, sf)).groupBy("label").agg(F.count("*").cast("long").alias("n"))


@register("s08_r02_request_scoring")
def r02(spark, sf):
    """S8 + R2: request bodies (built from the customer table) parsed with
    defaults, then scored through the same R1 transform and model."""
    bodies = RQ.request_json(c360(spark, sf))
    return finish(ST.score_requests(bodies, churn_run(spark, sf)))


@register("r05_revenue_scoring")
def r05(spark, sf):
    """Revenue model → expm1(max(pred, 0)), high-spender flag (> cap), tier."""
    r = revenue_run(spark, sf)
    x = r.prep.transform(c360(spark, sf))
    p = r.model.score(M.assemble(x, r.feats), "prediction")
    rev = F.expm1(F.greatest(F.col("prediction"), F.lit(0.0)))
    return finish(p.select("CustomerID", F.bround(rev, 2).alias("predicted_revenue"),
                           (rev > r.cap).alias("high_spender"),
                           SF.revenue_tier(rev, F.lit(r.cap)).alias("tier")))


@register("r05_revenue_report")
def r05_report(spark, sf):
    """R5 as it is shown: revenue and cap as numbers and as money text, tier, flag, and the model's name and test
    metrics on the capped target (R2 with 4 digits, MedAE and MAE in whole pounds)."""
    r = revenue_run(spark, sf)
    m = X.regression_metrics(r.test(), "target_capped", "pred_raw").first()     # one row
    p = r.model.score(M.assemble(r.prep.transform(c360(spark, sf)), r.feats), "prediction")
    rev, cap = F.expm1(F.greatest(F.col("prediction"), F.lit(0.0))), F.lit(float(r.cap))
    return p.select(  # digits as shown, not rounded further
        "CustomerID", F.bround(rev, 2).alias("predicted_revenue"), SF.money(rev).alias("predicted_revenue_text"),
        SF.revenue_tier(rev, cap).alias("tier"), (rev > cap).alias("high_spender"),
        F.bround(cap, 0).alias("cap_value"), SF.money(cap).alias("cap_text"), F.lit(r.best_name).alias("model_name"),
        F.bround(F.lit(m["r2"]), 4).alias("r2"), F.bround(F.lit(m["medae"]), 0).alias("medae"),
        F.bround(F.lit(m["mae"]), 0).alias("mae"))


@register("r08_stream_scoring")
def r08(spark, sf):
    """Request files arriving on a stream, scored per micro-batch (== batch result)."""
    r = churn_run(spark, sf)
    return finish(ST.score_stream(spark, sf, c360(spark, sf), r))


@register("d06_stream_drift_monitor")
def d06(spark, sf):
    """KS drift of each arriving micro-batch against the stored reference half."""
    return finish(ST.monitor_stream(spark, sf, c360(spark, sf)))


@register("r04_churn_with_cluster")
def r04(spark, sf):
    """Churn result plus the customer's segment from the K-Means model (unknown id → 'Segment i')."""
    from . import q_segment as QS
    from ..operators import segment as SG
    (seg, names), _ = side_by_side(lambda: (QS.segments(spark, sf), QS._names(spark, sf)), lambda: churn_run(spark, sf))
    rows = c360(spark, sf)
    # the segment model first, the raw row carried along; the churn model then reads the same rows
    feats = seg.prep.transform(rows.withColumn("raw", F.struct(*rows.columns)), keep=["raw"]).fillna(0.0, subset=seg.cols)
    clus = seg.model.transform(SG.assemble(feats, seg.cols)).select("raw.*", "Cluster")
    churn = score_batch(spark, sf, clus, keep=["Cluster"])
    named = SG.assign_names(churn, names).withColumn(
        "ClusterName", F.coalesce("ClusterName", F.concat(F.lit("Segment "), F.col("Cluster").cast("string"))))
    return finish(named.select(*[c for c in churn.columns if c != "Cluster"],
                               F.bround(F.col("probability") * 100, 1).alias("probability_pct"), "Cluster", "ClusterName"))


@register("r06_scoring_trace")
def r06(spark, sf):
    """Received fields, key scaled features and the churn / revenue results per customer."""
    r, rv = side_by_side(lambda: churn_run(spark, sf), lambda: revenue_run(spark, sf))
    received = ["Frequency", "MonetaryTotal", "CustomerTenureDays", "ReturnRatio"]
    shown = ["Frequency", "MonetaryTotal", "EngagementScore"]
    rows = c360(spark, sf)
    # one transform for both models (they share the fitted transform)
    x = r.prep.transform(rows.withColumn("received", F.struct(*received)), keep=["received"])
    p = r.score(M.assemble(x, r.feats))
    churn = p.select(*x.columns, F.bround("p_cal", 4).alias("probability"),
                     SF.churn_label(F.col("prediction_cal")).alias("label"))
    both = rv.model.score(M.assemble(churn, rv.feats), "prediction")
    rev = F.expm1(F.greatest(F.col("prediction"), F.lit(0.0)))
    return finish(both.select("CustomerID", "received.*", *[F.col(c).alias(f"{c}_scaled") for c in shown],
                              "probability", "label", F.bround(rev, 2).alias("predicted_revenue"),
                              SF.revenue_tier(rev, F.lit(rv.cap)).alias("tier")))
