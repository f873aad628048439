"""Evaluation metrics over (label, score) columns.

Curve metrics never sort the whole table in one task: rows are first reduced
to one row per distinct score with positive/negative counts (map-side
combined), then the distributed prefix sums of :mod:`ranks` give cumulative
counts.  ROC-AUC is the Mann-Whitney statistic with ties counted half.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ranks as R


def score_counts(df: DataFrame, label: str, score: str, groups: Sequence[str] = ()) -> DataFrame:
    """One row per distinct score (of a group): positives, negatives."""
    y = F.col(label)
    return (df.where(F.col(score).isNotNull() & y.isNotNull())
            .groupBy(*groups, F.col(score).cast("double").alias("score"))
            .agg(F.count_if(y == 1).cast("long").alias("pos"), F.count_if(y != 1).cast("long").alias("neg")))


def auc_of_counts(counts: DataFrame, groups: Sequence[str]) -> DataFrame:
    """X1 from :func:`score_counts`: one row a group, with its numbers of positives and negatives."""
    sc = R.prefix_sums(counts, groups, "score", ["pos", "neg"])
    g = sc.groupBy(*groups).agg(F.sum(F.col("pos") * (F.col("neg_before") + 0.5 * F.col("neg"))).alias("u"),
                                F.max("pos_total").alias("n_pos"), F.max("neg_total").alias("n_neg"))
    return g.select(*groups, F.try_divide(F.col("u"), F.col("n_pos").cast("double") * F.col("n_neg")).alias("auc"),
                    "n_pos", "n_neg")


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Area under ROC (exact, ties half) — one row ``auc``."""
    return auc_of_counts(score_counts(df, label, score), []).select("auc")


def curve_points(df: DataFrame, label: str, score: str) -> DataFrame:
    """Per distinct threshold (score ≥ t predicted positive): TP, FP, TPR,
    FPR, precision, recall, plus the previous point (for PR areas)."""
    sc = R.prefix_sums(score_counts(df, label, score), [], "score", ["pos", "neg"], descending=True)
    tp = F.col("pos_before") + F.col("pos")
    fp = F.col("neg_before") + F.col("neg")
    P, N = F.col("pos_total").cast("double"), F.col("neg_total").cast("double")
    prev_tp, prev_fp = F.col("pos_before"), F.col("neg_before")
    return sc.select(
        F.col("score").alias("threshold"), tp.alias("tp"), fp.alias("fp"),
        F.try_divide(tp.cast("double"), P).alias("tpr"), F.try_divide(fp.cast("double"), N).alias("fpr"),
        (tp / (tp + fp)).alias("precision"), F.try_divide(tp.cast("double"), P).alias("recall"),
        F.try_divide(prev_tp.cast("double"), P).alias("prev_recall"),
        F.when(prev_tp + prev_fp == 0, F.lit(1.0)).otherwise(prev_tp / (prev_tp + prev_fp)).alias("prev_precision"),
        F.col("pos"), F.col("neg"), F.col("pos_total"), F.col("neg_total"))


def pr_areas(df: DataFrame, label: str, score: str) -> DataFrame:
    """Average precision (step sum) and trapezoid area under the PR curve."""
    pts = curve_points(df, label, score)
    return pts.agg(
        F.sum((F.col("recall") - F.col("prev_recall")) * F.col("precision")).alias("average_precision"),
        F.sum((F.col("recall") - F.col("prev_recall")) * (F.col("precision") + F.col("prev_precision")) / 2)
        .alias("pr_auc_trapezoid"))


def threshold_counts(df: DataFrame, label: str, score: str, threshold: float | Column) -> DataFrame:
    """Confusion counts at a threshold (score ≥ t → positive)."""
    t = threshold if isinstance(threshold, Column) else F.lit(threshold)
    y, p = F.col(label), (F.col(score) >= t).cast("int")
    return df.agg(F.count_if((y == 0) & (p == 0)).cast("long").alias("tn"),
                  F.count_if((y == 0) & (p == 1)).cast("long").alias("fp"),
                  F.count_if((y == 1) & (p == 0)).cast("long").alias("fn"),
                  F.count_if((y == 1) & (p == 1)).cast("long").alias("tp"))


def prf(counts: DataFrame) -> DataFrame:
    """Precision, recall, F1 with zero_division = 0."""
    tp, fp, fn = (F.col(c).cast("double") for c in ("tp", "fp", "fn"))
    prec = F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0))
    rec = F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0))
    return counts.select("*", prec.alias("precision"), rec.alias("recall"),
                         F.coalesce(F.try_divide(2 * prec * rec, prec + rec), F.lit(0.0)).alias("f1"))


def class_report(df: DataFrame, label: str, pred: str) -> DataFrame:
    """Per-class precision/recall/F1/support, accuracy, macro and weighted averages."""
    y, p = F.col(label), F.col(pred)
    c = df.agg(*[F.count_if((y == a) & (p == b)).cast("double").alias(f"c{a}{b}") for a in (0, 1) for b in (0, 1)])
    rows = []
    for k in (0, 1):
        tp, fp, fn = F.col(f"c{k}{k}"), F.col(f"c{1 - k}{k}"), F.col(f"c{k}{1 - k}")
        prec = F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0))
        rec = F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0))
        f1 = F.coalesce(F.try_divide(2 * prec * rec, prec + rec), F.lit(0.0))
        rows.append((str(k), prec, rec, f1, tp + fn))
    n = F.col("c00") + F.col("c01") + F.col("c10") + F.col("c11")
    acc = (F.col("c00") + F.col("c11")) / n
    structs = [F.struct(F.lit(name).alias("row"), pr.alias("precision"), rc.alias("recall"), f.alias("f1"),
                        s.alias("support")) for name, pr, rc, f, s in rows]
    structs.append(F.struct(F.lit("accuracy").alias("row"), F.lit(None).cast("double").alias("precision"),
                            F.lit(None).cast("double").alias("recall"), acc.alias("f1"), n.alias("support")))
    structs.append(F.struct(F.lit("macro avg").alias("row"), ((rows[0][1] + rows[1][1]) / 2).alias("precision"),
                            ((rows[0][2] + rows[1][2]) / 2).alias("recall"), ((rows[0][3] + rows[1][3]) / 2).alias("f1"),
                            n.alias("support")))
    structs.append(F.struct(F.lit("weighted avg").alias("row"),
                            ((rows[0][1] * rows[0][4] + rows[1][1] * rows[1][4]) / n).alias("precision"),
                            ((rows[0][2] * rows[0][4] + rows[1][2] * rows[1][4]) / n).alias("recall"),
                            ((rows[0][3] * rows[0][4] + rows[1][3] * rows[1][4]) / n).alias("f1"),
                            n.alias("support")))
    return c.select(F.explode(F.array(*structs)).alias("s")).select("s.*")


def f2_threshold(df: DataFrame, label: str, score: str, floor: float = 0.40) -> DataFrame:
    """Threshold maximising F2 = 5PR/(4P+R+1e-8) among thresholds ≥ floor
    (first, i.e. smallest, on ties); the floor itself when no score reaches it."""
    pts = curve_points(df, label, score).where(F.col("threshold") >= floor)
    f2 = 5 * F.col("precision") * F.col("recall") / (4 * F.col("precision") + F.col("recall") + 1e-8)
    best = pts.select("threshold", f2.alias("f2"), "precision", "recall") \
        .orderBy(F.desc("f2"), F.asc("threshold")).limit(1)
    fallback = df.sparkSession.range(1).select(
        F.lit(float(floor)).alias("threshold"), F.lit(None).cast("double").alias("f2"),
        F.lit(None).cast("double").alias("precision"), F.lit(None).cast("double").alias("recall"))
    has = best.agg(F.count("*")).scalar()
    return best.unionByName(fallback.where(has == 0))


def calibration_curve(df: DataFrame, label: str, score: str, bins: int = 10) -> DataFrame:
    """Uniform bins (p=1 in the last), mean predicted, observed rate, count; empty bins absent."""
    b = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    return (df.where(F.col(score).isNotNull()).groupBy(b.alias("bin"))
            .agg(F.avg(F.col(score)).alias("mean_predicted"), F.avg(F.col(label).cast("double")).alias("fraction_positive"),
                 F.count("*").cast("long").alias("n")))


def score_moments(df: DataFrame, score: str) -> DataFrame:
    """Mean and population std of a probability column."""
    return df.agg(F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"))


# -- regression ----------------------------------------------------------------------

def regression_metrics(df: DataFrame, actual: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """R² (1 - SSE/SST), MAE, MedAE (exact, distributed), RMSE, n."""
    e = (F.col(actual) - F.col(pred)).cast("double")
    base = df.select(*by, F.col(actual).cast("double").alias("__y"), e.alias("__e"))
    g = list(by)
    mom = (base.groupBy(*g) if g else base.groupBy()).agg(
        F.count("*").cast("long").alias("n"), F.avg(F.abs("__e")).alias("mae"),
        F.sqrt(F.avg(F.col("__e") * F.col("__e"))).alias("rmse"),
        F.sum(F.col("__e") * F.col("__e")).alias("__sse"), F.var_pop("__y").alias("__vy"))
    med = R.exact_median(base.withColumn("__ae", F.abs("__e")), g, "__ae", "medae")
    if g:
        out = mom.join(med, g, "left")
    else:
        out = mom.withColumn("medae", med.scalar())
    r2 = 1 - F.col("__sse") / (F.col("__vy") * F.col("n"))
    return out.select(*g, F.when(F.col("__vy") > 0, r2).alias("r2"), "mae", "medae", "rmse", "n")


def error_bands(df: DataFrame, actual: str, pred: str,
                cuts: Sequence[float] = (0, 10, 25, 50, 75, 90, 99, 100), min_rows: int = 3) -> DataFrame:
    """X11: error by actual-value percentile band [p_i, p_{i+1}) (last closed);
    bands with fewer than ``min_rows`` rows are dropped."""
    probs = [c / 100 for c in cuts]
    q = R.exact_quantiles(df, [], actual, probs)
    edges = q.agg(F.sort_array(F.collect_list(F.struct("prob", "quantile"))).alias("e")).scalar()
    y = F.col(actual).cast("double")
    x = df.select(y.alias("y"), (y - F.col(pred)).alias("err")).withColumn("e", edges)
    k = len(cuts) - 1
    band = None
    for i in range(k):
        lo = F.col("e")[i]["quantile"]
        hi = F.col("e")[i + 1]["quantile"]
        cond = (F.col("y") >= lo) & ((F.col("y") < hi) if i < k - 1 else (F.col("y") <= hi))
        name = F.lit(f"p{cuts[i]}-p{cuts[i + 1]}")
        band = F.when(cond, name) if band is None else band.when(cond, name)
    banded = x.select(band.alias("band"), F.abs("err").alias("abs_err"), "err").where(F.col("band").isNotNull())
    med = R.exact_median(banded, ["band"], "abs_err", "median_abs_error")
    agg = banded.groupBy("band").agg(F.avg("abs_err").alias("mae"), F.avg("err").alias("mean_error"),
                                     F.count("*").cast("long").alias("n"))
    return agg.join(med, "band").where(F.col("n") >= min_rows)


def histogram_fixed(df: DataFrame, col: str, bins: int) -> DataFrame:
    """Equal-width histogram of a column (e.g. residuals)."""
    from .profile import histogram
    return histogram(df, col, bins)
