"""Drift monitoring.

The two-sample KS statistic for many features at once: rows are melted to
(feature, value, side), reduced to per-(feature, value) counts per side
(map-side combined), and the distributed prefix sums give both empirical
CDFs at every distinct value; D = max |F_ref - F_cur| per feature.  Only the
per-feature rows (≤ the monitored feature list) meet the p-value helper.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import metrics as X
from . import ranks as R
from .profile import melt


def ks_statistics(df: DataFrame, side_col: str, cols: Sequence[str], ref: str = "reference",
                  cur: str = "current", min_n: int = 5) -> DataFrame:
    """Per feature KS D, sample sizes and means of both sides.

    Features with fewer than ``min_n`` non-null values on a side are skipped.
    """
    return ks_from_counts(value_counts(df, side_col, cols, ref, cur), min_n)


def value_counts(df: DataFrame, side_col: str, cols: Sequence[str], ref: str = "reference",
                 cur: str = "current") -> DataFrame:
    """Rows per (feature, value) on the reference side (r) and the current side (c); nulls left out.
    The counts of two disjoint sets of rows may be added up."""
    s = F.col(side_col)
    return (melt(df, cols, [side_col]).where(F.col("value").isNotNull()).groupBy("feature", "value")
            .agg(F.count_if(s == ref).cast("long").alias("r"), F.count_if(s == cur).cast("long").alias("c")))


def ks_from_counts(counts: DataFrame, min_n: int = 5) -> DataFrame:
    """D1 from :func:`value_counts`; the means come from the same rows."""
    cum = R.prefix_sums(counts, ["feature"], "value", ["r", "c"])
    gap = F.abs((F.col("r_before") + F.col("r")) / F.col("r_total") - (F.col("c_before") + F.col("c")) / F.col("c_total"))
    d = cum.groupBy("feature").agg(
        F.max(gap).alias("ks_stat"), F.max("r_total").alias("n_ref"), F.max("c_total").alias("n_cur"),
        F.try_divide(F.sum(F.col("value") * F.col("r")), F.sum("r")).alias("ref_mean"),
        F.try_divide(F.sum(F.col("value") * F.col("c")), F.sum("c")).alias("cur_mean"))
    return (d.where((F.col("n_ref") >= min_n) & (F.col("n_cur") >= min_n))
            .select("feature", "ks_stat", F.col("n_ref").cast("long").alias("n_ref"),
                    F.col("n_cur").cast("long").alias("n_cur"), "ref_mean", "cur_mean"))


def ks_against(reference: DataFrame, current: DataFrame, groups: Sequence[str], min_n: int = 5) -> DataFrame:
    """D1 of many current sets against one reference: ``reference`` holds (feature, value, r), ``current``
    (``groups``, feature, value, c), one row a value.

    Between two neighbouring current values the current CDF is flat and the reference's only rises, so the largest
    gap is met at a current value or just before it.  The reference is therefore ordered once, with the current
    values put in as rows of no weight, whatever the number of groups.
    """
    marks = current.select("feature", "value", F.lit(0).cast("long").alias("r"))
    grid = reference.select("feature", "value", "r").unionByName(marks).groupBy("feature", "value").agg(F.sum("r").alias("r"))
    ref = R.prefix_sums(grid, ["feature"], "value", ["r"])
    means = reference.groupBy("feature").agg(F.try_divide(F.sum(F.col("value") * F.col("r")), F.sum("r")).alias("ref_mean"))
    cur = R.prefix_sums(current.select(*groups, "feature", "value", "c"), [*groups, "feature"], "value", ["c"])

    def share(part, total):
        return F.try_divide(part.cast("double"), F.col(total).cast("double"))

    before = F.abs(share(F.col("r_before"), "r_total") - share(F.col("c_before"), "c_total"))
    at = F.abs(share(F.col("r_before") + F.col("r"), "r_total") - share(F.col("c_before") + F.col("c"), "c_total"))
    d = cur.join(ref, ["feature", "value"]).groupBy(*groups, "feature").agg(
        F.max(F.greatest(before, at)).alias("ks_stat"), F.max("r_total").alias("n_ref"), F.max("c_total").alias("n_cur"),
        F.try_divide(F.sum(F.col("value") * F.col("c")), F.sum("c")).alias("cur_mean"))
    return (d.where((F.col("n_ref") >= min_n) & (F.col("n_cur") >= min_n)).join(means, "feature", "left")
            .select(*groups, "feature", "ks_stat", F.col("n_ref").cast("long").alias("n_ref"),
                    F.col("n_cur").cast("long").alias("n_cur"), "ref_mean", "cur_mean"))


EXACT_ROWS = 10_000  # rows of the larger side up to which the p-value is exact


def ks_pvalue(d: float, n1: float, n2: float) -> float:
    """Two-sided two-sample KS p-value: exact while both sides have at most
    ``EXACT_ROWS`` rows, else Kolmogorov's series with the Stephens correction."""
    if d is None or n1 is None or n2 is None or n1 <= 0 or n2 <= 0:
        return float("nan")
    if max(n1, n2) <= EXACT_ROWS:
        return ks_exact(d, int(n1), int(n2))
    en = math.sqrt(n1 * n2 / (n1 + n2))
    lam = (en + 0.12 + 0.11 / en) * d
    if lam < 1e-3:
        return 1.0
    s, sign = 0.0, 1.0
    for j in range(1, 101):
        term = sign * 2.0 * math.exp(-2.0 * lam * lam * j * j)
        s += term
        if abs(term) < 1e-12 * max(abs(s), 1e-300):
            break
        sign = -sign
    return min(max(s, 0.0), 1.0)


def ks_exact(d: float, n1: int, n2: int) -> float:
    """P(D >= d) over all orders of n1 and n2 rows: one minus the chance that a
    random lattice path keeps every |i/n1 - j/n2| below d.

    ``stay[i]`` is the chance that a path to (i, t - i) has stayed inside; its
    last step came from the left with chance i / t.  Whole numbers decide which
    points are inside, and a step touches only those.
    """
    gap = round(d * n1 * n2)                    # |i*n2 - j*n1| of the largest gap
    if gap <= 0:
        return 1.0
    total, index = n1 + n2, np.arange(n1 + 1, dtype="float64")
    stay = np.zeros(n1 + 2)                     # one place more on the left, always 0
    stay[1] = 1.0
    for t in range(1, total + 1):
        lo = max(0, t - n2, (t * n1 - gap) // total + 1)
        hi = min(t, n1, (t * n1 + gap - 1) // total)
        if lo > hi:
            return 1.0
        i = index[lo:hi + 1]
        step = (i * stay[lo:hi + 1] + (t - i) * stay[lo + 1:hi + 2]) / t
        stay[max(1, lo - 1):lo + 1] = 0.0       # the band only moves up; what it leaves behind counts no more
        stay[lo + 1:hi + 2] = step
        stay[hi + 2:hi + 4] = 0.0
    return min(max(1.0 - float(stay[n1 + 1]), 0.0), 1.0)


@F.pandas_udf(T.DoubleType())
def ks_pvalue_udf(d: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
    return pd.Series([ks_pvalue(float(a), float(b), float(c)) if not (pd.isna(a) or pd.isna(b) or pd.isna(c))
                      else None for a, b, c in zip(d, n1, n2)], dtype="float64")


def drift_table(ks: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Drifted features (p < alpha) with KS (4 digits), p (4), means (3),
    sorted by KS desc.  An empty result keeps the full schema."""
    with_p = ks.withColumn("p_value", ks_pvalue_udf("ks_stat", F.col("n_ref").cast("double"),
                                                    F.col("n_cur").cast("double")))
    return (with_p.where(F.col("p_value") < alpha)
            .select("feature", F.bround("ks_stat", 4).alias("ks_stat"), F.bround("p_value", 4).alias("p_value"),
                    F.bround("ref_mean", 3).alias("ref_mean"), F.bround("cur_mean", 3).alias("cur_mean"))
            .orderBy(F.desc("ks_stat"), "feature"))


def dataset_drift(ks: DataFrame, alpha: float = 0.05, share: float = 0.5) -> DataFrame:
    """Share of drifted features and the dataset-level flag (share ≥ 0.5)."""
    with_p = ks.withColumn("p_value", ks_pvalue_udf("ks_stat", F.col("n_ref").cast("double"),
                                                    F.col("n_cur").cast("double")))
    return with_p.agg(F.count("*").cast("long").alias("n_features"),
                      F.count_if(F.col("p_value") < alpha).cast("long").alias("n_drifted")) \
        .withColumn("drift_share", F.try_divide(F.col("n_drifted").cast("double"), F.col("n_features").cast("double"))) \
        .withColumn("dataset_drift", F.col("drift_share") >= share)


def auc_degradation(df: DataFrame, side_col: str, label: str, score: str, ref: str = "reference",
                    cur: str = "current", tolerance_pct: float = 5.0) -> DataFrame:
    """D3: AUC on each side, degradation = (ref - cur)·100, DEGRADED if > tolerance."""
    a_ref = X.roc_auc(df.where(F.col(side_col) == ref), label, score).select(F.col("auc").alias("auc_ref"))
    a_cur = X.roc_auc(df.where(F.col(side_col) == cur), label, score).select(F.col("auc").alias("auc_cur"))
    out = a_ref.withColumn("auc_cur", a_cur.scalar())
    deg = (F.col("auc_ref") - F.col("auc_cur")) * 100
    return out.select("auc_ref", "auc_cur", deg.alias("degradation_pct"),
                      F.when(deg > tolerance_pct, "DEGRADED").otherwise("STABLE").alias("status"))


def quality_by_side(df: DataFrame, side_col: str, cols: Sequence[str]) -> DataFrame:
    """D5 data-quality part: per side and feature: rows, missing, mean, std."""
    long = melt(df, cols, [side_col])
    return long.groupBy(side_col, "feature").agg(
        F.count("*").cast("long").alias("n"), F.count_if(F.col("value").isNull()).cast("long").alias("n_missing"),
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))


def target_by_side(df: DataFrame, side_col: str, label: str, pred: str) -> DataFrame:
    """D5 target-drift part: per side the rows and the shares of positive labels and predictions."""
    return df.groupBy(side_col).agg(F.count("*").cast("long").alias("n"),
                                    F.avg(F.col(label).cast("double")).alias("label_share"),
                                    F.avg(F.col(pred).cast("double")).alias("prediction_share"))


def classification_by_side(df: DataFrame, side_col: str, label: str, pred: str) -> DataFrame:
    """D5 classification part: per side the confusion counts, accuracy, precision, recall and F1 (0 where undefined)."""
    y, p = F.col(label) == 1, F.col(pred) == 1
    g = df.groupBy(side_col).agg(*[F.count_if(c).cast("long").alias(n) for n, c in
                                   [("tp", y & p), ("fp", ~y & p), ("fn", y & ~p), ("tn", ~y & ~p)]])
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))

    def share(a, b):
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    return g.select(side_col, "tp", "fp", "fn", "tn", share(tp + tn, tp + fp + fn + tn).alias("accuracy"),
                    share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"),
                    share(2 * tp, 2 * tp + fp + fn).alias("f1"))
