"""Registered metric queries.

Metrics are checked against DuckDB on two transparent baselines derived from
the customer-360 table, so every number has an SQL twin before any learned
model exists (model metrics are reported by the model queries):

* ``baseline_score`` — a fixed scorecard probability of churn;
* ``baseline_revenue`` — a group-mean regressor fitted on the training split
  (mean of log1p(capped MonetaryTotal) per Frequency, global mean for unseen).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import metrics as X
from ..operators import ranks as R
from ..operators import split as E
from .catalog import c360, finish, oracle, register
from .q_split import DUCK_SPLIT

# fixed scorecard weights of the baseline
_W = {"ReturnRatio": 1.5, "Frequency": -0.12, "AvgDaysBetweenPurchases": 0.003}
_B = 0.5


def baseline_score_col() -> Column:
    z = (F.lit(_B) + _W["ReturnRatio"] * F.col("ReturnRatio")
         + _W["Frequency"] * F.col("Frequency").cast("double")
         + _W["AvgDaysBetweenPurchases"] * F.coalesce(F.col("AvgDaysBetweenPurchases"), F.lit(0.0)))
    p = 1.0 / (1.0 + F.exp(-z))
    return (F.floor(p * 1e6 + 0.5) / 1e6).cast("double")


def _d(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


BASELINE_SCORE_SQL = (
    f"(floor(1.0 / (1.0 + exp(-({_d(_B)} + {_d(_W['ReturnRatio'])} * ReturnRatio + {_d(_W['Frequency'])} * "
    f"CAST(Frequency AS DOUBLE) + {_d(_W['AvgDaysBetweenPurchases'])} * coalesce(AvgDaysBetweenPurchases, 0.0)))) "
    f"* 1e6 + 0.5) / 1e6)")
SCORED_CTE = f"_scored AS (SELECT CustomerID, Churn, {BASELINE_SCORE_SQL} AS score, {DUCK_SPLIT} AS split FROM c360)"
THRESHOLD = 0.5


def scored(spark, sf) -> DataFrame:
    df = E.hash_split(c360(spark, sf), "CustomerID")
    return df.select("CustomerID", "Churn", "split", baseline_score_col().alias("score"))


_COUNTS = """_sc AS (SELECT score, count_if(Churn = 1) AS pos, count_if(Churn <> 1) AS neg FROM _scored
          WHERE score IS NOT NULL GROUP BY score),
_asc AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_before
         FROM _sc),
_desc AS (SELECT score AS threshold, pos, neg,
                 coalesce(sum(pos) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos_before,
                 coalesce(sum(neg) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_before,
                 sum(pos) OVER () AS P, sum(neg) OVER () AS N FROM _sc),
_pts AS (SELECT threshold, CAST(pos_before + pos AS BIGINT) AS tp, CAST(neg_before + neg AS BIGINT) AS fp,
                (pos_before + pos) / P AS tpr, (neg_before + neg) / N AS fpr,
                (pos_before + pos) / (pos_before + pos + neg_before + neg) AS precision,
                (pos_before + pos) / P AS recall, pos_before / P AS prev_recall,
                CASE WHEN pos_before + neg_before = 0 THEN 1.0 ELSE pos_before / (pos_before + neg_before) END AS prev_precision
         FROM _desc)"""
CURVE_CTES = SCORED_CTE + ",\n" + _COUNTS


@register("x01_roc_auc", oracle(
    "SELECT sum(pos * (neg_before + 0.5 * neg)) / (CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE)) AS auc FROM _asc",
    "auc", extra_ctes=CURVE_CTES))
def x01(spark, sf):
    return finish(X.roc_auc(scored(spark, sf), "Churn", "score"))


@register("x02_average_precision_pr_auc", oracle("""
SELECT sum((recall - prev_recall) * precision) AS average_precision,
       sum((recall - prev_recall) * (precision + prev_precision) / 2) AS pr_auc_trapezoid FROM _pts""",
    "average_precision pr_auc_trapezoid", extra_ctes=CURVE_CTES))
def x02(spark, sf):
    return finish(X.pr_areas(scored(spark, sf), "Churn", "score"))


_CM = f"""SELECT CAST(count_if(Churn = 0 AND score < {THRESHOLD}) AS BIGINT) AS tn,
       CAST(count_if(Churn = 0 AND score >= {THRESHOLD}) AS BIGINT) AS fp,
       CAST(count_if(Churn = 1 AND score < {THRESHOLD}) AS BIGINT) AS fn,
       CAST(count_if(Churn = 1 AND score >= {THRESHOLD}) AS BIGINT) AS tp FROM _scored"""


@register("x03_precision_recall_f1", oracle(f"""
WITH c AS ({_CM}),
     m AS (SELECT *, coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0.0) AS precision,
                  coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0.0) AS recall FROM c)
SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0) AS f1 FROM m""",
    "precision recall f1", extra_ctes=SCORED_CTE))
def x03(spark, sf):
    return finish(X.prf(X.threshold_counts(scored(spark, sf), "Churn", "score", THRESHOLD)))


@register("x04_confusion_matrix", oracle(_CM, extra_ctes=SCORED_CTE))
def x04(spark, sf):
    return X.threshold_counts(scored(spark, sf), "Churn", "score", THRESHOLD)


@register("x05_classification_report", oracle(f"""
WITH c AS (SELECT CAST(count_if(Churn = 0 AND score < {THRESHOLD}) AS DOUBLE) AS c00,
                  CAST(count_if(Churn = 0 AND score >= {THRESHOLD}) AS DOUBLE) AS c01,
                  CAST(count_if(Churn = 1 AND score < {THRESHOLD}) AS DOUBLE) AS c10,
                  CAST(count_if(Churn = 1 AND score >= {THRESHOLD}) AS DOUBLE) AS c11 FROM _scored),
k AS (SELECT coalesce(c00 / nullif(c00 + c10, 0), 0.0) AS p0, coalesce(c00 / nullif(c00 + c01, 0), 0.0) AS r0,
             coalesce(c11 / nullif(c11 + c01, 0), 0.0) AS p1, coalesce(c11 / nullif(c11 + c10, 0), 0.0) AS r1,
             c00 + c01 AS s0, c10 + c11 AS s1, c00 + c01 + c10 + c11 AS n, c00, c11 FROM c),
f AS (SELECT *, coalesce(2 * p0 * r0 / nullif(p0 + r0, 0), 0.0) AS f0, coalesce(2 * p1 * r1 / nullif(p1 + r1, 0), 0.0) AS f1 FROM k)
SELECT '0' AS "row", p0 AS precision, r0 AS recall, f0 AS f1, s0 AS support FROM f
UNION ALL SELECT '1', p1, r1, f1, s1 FROM f
UNION ALL SELECT 'accuracy', NULL, NULL, (c00 + c11) / n, n FROM f
UNION ALL SELECT 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n FROM f
UNION ALL SELECT 'weighted avg', (p0 * s0 + p1 * s1) / n, (r0 * s0 + r1 * s1) / n, (f0 * s0 + f1 * s1) / n, n FROM f""",
    "precision recall f1 support", extra_ctes=SCORED_CTE))
def x05(spark, sf):
    df = scored(spark, sf).withColumn("pred", (F.col("score") >= THRESHOLD).cast("int"))
    return finish(X.class_report(df, "Churn", "pred"))


@register("x06_roc_pr_points", oracle("SELECT threshold, tp, fp, tpr, fpr, precision, recall FROM _pts",
                                      "threshold tpr fpr precision recall", extra_ctes=CURVE_CTES))
def x06(spark, sf):
    return finish(X.curve_points(scored(spark, sf), "Churn", "score")
                  .select("threshold", "tp", "fp", "tpr", "fpr", "precision", "recall"))


@register("x07_f2_threshold", oracle("""
SELECT threshold, 5 * precision * recall / (4 * precision + recall + 1e-8) AS f2, precision, recall FROM _pts
WHERE threshold >= 0.4 ORDER BY f2 DESC, threshold ASC LIMIT 1""", "threshold f2 precision recall",
    extra_ctes=CURVE_CTES))
def x07(spark, sf):
    return finish(X.f2_threshold(scored(spark, sf), "Churn", "score", 0.40))


@register("x08_calibration_curve", oracle("""
SELECT CAST(least(floor(score * 10), 9) AS INTEGER) AS bin, avg(score) AS mean_predicted,
       avg(CAST(Churn AS DOUBLE)) AS fraction_positive, CAST(count(*) AS BIGINT) AS n
FROM _scored WHERE score IS NOT NULL GROUP BY 1""", "mean_predicted fraction_positive", extra_ctes=SCORED_CTE))
def x08(spark, sf):
    return finish(X.calibration_curve(scored(spark, sf), "Churn", "score"))


@register("x14_score_moments", oracle("SELECT avg(score) AS mean, stddev_pop(score) AS std FROM _scored",
                                      "mean std", extra_ctes=SCORED_CTE))
def x14(spark, sf):
    return finish(X.score_moments(scored(spark, sf), "score"))


# ------------------------------------------------------------------ regression baseline
def revenue_frame(spark, sf) -> DataFrame:
    """Test rows with actual (raw, capped, log) and baseline predictions."""
    df = E.hash_split(c360(spark, sf), "CustomerID")
    train = df.where(F.col("split") == "train")
    # two fitted scalars (computed once, exactly, on the training split)
    cap = F.lit(float(R.exact_quantiles(train, [], "MonetaryTotal", [0.99]).first()["quantile"]))
    y_log = F.log1p(F.greatest(F.least(F.col("MonetaryTotal"), cap), F.lit(0.0)))
    means = train.groupBy("Frequency").agg(F.avg(y_log).alias("grp_mean"))
    glob = F.lit(float(train.agg(F.avg(y_log)).first()[0]))
    test = df.where(F.col("split") == "test")
    out = (test.join(means, "Frequency", "left")
           .select("CustomerID", "Churn", F.col("MonetaryTotal").alias("actual"),
                   F.least(F.col("MonetaryTotal"), cap).alias("actual_capped"),
                   (F.col("MonetaryTotal") > cap).alias("high_spender"), y_log.alias("actual_log"),
                   F.coalesce("grp_mean", glob).alias("pred_log")))
    return out.withColumn("pred", F.expm1(F.greatest(F.col("pred_log"), F.lit(0.0))))


REV_CTES = f"""_sp AS (SELECT *, {DUCK_SPLIT} AS split FROM c360),
_cap AS (SELECT quantile_cont(MonetaryTotal, 0.99) AS cap FROM _sp WHERE split = 'train'),
_tr AS (SELECT Frequency, ln(1 + greatest(least(MonetaryTotal, cap), 0.0)) AS yl FROM _sp, _cap WHERE split = 'train'),
_gm AS (SELECT Frequency, avg(yl) AS grp_mean FROM _tr GROUP BY Frequency),
_rev AS (SELECT CustomerID, Churn, MonetaryTotal AS actual, least(MonetaryTotal, cap) AS actual_capped, MonetaryTotal > cap AS high_spender,
                ln(1 + greatest(least(MonetaryTotal, cap), 0.0)) AS actual_log,
                coalesce(g.grp_mean, (SELECT avg(yl) FROM _tr)) AS pred_log
         FROM _sp s CROSS JOIN _cap LEFT JOIN _gm g USING (Frequency) WHERE split = 'test'),
_revp AS (SELECT *, exp(greatest(pred_log, 0.0)) - 1 AS pred FROM _rev)"""


def _duck_reg(actual: str, pred: str, scale: str) -> str:
    e = f"({actual} - {pred})"
    return (f"SELECT '{scale}' AS scale, CASE WHEN var_pop({actual}) > 0 THEN 1 - sum({e} * {e}) / (var_pop({actual}) * count(*)) END AS r2, "
            f"avg(abs({e})) AS mae, median(abs({e})) AS medae, sqrt(avg({e} * {e})) AS rmse, CAST(count(*) AS BIGINT) AS n "
            f"FROM _revp")


@register("x09_x12_regression_metric_table", oracle(
    " UNION ALL ".join([_duck_reg("actual_capped", "pred", "capped"), _duck_reg("actual", "pred", "uncapped"),
                        _duck_reg("actual_log", "pred_log", "log")]),
    "r2 mae medae rmse", extra_ctes=REV_CTES))
def x09(spark, sf):
    rv = revenue_frame(spark, sf).cache()
    parts = [X.regression_metrics(rv, a, p).select(F.lit(s).alias("scale"), "*")
             for a, p, s in [("actual_capped", "pred", "capped"), ("actual", "pred", "uncapped"),
                             ("actual_log", "pred_log", "log")]]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return finish(out)


@register("x10_errors_by_churn_group", oracle("""
SELECT Churn, avg(abs(actual - pred)) AS mae, median(abs(actual - pred)) AS medae, CAST(count(*) AS BIGINT) AS n
FROM _revp GROUP BY Churn""", "mae medae", extra_ctes=REV_CTES))
def x10(spark, sf):
    rv = revenue_frame(spark, sf).withColumn("__ae", F.abs(F.col("actual") - F.col("pred")))
    med = R.exact_median(rv, ["Churn"], "__ae", "medae")
    agg = rv.groupBy("Churn").agg(F.avg("__ae").alias("mae"), F.count("*").cast("long").alias("n"))
    return finish(agg.join(med, "Churn").select("Churn", "mae", "medae", "n"))


_CUTS = [0, 10, 25, 50, 75, 90, 99, 100]


def _duck_bands():
    q = ", ".join(f"quantile_cont(actual, {c / 100}) AS e{i}" for i, c in enumerate(_CUTS))
    cases = " ".join(
        f"WHEN actual >= e{i} AND actual {'<' if i < len(_CUTS) - 2 else '<='} e{i + 1} THEN 'p{_CUTS[i]}-p{_CUTS[i + 1]}'"
        for i in range(len(_CUTS) - 1))
    return f"""
WITH e AS (SELECT {q} FROM _revp),
b AS (SELECT CASE {cases} END AS band, abs(actual - pred) AS abs_err, actual - pred AS err FROM _revp, e)
SELECT band, avg(abs_err) AS mae, avg(err) AS mean_error, CAST(count(*) AS BIGINT) AS n,
       median(abs_err) AS median_abs_error FROM b WHERE band IS NOT NULL GROUP BY band HAVING count(*) >= 3"""


@register("x11_errors_by_actual_band", oracle(_duck_bands(), "mae mean_error median_abs_error", extra_ctes=REV_CTES))
def x11(spark, sf):
    return finish(X.error_bands(revenue_frame(spark, sf), "actual", "pred", _CUTS))


@register("x13_residual_histogram", oracle("""
WITH r AS (SELECT actual - pred AS res FROM _revp),
b AS (SELECT min(res) AS lo, max(res) AS hi, (max(res) - min(res)) / 50 AS w FROM r),
t AS (SELECT CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((res - lo) / w), 49) END AS INTEGER) AS bin, lo, w FROM r, b)
SELECT bin, lo + bin * w AS "left", lo + (bin + 1) * w AS "right", CAST(count(*) AS BIGINT) AS n FROM t GROUP BY bin, lo, w""",
    "left right", extra_ctes=REV_CTES))
def x13(spark, sf):
    rv = revenue_frame(spark, sf).withColumn("residual", F.col("actual") - F.col("pred"))
    return finish(X.histogram_fixed(rv, "residual", 50))


@register("x13_residual_points", oracle("""
SELECT CustomerID, pred AS predicted, actual, actual_capped, actual_capped - pred AS residual, high_spender FROM _revp""",
    "predicted actual actual_capped residual", extra_ctes=REV_CTES))
def x13p(spark, sf):
    """Each test customer's predicted and actual revenue, residual against the capped target, high-spender flag."""
    return finish(revenue_frame(spark, sf).select(
        "CustomerID", F.col("pred").alias("predicted"), "actual", "actual_capped",
        (F.col("actual_capped") - F.col("pred")).alias("residual"), "high_spender"))
