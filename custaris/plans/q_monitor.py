"""Registered drift-monitoring queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import drift as D
from ..operators import split as E
from .catalog import c360, finish, oracle, register
from .customer360 import NUMERIC_FEATURES
from .q_metrics import BASELINE_SCORE_SQL, baseline_score_col
from .q_split import DUCK_SPLIT, duck_hash
from ..session import ensure_checkpoint_dir
from ..sources import tables as TB
from ..streaming import monitor as MO

MONITORED = NUMERIC_FEATURES  # all; a caller may pass fewer
DUCK_HALF = f"CASE WHEN {duck_hash('half42')} < {E.HASH_SPACE // 2} THEN 'reference' ELSE 'current' END"


def halves(spark, sf):
    return E.time_or_hash_halves(c360(spark, sf), "CustomerID")


# Production is what came after the cut: customers whose last purchase lies in the last CUT_DAYS days of the orders.
CUT_DAYS = 360
_DAY = "(SELECT max(CAST(o_orderdate AS DATE)) FROM orders) - Recency"
DUCK_DATE_SIDE = f"CASE WHEN Recency > {CUT_DAYS} THEN 'reference' ELSE 'current' END"


def with_purchase_day(spark, sf):
    """Customer rows with the date of the last purchase and that of the cut."""
    last = TB.Tables(spark, sf).orders.agg(F.max(F.to_date("o_orderdate"))).scalar()
    return c360(spark, sf).withColumn("LastPurchase", F.date_sub(last, F.col("Recency"))) \
        .withColumn("Cut", F.date_sub(last, F.lit(CUT_DAYS)))


def date_sides(spark, sf):
    """E5 by date: reference before the cut, current from it on."""
    return E.monitoring_sides(with_purchase_day(spark, sf), "CustomerID", time_col="LastPurchase", cut=F.col("Cut"))


def production_sides(spark, sf):
    """E5 with a production file: the test split against a CSV of new customers, labels in a file of their own."""
    rows = E.hash_split(with_purchase_day(spark, sf), "CustomerID")
    new = rows.where((F.col("split") == "train") & (F.col("LastPurchase") >= F.col("Cut")))
    home = f"{ensure_checkpoint_dir(spark).rstrip('/')}/custaris-production-{uuid.uuid4().hex[:8]}"
    schema = TB.customer_csv_schema()
    raw = [f.name for f in schema.fields if f.name != "Churn"]
    TB.write_table(new.select(*raw), f"{home}/customers", "csv")
    TB.write_table(new.select("CustomerID", "Churn"), f"{home}/labels", "csv")
    unlabelled = type(schema)([f for f in schema.fields if f.name != "Churn"])
    production = TB.attach_labels(TB.read_customers(spark, f"{home}/customers", unlabelled), TB.read_labels(spark, f"{home}/labels"))
    return E.monitoring_sides(rows.where("split = 'test'").select(*raw, "Churn"), "CustomerID", production)


def _duck_ks(side_expr: str, ref: str, cur: str) -> str:
    sel = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in MONITORED)
    return f"""
WITH l AS (SELECT side, feature, value FROM (SELECT {side_expr} AS side, {sel} FROM c360)
           UNPIVOT (value FOR feature IN ({', '.join(MONITORED)}))),
c AS (SELECT feature, value, count_if(side = '{ref}') AS r, count_if(side = '{cur}') AS c FROM l GROUP BY feature, value),
cum AS (SELECT feature, value,
               sum(r) OVER (PARTITION BY feature ORDER BY value) AS cr, sum(c) OVER (PARTITION BY feature ORDER BY value) AS cc,
               sum(r) OVER (PARTITION BY feature) AS rt, sum(c) OVER (PARTITION BY feature) AS ct FROM c),
d AS (SELECT feature, max(abs(cr / rt - cc / ct)) AS ks_stat, CAST(max(rt) AS BIGINT) AS n_ref, CAST(max(ct) AS BIGINT) AS n_cur
      FROM cum GROUP BY feature),
m AS (SELECT feature, avg(CASE WHEN side = '{ref}' THEN value END) AS ref_mean,
             avg(CASE WHEN side = '{cur}' THEN value END) AS cur_mean FROM l GROUP BY feature)
SELECT d.feature, ks_stat, n_ref, n_cur, ref_mean, cur_mean FROM d JOIN m USING (feature)
WHERE n_ref >= 5 AND n_cur >= 5"""


@register("d01_ks_two_sample", oracle(_duck_ks(DUCK_HALF, "reference", "current"), "ks_stat ref_mean cur_mean"))
def d01(spark, sf):
    return finish(D.ks_statistics(halves(spark, sf), "side", MONITORED))


@register("d02_drift_table")
def d02(spark, sf):
    """Drifted features with asymptotic KS p-values (p on the ≤20 feature rows)."""
    return D.drift_table(D.ks_statistics(halves(spark, sf), "side", MONITORED))


@register("d03_auc_degradation", oracle(f"""
WITH s AS (SELECT {DUCK_HALF} AS side, Churn, {BASELINE_SCORE_SQL} AS score FROM c360),
c AS (SELECT side, score, count_if(Churn = 1) AS pos, count_if(Churn <> 1) AS neg FROM s GROUP BY side, score),
a AS (SELECT side, pos, neg, score,
             coalesce(sum(neg) OVER (PARTITION BY side ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb FROM c),
u AS (SELECT side, sum(pos * (nb + 0.5 * neg)) / (CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE)) AS auc FROM a GROUP BY side),
w AS (SELECT max(CASE WHEN side = 'reference' THEN auc END) AS auc_ref, max(CASE WHEN side = 'current' THEN auc END) AS auc_cur FROM u)
SELECT auc_ref, auc_cur, (auc_ref - auc_cur) * 100 AS degradation_pct,
       CASE WHEN (auc_ref - auc_cur) * 100 > 5.0 THEN 'DEGRADED' ELSE 'STABLE' END AS status FROM w""",
    "auc_ref auc_cur degradation_pct"))
def d03(spark, sf):
    df = halves(spark, sf).withColumn("score", baseline_score_col())
    return finish(D.auc_degradation(df, "side", "Churn", "score"))


@register("d05_quality_by_side", oracle(f"""
SELECT side, feature, CAST(count(*) AS BIGINT) AS n, CAST(count_if(value IS NULL) AS BIGINT) AS n_missing,
       avg(value) AS mean, stddev_samp(value) AS std
FROM (SELECT {DUCK_HALF} AS side, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in MONITORED)} FROM c360)
     UNPIVOT INCLUDE NULLS (value FOR feature IN ({', '.join(MONITORED)}))
GROUP BY side, feature""", "mean std"))
def d05q(spark, sf):
    return finish(D.quality_by_side(halves(spark, sf), "side", MONITORED))


@register("d05_dataset_drift_share")
def d05(spark, sf):
    """Share of drifted monitored features and the dataset-drift flag."""
    return finish(D.dataset_drift(D.ks_statistics(halves(spark, sf), "side", MONITORED)))


def predicted_halves(spark, sf):
    """Both halves with the 0/1 prediction of the baseline scorecard at 0.5."""
    return halves(spark, sf).withColumn("pred", (baseline_score_col() >= 0.5).cast("int"))


_PRED_CTE = f"_ph AS (SELECT {DUCK_HALF} AS side, Churn, CAST({BASELINE_SCORE_SQL} >= 0.5 AS INTEGER) AS pred FROM c360)"


@register("d05_target_by_side", oracle("""
SELECT side, CAST(count(*) AS BIGINT) AS n, avg(CAST(Churn AS DOUBLE)) AS label_share,
       avg(CAST(pred AS DOUBLE)) AS prediction_share FROM _ph GROUP BY side""",
    "label_share prediction_share", extra_ctes=_PRED_CTE))
def d05t(spark, sf):
    """Share of churners and of predicted churners on each side."""
    return finish(D.target_by_side(predicted_halves(spark, sf), "side", "Churn", "pred"))


@register("d05_classification_by_side", oracle("""
WITH c AS (SELECT side, count_if(Churn = 1 AND pred = 1) AS tp, count_if(Churn <> 1 AND pred = 1) AS fp,
                  count_if(Churn = 1 AND pred <> 1) AS fn, count_if(Churn <> 1 AND pred <> 1) AS tn FROM _ph GROUP BY side)
SELECT side, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn,
       CAST(tp + tn AS DOUBLE) / (tp + fp + fn + tn) AS accuracy,
       coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0.0) AS precision,
       coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0.0) AS recall,
       coalesce(CAST(2 * tp AS DOUBLE) / nullif(2 * tp + fp + fn, 0), 0.0) AS f1 FROM c""",
    "accuracy precision recall f1", extra_ctes=_PRED_CTE))
def d05c(spark, sf):
    """Confusion counts and scores on each side."""
    return finish(D.classification_by_side(predicted_halves(spark, sf), "side", "Churn", "pred"))


@register("d07_ks_train_vs_test", oracle(_duck_ks(DUCK_SPLIT, "train", "test"), "ks_stat ref_mean cur_mean"))
def d07(spark, sf):
    df = E.hash_split(c360(spark, sf), "CustomerID")
    return finish(D.ks_statistics(df, "split", MONITORED, ref="train", cur="test"))


# ------------------------------------------------ by date, by production file
@register("e05_sides_by_date", oracle(f"""
SELECT CustomerID, CAST({_DAY} AS VARCHAR) AS last_purchase, {DUCK_DATE_SIDE} AS side, false AS placeholder FROM c360"""))
def e05d(spark, sf):
    return date_sides(spark, sf).select("CustomerID", F.col("LastPurchase").cast("string").alias("last_purchase"),
                                        "side", "placeholder")


@register("e05_production_file", oracle(f"""
WITH s AS (SELECT Churn, MonetaryTotal, Frequency, {DUCK_SPLIT} AS split, Recency FROM c360),
     b AS (SELECT 'reference' AS side, Churn, MonetaryTotal, Frequency FROM s WHERE split = 'test' UNION ALL
           SELECT 'current', Churn, MonetaryTotal, Frequency FROM s WHERE split = 'train' AND Recency <= {CUT_DAYS})
SELECT side, false AS placeholder, CAST(count(*) AS BIGINT) AS n, CAST(sum(Churn) AS BIGINT) AS n_churn,
       avg(MonetaryTotal) AS mean_monetary, avg(CAST(Frequency AS DOUBLE)) AS mean_frequency FROM b GROUP BY side""",
    "mean_monetary mean_frequency"))
def e05p(spark, sf):
    return finish(production_sides(spark, sf).groupBy("side", "placeholder").agg(
        F.count("*").cast("long").alias("n"), F.sum("Churn").cast("long").alias("n_churn"),
        F.avg("MonetaryTotal").alias("mean_monetary"), F.avg(F.col("Frequency").cast("double")).alias("mean_frequency")))


@register("d01_ks_by_date", oracle(_duck_ks(DUCK_DATE_SIDE, "reference", "current"), "ks_stat ref_mean cur_mean"))
def d01d(spark, sf):
    return finish(D.ks_statistics(date_sides(spark, sf), "side", MONITORED))


@register("d02_drift_by_date")
def d02d(spark, sf):
    """D2 against the customers of the last year; the p-value is tested against all orders of small samples."""
    return D.drift_table(D.ks_statistics(date_sides(spark, sf), "side", MONITORED))


@register("d02_drift_production_file")
def d02p(spark, sf):
    return D.drift_table(D.ks_statistics(production_sides(spark, sf), "side", MONITORED))


# ------------------------------------------------ arriving data, by windows of event time (D6 with state)
ARRIVALS, FILES = 3, 2


def _feed(spark, current, folder, columns, time_col, shift_days=0):
    """JSON files in order of time: ARRIVALS writes, FILES files each.  An arrival spans CUT_DAYS / ARRIVALS days, no
    more than the monitor's delay, so nothing in it is late however its files are read."""
    step = -(-(CUT_DAYS + 1) // ARRIVALS)
    age = F.datediff(F.col("LastPurchase"), F.col("Cut"))
    at = F.timestamp_seconds((F.unix_date("LastPurchase") + shift_days) * 86400)
    rows = current.withColumn("__age", age).withColumn(time_col, at)
    for k in range(ARRIVALS):
        part = rows.where((F.col("__age") >= k * step) & (F.col("__age") < (k + 1) * step))
        (part.select(F.to_json(F.struct(*columns, time_col)).alias("value")).repartition(FILES, F.xxhash64("value"))
         .write.mode("append").text(folder))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in current.select(*columns).schema.fields)
    return (spark.readStream.schema(f"{fields}, {time_col} timestamp").option("maxFilesPerTrigger", FILES).json(folder))


def _monitor(spark, sf, cols):
    m = MO.Monitor(home=f"{ensure_checkpoint_dir(spark).rstrip('/')}/custaris-monitor-{uuid.uuid4().hex[:8]}",
                   cols=tuple(cols), delay=f"{-(-(CUT_DAYS + 1) // ARRIVALS)} days")
    sides = date_sides(spark, sf)
    MO.store_reference(sides.where("side = 'reference'"), m, baseline_score_col())
    return m, sides.where("side = 'current'")


_WINDOW = "CAST(DATE '1970-01-01' + CAST(90 * floor(date_diff('day', DATE '1970-01-01', day) / 90.0) AS INTEGER) AS VARCHAR)"
_NUM = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in MONITORED)


@register("d06_stream_windows", oracle(f"""
WITH s AS (SELECT {DUCK_DATE_SIDE} AS side, CAST({_DAY} AS DATE) AS day, {_NUM} FROM c360),
l AS (SELECT CASE WHEN side = 'current' THEN {_WINDOW} END AS window_start, side, feature, value FROM s
      UNPIVOT (value FOR feature IN ({', '.join(MONITORED)}))),
r AS (SELECT feature, value, count(*) AS r FROM l WHERE side = 'reference' GROUP BY ALL),
c AS (SELECT window_start, feature, value, count(*) AS c FROM l WHERE side = 'current' GROUP BY ALL),
w AS (SELECT DISTINCT window_start, feature FROM c),
g AS (SELECT window_start, feature, value, sum(r) AS r, sum(c) AS c FROM (
      SELECT w.window_start, r.feature, r.value, r.r, 0 AS c FROM w JOIN r USING (feature)
      UNION ALL SELECT window_start, feature, value, 0, c FROM c) GROUP BY ALL),
cum AS (SELECT *, sum(r) OVER o AS cr, sum(c) OVER o AS cc, sum(r) OVER t AS rt, sum(c) OVER t AS ct FROM g
        WINDOW o AS (PARTITION BY window_start, feature ORDER BY value), t AS (PARTITION BY window_start, feature))
SELECT window_start, feature, max(abs(cr / rt - cc / ct)) AS ks_stat, CAST(max(rt) AS BIGINT) AS n_ref,
       CAST(max(ct) AS BIGINT) AS n_cur, sum(value * r) / sum(r) AS ref_mean, sum(value * c) / sum(c) AS cur_mean
FROM cum GROUP BY window_start, feature HAVING max(rt) >= 5 AND max(ct) >= 5""", "ks_stat ref_mean cur_mean"))
def d06w(spark, sf):
    """Records of the last year arrive in order; the newest drift rows of every window equal the batch result."""
    m, current = _monitor(spark, sf, MONITORED)
    MO.watch_drift(_feed(spark, current, m.path("in"), MONITORED, m.at), m).awaitTermination()
    d = MO.latest(spark, m, "drift", ["window", "feature"])
    return finish(d.select(F.col("window").cast("string").alias("window_start"), "feature", "ks_stat", "n_ref", "n_cur",
                           "ref_mean", "cur_mean"))


@register("d06_stream_auc", oracle(f"""
WITH s AS (SELECT {DUCK_DATE_SIDE} AS side, CAST({_DAY} AS DATE) AS day, Churn, {BASELINE_SCORE_SQL} AS score FROM c360),
g AS (SELECT CASE WHEN side = 'current' THEN {_WINDOW} END AS window_start, score, count_if(Churn = 1) AS pos,
             count_if(Churn <> 1) AS neg FROM s GROUP BY ALL),
b AS (SELECT *, sum(neg) OVER (PARTITION BY window_start ORDER BY score) - neg AS below FROM g),
a AS (SELECT window_start, sum(pos * (below + 0.5 * neg)) / nullif(CAST(sum(pos) AS DOUBLE) * sum(neg), 0) AS auc,
             CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg FROM b GROUP BY window_start),
d AS (SELECT c.window_start, r.auc AS auc_ref, c.auc AS auc_cur, c.n_pos, c.n_neg, (r.auc - c.auc) * 100 AS degradation_pct
      FROM a c, a r WHERE c.window_start IS NOT NULL AND r.window_start IS NULL)
SELECT *, CASE WHEN degradation_pct > 5.0 THEN 'DEGRADED' WHEN degradation_pct IS NOT NULL THEN 'STABLE' END AS status FROM d""",
    "auc_ref auc_cur degradation_pct"))
def d06a(spark, sf):
    """Scores on arrival, labels 30 days later; the newest AUC row of every window equals the batch result."""
    m, current = _monitor(spark, sf, ["Frequency"])
    inputs = ["CustomerID", "ReturnRatio", "Frequency", "AvgDaysBetweenPurchases"]
    records = _feed(spark, current, m.path("in"), inputs, m.at)
    labels = _feed(spark, current, m.path("labels"), ["CustomerID", m.label], m.labelled_at, shift_days=30)
    MO.watch_auc(records, labels, m, baseline_score_col()).awaitTermination()
    d = MO.latest(spark, m, "auc", ["window"])
    return finish(d.select(F.col("window").cast("string").alias("window_start"), "auc_ref", "auc_cur", "n_pos", "n_neg",
                           "degradation_pct", "status"))
