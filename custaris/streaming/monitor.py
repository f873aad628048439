"""D6 with state: arriving records watched by windows of event time.

Two queries share a stored reference (counts per feature and value, and per
score the numbers of positives and negatives):

* drift: records are melted and counted by (window, feature, value).  The
  counts are the query's state: they go on across micro-batches, a late record
  still enters its window while that is open (until ``delay`` after its end, by
  event time), a later one is dropped, and the window's state is released.
  After each batch the windows that it touched get their D1/D2 rows anew.
* AUC: records wait in a stream-stream join until their label arrives (at most
  ``label_within`` after the record); each batch's labelled scores are added to
  its windows and these get their D3 row anew.

Every batch writes its own folders, overwritten when the batch is replayed,
and reads only folders up to its own; so a restart doubles nothing.  Records
without an event time belong to no window and are left out; null values and
null labels count nowhere, as in D1 and X1.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import drift as D
from ..operators import metrics as X
from ..operators.profile import melt

COUNTS = "window date, feature string, value double, c long, batch_id long"
SCORES = "window date, score double, pos long, neg long, batch_id long"


@dataclass(frozen=True)
class Monitor:
    """What is watched, and where it is kept (a folder all executors see)."""
    home: str
    cols: tuple[str, ...]
    key: str = "CustomerID"
    at: str = "at"                       # event time of a record (timestamp)
    width: str = "90 days"
    delay: str = "30 days"
    label: str = "Churn"
    labelled_at: str = "labelled_at"
    label_within: str = "60 days"
    alpha: float = 0.05
    tolerance_pct: float = 5.0
    min_n: int = 5

    def path(self, part: str) -> str:
        return f"{self.home.rstrip('/')}/{part}"



def utc_day(start: Column) -> Column:
    """The date on which a window starts; windows are cut in UTC, whatever the session's zone."""
    return F.date_from_unix_date(F.floor(F.unix_timestamp(start) / 86400).cast("int")).alias("window")


def store_reference(reference: DataFrame, m: Monitor, score: Column) -> None:
    """The reference side, once, as counts; the stream never sees its rows."""
    counts = melt(reference, list(m.cols), []).where(F.col("value").isNotNull()).groupBy("feature", "value") \
        .agg(F.count("*").alias("r"))
    counts.write.mode("overwrite").parquet(m.path("reference"))
    X.score_counts(reference.withColumn("__score", score), m.label, "__score").write.mode("overwrite").parquet(
        m.path("reference_scores"))


def _write(df: DataFrame, path: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def _touched(spark: SparkSession, path: str, schema: str, batch_id: int) -> DataFrame:
    """Rows up to this batch of the windows that this batch wrote to."""
    rows = spark.read.schema(schema).parquet(path).where(F.col("batch_id") <= batch_id)
    now = rows.where(F.col("batch_id") == batch_id).select("window").distinct()
    return rows.join(now, "window", "left_semi")


def watch_drift(records: DataFrame, m: Monitor) -> StreamingQuery:
    """Start the drift query over ``records`` (event time and monitored columns)."""
    long = melt(records.where(F.col(m.at).isNotNull()), list(m.cols), [m.at]).withWatermark(m.at, m.delay)
    counted = long.where(F.col("value").isNotNull()).groupBy(F.window(m.at, m.width), "feature", "value") \
        .agg(F.count("*").alias("c"))

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        # update mode: each row is the value's whole count so far, so the newest one holds
        _write(batch.select(utc_day(F.col("window.start")), "feature", "value", "c"),
               m.path("counts"), batch_id)
        held = _touched(spark, m.path("counts"), COUNTS, batch_id).groupBy("window", "feature", "value") \
            .agg(F.max_by("c", "batch_id").alias("c"))
        ks = D.ks_against(spark.read.parquet(m.path("reference")), held, ["window"], m.min_n)
        p = D.ks_pvalue_udf("ks_stat", F.col("n_ref").cast("double"), F.col("n_cur").cast("double"))
        _write(ks.withColumn("p_value", p).withColumn("drifted", F.col("p_value") < m.alpha), m.path("drift"), batch_id)

    return (counted.writeStream.outputMode("update").foreachBatch(handle)
            .option("checkpointLocation", m.path("drift_checkpoint")).trigger(availableNow=True).start())


def watch_auc(records: DataFrame, labels: DataFrame, m: Monitor, score: Column) -> StreamingQuery:
    """Start the AUC query: ``records`` are scored on arrival, ``labels`` hold key, label and labelling time."""
    r = (records.where(F.col(m.at).isNotNull()).withColumn("score", score).select(m.key, m.at, "score")
         .withWatermark(m.at, m.delay))
    y = (labels.select(F.col(m.key).alias("__key"), m.label, m.labelled_at).withWatermark(m.labelled_at, m.delay))
    late = F.col(m.at) + F.expr(f"INTERVAL {m.label_within}")
    both = r.join(y, (F.col(m.key) == F.col("__key")) & (F.col(m.labelled_at) >= F.col(m.at)) & (F.col(m.labelled_at) <= late))

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        # append mode: a labelled record is in one batch only, so counts of batches may be added up
        placed = batch.withColumn("window", F.window(m.at, m.width)).withColumn("window", utc_day(F.col("window.start")))
        by_window = X.score_counts(placed, m.label, "score", ["window"])
        _write(by_window, m.path("scores"), batch_id)
        held = _touched(spark, m.path("scores"), SCORES, batch_id).groupBy("window", "score") \
            .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
        ref = X.auc_of_counts(spark.read.parquet(m.path("reference_scores")), []).select(F.col("auc").alias("a")).scalar()
        cur = X.auc_of_counts(held, ["window"]).withColumnRenamed("auc", "auc_cur").withColumn("auc_ref", ref)
        drop = (F.col("auc_ref") - F.col("auc_cur")) * 100
        out = cur.select("window", "auc_ref", "auc_cur", "n_pos", "n_neg", drop.alias("degradation_pct"),
                         F.when(drop.isNull(), None).when(drop > m.tolerance_pct, "DEGRADED").otherwise("STABLE").alias("status"))
        _write(out, m.path("auc"), batch_id)

    return (both.writeStream.outputMode("append").foreachBatch(handle)
            .option("checkpointLocation", m.path("auc_checkpoint")).trigger(availableNow=True).start())


def latest(spark: SparkSession, m: Monitor, part: str, keys: Sequence[str]) -> DataFrame:
    """The newest row of every key of ``part`` (``drift`` or ``auc``)."""
    rows = spark.read.parquet(m.path(part))
    whole = F.struct(*[c for c in rows.columns if c != "batch_id"])
    return rows.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.max_by(whole, "batch_id").alias("r")).select("r.*")


def drift_of(ks: DataFrame) -> DataFrame:
    """D2 of the watched windows: drifted features, KS and p with 4 digits, means with 3, largest KS first."""
    return (ks.where("drifted").select(
        "window", "feature", F.bround("ks_stat", 4).alias("ks_stat"), F.bround("p_value", 4).alias("p_value"),
        F.bround("ref_mean", 3).alias("ref_mean"), F.bround("cur_mean", 3).alias("cur_mean"))
        .orderBy("window", F.desc("ks_stat"), "feature"))
