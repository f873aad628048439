"""Structured Streaming: scoring (R8) and drift monitoring (D6) of arriving records.

Records arrive as JSON request files in a folder (file source, fixed
schema).  Each micro-batch goes through the very same R1 transform and model
as batch scoring inside ``foreachBatch`` and is written to its own folder of a
Parquet sink (a replayed batch overwrites it); the stream keeps no state (each
record is scored on its own), so the sink equals the batch result.  Checkpoints, inputs and sinks live under the
shared ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as SF
from ..operators import drift as D
from ..operators import models as M
from ..operators import split as E
from ..session import ensure_checkpoint_dir
from ..sources import requests as RQ


def _scratch(spark: SparkSession, tag: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/custaris-stream-{tag}-{uuid.uuid4().hex[:8]}"


def write_arrivals(df: DataFrame, path: str, n_files: int = 4, key: str = "CustomerID") -> None:
    """Write request bodies as ``n_files`` JSON-lines files (one micro-batch each)."""
    bodies = RQ.request_json(df, key)
    (bodies.repartition(n_files, F.xxhash64("body")).write.mode("overwrite").text(path))


def score_rows(rows: DataFrame, run, keep=()) -> DataFrame:
    """Raw customer rows → probability (4 digits), prediction, label, risk band, threshold (3 digits)."""
    p = run.score(M.assemble(run.prep.transform(rows, keep=keep), run.feats))
    hit = F.col("prediction_cal")
    return p.select("CustomerID", F.bround("p_cal", 4).alias("probability"), hit.alias("prediction"),
                    SF.churn_label(hit).alias("label"), SF.risk_band(F.col("p_cal")).alias("risk_level"),
                    F.lit(round(run.threshold, 3)).alias("threshold_used"), *keep)


def score_requests(bodies: DataFrame, run, body_col: str = "body") -> DataFrame:
    """Request bodies → one result row each.  A body that can't be
    read keeps its row, with null results and the reason in ``error``."""
    scored = score_rows(RQ.parse_requests(bodies, body_col), run, keep=["_corrupt"])
    results = ["probability", "prediction", "label", "risk_level"]
    return scored.select(
        "CustomerID", *[F.when(~F.col("_corrupt"), F.col(c)).alias(c) for c in results], "threshold_used",
        F.when(F.col("_corrupt"), "unreadable request body").alias("error"))


def write_batch(df: DataFrame, sink: str, batch_id: int) -> None:
    """One folder a micro-batch, overwritten when the batch is replayed, so no row is doubled."""
    df.write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")


def score_stream(spark: SparkSession, sf: str, customers: DataFrame, run, n_files: int = 4) -> DataFrame:
    """File stream of requests → micro-batch scoring → Parquet sink (read back)."""
    src, sink, ckpt = (_scratch(spark, t) for t in ("in", "out", "ckpt"))
    write_arrivals(customers, src, n_files)
    stream = spark.readStream.schema("value string").option("maxFilesPerTrigger", 1).text(src)

    def handle(batch: DataFrame, batch_id: int) -> None:
        write_batch(score_requests(batch, run, "value"), sink, batch_id)

    q = (stream.writeStream.foreachBatch(handle).option("checkpointLocation", ckpt)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(sink)


def monitor_stream(spark: SparkSession, sf: str, customers: DataFrame, cols=None, n_files: int = 4) -> DataFrame:
    """reference = one hash half, stored once as counts per (feature, value);
    the other half arrives as a stream and every micro-batch's counts are merged
    with the stored ones for its KS statistics."""
    from ..plans.q_monitor import MONITORED
    cols = list(cols or MONITORED)
    halves = E.time_or_hash_halves(customers, "CustomerID")
    ref_path, src, sink, ckpt = (_scratch(spark, t) for t in ("ref", "in", "out", "ckpt"))
    D.value_counts(halves.where(F.col("side") == "reference"), "side", cols).write.mode("overwrite").parquet(ref_path)
    cur = halves.where(F.col("side") == "current")
    cur.select(F.to_json(F.struct(*cols)).alias("value")).repartition(n_files, F.xxhash64("value")) \
        .write.mode("overwrite").text(src)
    schema = customers.select(*cols).schema
    stream = spark.readStream.schema("value string").option("maxFilesPerTrigger", 1).text(src)

    def handle(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select(F.from_json("value", schema).alias("r")).select("r.*").withColumn("side", F.lit("current"))
        both = spark.read.parquet(ref_path).unionByName(D.value_counts(rows, "side", cols))
        merged = both.groupBy("feature", "value").agg(F.sum("r").alias("r"), F.sum("c").alias("c"))
        write_batch(D.ks_from_counts(merged), sink, batch_id)

    q = (stream.writeStream.foreachBatch(handle).option("checkpointLocation", ckpt)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(sink)
