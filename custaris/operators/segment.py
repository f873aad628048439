"""Customer segmentation.

K-Means: :mod:`kmeans`, all starts and cluster counts in one scan a step.
Silhouettes use the Euclidean distance, as the reference's, to a sample of
``SAMPLE_ROWS`` rows (the reference's size): every task measures its rows
against the sample and reduces the distances per cluster, so no pair of rows
of the table is formed.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- fixed values shared with the reference -------------------------------------------
CLUSTERING_FEATURES = [
    "Frequency", "MonetaryTotal", "CustomerTenureDays", "ReturnRatio", "CancelledTransactions",
    "UniqueProducts", "SupportTicketsCount", "EngagementScore", "DisengagementScore", "AvgBasketValue",
    "Country_TargetEnc",
]
# Cluster naming rules, in priority order (churn % thresholds, then medians of profiles).
LOST_PCT, AT_RISK_PCT = 60.0, 35.0
LABELS = ["Lost / Churned", "At Risk", "Champions", "Loyal", "Occasional"]


def assemble(df: DataFrame, cols: Sequence[str], out: str = "features") -> DataFrame:
    """F30 null → 0, then one vector column."""
    filled = df.fillna(0.0, subset=list(cols))
    return VectorAssembler(inputCols=list(cols), outputCol=out).transform(filled)


def elbow(spark, inertias: dict[int, float]) -> tuple[DataFrame, int]:
    """Inertia per K, drop to the next K, elbow = K at the bottom of the biggest drop."""
    ks = sorted(inertias)
    deltas = [inertias[ks[i]] - inertias[ks[i + 1]] for i in range(len(ks) - 1)]
    elbow_k = ks[deltas.index(max(deltas)) + 1]
    rows = [(k, float(inertias[k]), float(deltas[i - 1]) if i > 0 else None, k == elbow_k) for i, k in enumerate(ks)]
    return spark.createDataFrame(rows, "k int, inertia double, drop_from_previous double, is_elbow boolean"), elbow_k


SAMPLE_ROWS = 1000         # rows of the sample that distances are measured to


def silhouette_sample(df: DataFrame, key: str, rows: int = SAMPLE_ROWS, features: str = "features") -> DataFrame:
    """The ``rows`` rows of smallest key hash (key, features): a bounded, repeatable sample."""
    h = F.xxhash64(F.col(key).cast("string"), F.lit("silhouette"))
    return df.select(key, features, h.alias("__h")).orderBy("__h", key).limit(rows).drop("__h")


def silhouette_per_row(pred: DataFrame, sample: DataFrame, key: str, features: str = "features", cluster: str = "Cluster") -> DataFrame:
    """``pred`` with the silhouette of each row by its distances to the clustered ``sample`` (key, features, cluster).

    a: mean distance to the sample's other rows of the own cluster, b: the least mean distance to another cluster's;
    (b - a) / max(a, b), 0 where the own cluster has no other row.
    """
    got = sample.select(F.col(key).cast("string").alias("k"), vector_to_array(features).alias("x"), cluster).collect()  # SAMPLE_ROWS rows
    if not got:
        return pred.withColumn("silhouette", F.lit(0.0))
    ids, at, own = np.array([r["k"] for r in got]), np.array([r["x"] for r in got]), np.array([r[cluster] for r in got])
    names = np.unique(own)
    member = (own[:, None] == names).astype(float)

    @F.arrow_udf("double")
    def silhouette(x: pa.Array, k: pa.Array, c: pa.Array) -> pa.Array:
        if not len(x):
            return pa.array([], pa.float64())
        m = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)
        mine, key_of = c.to_numpy(zero_copy_only=False), np.array(k.to_pylist(), object)
        out = np.zeros(len(m))
        for lo in range(0, len(m), 4096):  # bounded blocks of distances
            hi = min(lo + 4096, len(m))
            d = np.sqrt(np.maximum((m[lo:hi] ** 2).sum(1)[:, None] - 2 * m[lo:hi] @ at.T + (at ** 2).sum(1), 0))
            same = ids[None, :] == key_of[lo:hi, None]
            d[same] = 0
            total, n = d @ member, np.tile(member.sum(0), (hi - lo, 1))
            n -= same @ member                       # a row of the sample isn't its own neighbour
            is_own = mine[lo:hi, None] == names
            a = np.where(is_own, total, 0).sum(1) / np.maximum(np.where(is_own, n, 0).sum(1), 1)
            b = np.where(is_own | (n == 0), np.inf, total / np.maximum(n, 1)).min(1)
            alone = (np.where(is_own, n, 0).sum(1) == 0) | ~np.isfinite(b)
            top = np.maximum(np.maximum(a, np.where(np.isfinite(b), b, 0)), 1e-300)
            out[lo:hi] = np.where(alone, 0, (np.where(np.isfinite(b), b, 0) - a) / top)
        return pa.array(out)
    return pred.withColumn("silhouette", silhouette(vector_to_array(F.col(features)), F.col(key).cast("string"), F.col(cluster)))


def final_k(elbow_k: int, sil: dict[int, float], weak: float = 0.25) -> int:
    """Silhouette K unless weak (< 0.25) or 2, then max(elbow, 3)."""
    best = max(sil, key=sil.get)
    return max(elbow_k, 3) if (sil[best] < weak or best == 2) else best


def cluster_sizes(assigned: DataFrame, cluster: str = "Cluster") -> DataFrame:
    """Size and % per cluster."""
    n = assigned.agg(F.count("*")).scalar()
    return assigned.groupBy(cluster).agg(F.count("*").cast("long").alias("n")) \
        .withColumn("pct", F.col("n") * 100.0 / n)


def profile(assigned: DataFrame, cols: Sequence[str], label: str, means: dict[str, float],
            stds: dict[str, float], cluster: str = "Cluster", undo_log: Sequence[str] = ()) -> DataFrame:
    """Per-cluster means in unscaled units (x·std + mean; logs stay logged
    unless listed in ``undo_log``), plus the label mean; 3 digits."""
    exprs = []
    for c in cols:
        v = F.col(c) * stds.get(c, 1.0) + means.get(c, 0.0)
        if c in undo_log:
            v = F.signum(v) * F.expm1(F.abs(v))
        exprs.append(F.bround(F.avg(v), 3).alias(c))
    return assigned.groupBy(cluster).agg(*exprs, F.bround(F.avg(F.col(label).cast("double")), 3).alias(label))


def churn_by_cluster(assigned: DataFrame, label: str, cluster: str = "Cluster") -> DataFrame:
    """Churn % per cluster next to the overall churn %."""
    overall = assigned.agg(F.avg(F.col(label).cast("double")) * 100).scalar()
    return assigned.groupBy(cluster).agg((F.avg(F.col(label).cast("double")) * 100).alias("churn_pct")) \
        .withColumn("overall_pct", overall).withColumn("diff_pct", F.col("churn_pct") - F.col("overall_pct"))


def name_clusters(prof_rows: list[dict], cluster: str = "Cluster", label: str = "Churn") -> dict[int, tuple[str, str]]:
    """Names for the ≤ K profile rows.  A table says which label suits which cluster; clusters choose in order of
    churn, each its first suiting label that is still free, or 'Segment i'."""
    prof = pd.DataFrame(prof_rows).sort_values([label, cluster], ascending=[False, True]).set_index(cluster)
    churn = prof[label] * 100
    often, dear = prof["Frequency"] > prof["Frequency"].median(), prof["MonetaryTotal"] > prof["MonetaryTotal"].median()
    suits = pd.DataFrame(dict(zip(LABELS, [churn > LOST_PCT, churn > AT_RISK_PCT, often & dear, often, churn.notna() | churn.isna()])))
    free, names = list(LABELS), {}
    for i, row in suits.iterrows():
        mine = next((lab for lab in free if row[lab]), f"Segment {i}")
        free = [lab for lab in free if lab != mine]
        names[i] = (f"Cluster {i} — {mine}", mine)
    return names


def assign_names(assigned: DataFrame, names: dict[int, tuple[str, str]], cluster: str = "Cluster") -> DataFrame:
    """Attach names (a K-row table, broadcast) to every assigned row."""
    spark = assigned.sparkSession
    tab = spark.createDataFrame([(int(k), v[0], v[1]) for k, v in names.items()],
                                f"{cluster} int, ClusterName string, ClusterLabel string")
    return assigned.join(F.broadcast(tab), cluster, "left")


def legacy_name(cluster, churn_pct, recency, frequency):
    """M26 (legacy variant): churn > 60 Lost / Churned, > 35 At Risk,
    recency < 30 with any frequency Active Loyal, else Occasional."""
    lab = (F.when(churn_pct > 60, "Lost / Churned").when(churn_pct > 35, "At Risk")
           .when((recency < 30) & (frequency > 0), "Active Loyal").otherwise("Occasional"))
    return F.concat(F.lit("Cluster "), cluster.cast("string"), F.lit(" — "), lab)
