"""Registered segmentation queries.

The stages (K scan, silhouettes, assigned rows) are kept in the model store,
like the reference's fitted-model cache; each query asks for the ones it
shows and runs its own Spark aggregation over the assigned customers.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as FE
from ..operators import kmeans as KM
from ..operators import models as M
from ..operators import segment as SG
from . import training as T
from .catalog import c360, finish, register

K_SCAN = list(range(2, 11))
SIL_SCAN = list(range(2, 8))
SEEDS = list(range(42, 52))


class Segments:
    """Stages of the segmentation of one input."""

    def __init__(self, spark, sf):
        self.spark, self.sf, self.store = spark, sf, T.store(spark, sf)
        self.prep = T.prepared(spark, sf)
        self.cols = [c for c in SG.CLUSTERING_FEATURES if c in self.prep.features]
        self.scan = {"ks": K_SCAN, "seeds": SEEDS, "sil": SIL_SCAN}

    def rows(self):
        """Customers within 4 standard deviations (F29), nulls as 0 (F30), with the clustering features as a vector."""
        def build():
            x = T.feature_rows(self.spark, self.sf).select("CustomerID", "Churn", *self.cols).fillna(0.0, subset=self.cols)
            x = SG.assemble(FE.drop_z_outliers(x, self.cols, 4.0), self.cols)
            return x.repartition(M.parts_for(x.count(), len(self.cols)), "CustomerID")
        return self.store.table("segment-rows", {"z": 4.0}, build)

    @property
    def models(self) -> dict[int, KM.Centers]:
        """The best of ten starts for every K."""
        got = self.store.value("kmeans", self.scan, lambda: [[k, m.to_dict()] for k, m in KM.fit_many(
            self.rows(), K_SCAN, "CustomerID", SEEDS).items()])
        return {int(k): KM.Centers.from_dict(m) for k, m in got}

    @property
    def inertias(self) -> dict[int, float]:
        return {k: m.cost for k, m in self.models.items()}

    def sample(self):
        return self.store.table("silhouette-sample", {"rows": SG.SAMPLE_ROWS}, lambda: SG.silhouette_sample(self.rows(), "CustomerID"))

    @property
    def silhouettes(self) -> dict[int, float]:
        """Mean silhouette of the sample's rows within the sample, by K."""
        def build():
            out = []
            for k in SIL_SCAN:
                at = self.models[k].transform(self.sample())
                s = SG.silhouette_per_row(at, at, "CustomerID").agg(F.avg("silhouette")).first()[0]
                out.append([k, float(s or 0.0)])
            return out
        return {int(k): v for k, v in self.store.value("silhouettes", self.scan, build)}

    @property
    def elbow_k(self) -> int:
        return SG.elbow(self.spark, self.inertias)[1]

    @property
    def k(self) -> int:
        return SG.final_k(self.elbow_k, self.silhouettes)

    @property
    def model(self) -> KM.Centers:
        return self.models[self.k]

    def assigned(self):
        return self.store.table("segments", {**self.scan, "k": self.k}, lambda: self.model.transform(self.rows()))


def segments(spark, sf) -> Segments:
    return Segments(spark, sf)


@register("m07_kmeans_centers")
def m07(spark, sf):
    """M7: centres of the final K-Means model (long: cluster, feature, centre) and its cost."""
    s = segments(spark, sf)
    m = s.model
    rows = [(i, c, float(v)) for i, ctr in enumerate(m.clusterCenters()) for c, v in zip(s.cols, ctr)]
    return finish(spark.createDataFrame(rows, "Cluster int, feature string, center double")
                  .withColumn("training_cost", F.lit(m.cost)))


@register("m17_elbow")
def m17(spark, sf):
    """Inertia for K = 2..10 and the elbow K."""
    return finish(SG.elbow(spark, segments(spark, sf).inertias)[0])


@register("m18_silhouette_by_k")
def m18(spark, sf):
    """Mean Euclidean silhouette on the sample for K = 2..7."""
    sils = segments(spark, sf).silhouettes
    best = max(sils, key=sils.get)
    return finish(spark.createDataFrame([(kk, v, kk == best) for kk, v in sorted(sils.items())],
                                        "k int, silhouette double, is_best boolean"))


@register("m19_silhouette_per_cluster")
def m19(spark, sf):
    """Euclidean silhouette of every row by its distances to the sample, distribution per cluster."""
    seg = segments(spark, sf)
    s = SG.silhouette_per_row(seg.assigned(), seg.model.transform(seg.sample()), "CustomerID")
    return finish(s.groupBy("Cluster").agg(F.count("*").cast("long").alias("n"), F.avg("silhouette").alias("mean"),
                                           F.min("silhouette").alias("min"), F.max("silhouette").alias("max"),
                                           F.count_if(F.col("silhouette") < 0).cast("long").alias("n_negative")))


@register("m20_final_k")
def m20(spark, sf):
    """The K choice rule over the elbow and silhouette tables."""
    seg = segments(spark, sf)
    sils = seg.silhouettes
    best = max(sils, key=sils.get)
    return finish(spark.createDataFrame([(seg.elbow_k, best, sils[best], seg.k)],
                                        "elbow_k int, best_silhouette_k int, max_silhouette double, final_k int"))


@register("m21_cluster_sizes")
def m21(spark, sf):
    assigned = segments(spark, sf).assigned()
    return finish(SG.cluster_sizes(assigned))


def _profile(spark, sf):
    s = segments(spark, sf)
    return SG.profile(s.assigned(), s.cols, "Churn", s.prep.scale_mean, s.prep.scale_std)


@register("m22_cluster_profile")
def m22(spark, sf):
    """Cluster means in unscaled units (logged columns stay logged), 3 digits."""
    return finish(_profile(spark, sf))


@register("m23_churn_by_cluster")
def m23(spark, sf):
    assigned = segments(spark, sf).assigned()
    return finish(SG.churn_by_cluster(assigned, "Churn"))


def _names(spark, sf):
    rows = [r.asDict() for r in _profile(spark, sf).collect()]  # ≤ K rows
    return SG.name_clusters(rows)


@register("m24_cluster_names")
def m24(spark, sf):
    """Greedy business names over the profile rows."""
    names = _names(spark, sf)
    prof = _profile(spark, sf)
    tab = spark.createDataFrame([(int(k), v[0], v[1]) for k, v in names.items()],
                                "Cluster int, ClusterName string, ClusterLabel string")
    return finish(prof.select("Cluster", "Churn", "Frequency", "MonetaryTotal").join(tab, "Cluster"))


@register("m25_cluster_assignments")
def m25(spark, sf):
    """Every kept customer with its cluster id, name and churn label."""
    assigned = segments(spark, sf).assigned()
    named = SG.assign_names(assigned, _names(spark, sf))
    return named.select("CustomerID", "Cluster", "ClusterName", "Churn")


@register("m26_legacy_cluster_names")
def m26(spark, sf):
    """Legacy naming from churn % and mean recency (raw days) per cluster."""
    assigned = segments(spark, sf).assigned()
    raw = c360(spark, sf).select("CustomerID", "Recency")
    g = assigned.join(raw, "CustomerID").groupBy("Cluster").agg(
        (F.avg(F.col("Churn").cast("double")) * 100).alias("churn_pct"),
        F.avg(F.col("Recency").cast("double")).alias("recency"),
        F.avg("Frequency").alias("frequency"))
    return finish(g.select("Cluster", "churn_pct", "recency",
                           SG.legacy_name(F.col("Cluster"), F.col("churn_pct"), F.col("recency"),
                                          F.col("frequency")).alias("ClusterName")))


@register("f37_profile_minmax")
def f37(spark, sf):
    """min-max normalised cluster profile, (x - min)/(max - min + 1e-9) per feature."""
    prof = _profile(spark, sf)
    cols = [c for c in prof.columns if c not in ("Cluster", "Churn")]
    long = prof.unpivot(["Cluster"], cols, "feature", "value")
    # one row per (cluster, feature): the grouped profile is K × features rows
    mm = long.groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    return finish(long.join(F.broadcast(mm), "feature").select(
        "Cluster", "feature", ((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo") + 1e-9)).alias("normalised")))


@register("f26_pca_projection_2d")
def f26(spark, sf):
    """2-D PCA projection of the clustered customers with cluster and churn, plus PC1/PC2 variance share."""
    assigned = segments(spark, sf).assigned()
    model, ev = M.pca_fit(assigned, "features", 2, threshold=2.0)
    from pyspark.ml.functions import vector_to_array
    pts = model.transform(assigned).select("CustomerID", "Cluster", "Churn", vector_to_array("pca").alias("pc"))
    return finish(pts.select("CustomerID", "Cluster", "Churn", F.col("pc")[0].alias("PC1"), F.col("pc")[1].alias("PC2"))
                  .withColumn("pc1_var_pct", F.lit(float(ev[0]) * 100)).withColumn("pc2_var_pct", F.lit(float(ev[1]) * 100)))
