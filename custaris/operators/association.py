"""Association, redundancy and leakage.

Pairwise Pearson correlations are computed in *one* aggregation: for every
pair the pairwise-complete sums (n, Σx, Σy, Σx², Σy², Σxy) are partial
aggregates, so a single scan with map-side combine serves the whole matrix.
The result is a long (feature_a, feature_b, r) table, never a wide matrix.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import fix_col



def _q(c: str) -> str:
    return f"`{c}`"


def _pair_sums_sql(a: str, b: str, i: int) -> list[str]:
    x, y = f"CAST({_q(a)} AS DOUBLE)", f"CAST({_q(b)} AS DOUBLE)"
    both = f"{x} IS NOT NULL AND {y} IS NOT NULL"
    xs, ys = f"(CASE WHEN {both} THEN {x} END)", f"(CASE WHEN {both} THEN {y} END)"
    return [f"count({xs}) AS n_{i}", f"covar_pop({xs}, {ys}) AS cov_{i}", f"stddev_pop({xs}) AS dx_{i}", f"stddev_pop({ys}) AS dy_{i}",
            f"(min({xs}) < max({xs}) AND min({ys}) < max({ys})) AS varies_{i}"]


def _r_sql(i: int) -> str:
    r = f"(CASE WHEN varies_{i} THEN cov_{i} / (dx_{i} * dy_{i}) END)"
    return f"CAST(floor(CAST({r} AS DOUBLE) * 1e9 + 0.5) / 1e9 AS DOUBLE)"


def pair_correlations(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Pearson r for each (a, b) over pairwise-complete rows; null when a side is constant.

    Built as SQL text (``selectExpr``): one JVM parse instead of thousands of
    Py4J Column calls; still a single aggregation with map-side combine.
    """
    aggs = [e for i, (a, b) in enumerate(pairs) for e in _pair_sums_sql(a, b, i)]
    one = df.selectExpr(*aggs)
    structs = ", ".join(f"named_struct('feature_a', '{a}', 'feature_b', '{b}', 'r', {_r_sql(i)}, "
                        f"'n', CAST(n_{i} AS BIGINT))" for i, (a, b) in enumerate(pairs))
    return one.selectExpr(f"inline(array({structs}))")


def _gram_partials(cols: Sequence[str]):
    """mapInPandas body: per partition, the pairwise-complete sum matrices
    N = MᵀM, SX = XᵀM, SXX = (X²)ᵀM, SXY = XᵀX (X: values with nulls as 0,
    M: non-null mask), flattened into one row of (pos, value) pairs."""
    k = len(cols)

    def run(batches):
        n = np.zeros((k, k)); sx = np.zeros((k, k)); sxx = np.zeros((k, k)); sxy = np.zeros((k, k))
        for pdf in batches:
            v = pdf[list(cols)].to_numpy(dtype="float64", na_value=np.nan)
            m = (~np.isnan(v)).astype("float64")
            x = np.nan_to_num(v, nan=0.0)
            n += m.T @ m
            sx += x.T @ m
            sxx += (x * x).T @ m
            sxy += x.T @ x
        flat = np.concatenate([n.ravel(), sx.ravel(), sxx.ravel(), sxy.ravel()])
        yield pd.DataFrame({"pos": np.arange(flat.size, dtype="int64"), "v": flat})
    return run


def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Lower triangle (a before b in the given order) of the Pearson matrix.

    One scan: each task reduces its rows to four k×k sum matrices with BLAS
    (numpy inside the task), Spark sums the partials by position (4k² rows
    per task, independent of the data size) and the r of every pair follows
    from the pairwise-complete sums.
    """
    cols = list(cols)
    k = len(cols)
    # r doesn't change under a shift: taking off each column's least value keeps the sums small against the spread and
    # makes a constant column exactly zero
    low = df.agg(*[F.min(F.col(c).cast("double")).alias(c) for c in cols]).first()
    typed = df.select(*[(F.col(c).cast("double") - F.lit(low[c] or 0.0)).alias(c) for c in cols])
    part = typed.mapInPandas(_gram_partials(cols), "pos long, v double")
    tot = part.groupBy("pos").agg(F.sum("v").alias("v"))
    pairs = [(i, j) for i in range(k) for j in range(i + 1, k)]
    spark = df.sparkSession
    idx = spark.createDataFrame(
        [(cols[i], cols[j], i * k + j, j * k + i, i * k + i, j * k + j) for i, j in pairs],
        "feature_a string, feature_b string, ij long, ji long, ii long, jj long")
    # the pair index and the summed matrices are bounded by the column list (k² rows)
    t = tot.select(F.col("pos"), F.col("v"))
    kk = k * k

    def pick(name, off, col):
        return t.select((F.col("pos") - off).alias(col), F.col("v").alias(name)).where(
            (F.col("pos") >= off) & (F.col("pos") < off + kk))
    n_ = pick("n", 0, "ij")
    sx_ = pick("sx", kk, "ij")        # Σ x_i over rows where x_j present  (i, j)
    sy_ = pick("sy", kk, "ji")        # Σ x_j over rows where x_i present  (j, i)
    sxx_ = pick("sxx", 2 * kk, "ij")
    syy_ = pick("syy", 2 * kk, "ji")
    sxy_ = pick("sxy", 3 * kk, "ij")
    j = (idx.join(F.broadcast(n_), "ij").join(F.broadcast(sx_), "ij").join(F.broadcast(sy_), "ji")
         .join(F.broadcast(sxx_), "ij").join(F.broadcast(syy_), "ji").join(F.broadcast(sxy_), "ij"))
    n = F.col("n")
    vx = F.col("sxx") - F.col("sx") * F.col("sx") / n
    vy = F.col("syy") - F.col("sy") * F.col("sy") / n
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / n
    # a column that is constant where the other is present leaves rounding noise only
    r = F.when((vx > F.col("sxx") * 1e-13) & (vy > F.col("syy") * 1e-13), cov / F.sqrt(vx * vy))
    return j.select("feature_a", "feature_b", fix_col(r).alias("r"), n.cast("long").alias("n"))


def target_correlations(df: DataFrame, cols: Sequence[str], target: str) -> DataFrame:
    """r(feature, target), with |r|, sorted by |r| desc."""
    r = pair_correlations(df, [(c, target) for c in cols])
    return (r.select(F.col("feature_a").alias("feature"), "r", F.abs("r").alias("abs_r"))
            .orderBy(F.desc_nulls_last("abs_r"), "feature"))


def leak_tiers(target_corr: DataFrame) -> DataFrame:
    """Tiers over |r|: > .70 high, (.40, .70] medium, else low; notebook flags."""
    a = F.col("abs_r")
    return target_corr.select(
        "feature", "r", "abs_r",
        F.when(a > 0.70, "high").when(a > 0.40, "medium").otherwise("low").alias("tier"),
        (a > 0.5).alias("leaky_flag"), (a > 0.3).alias("strong_flag"))


def point_biserial(df: DataFrame, cols: Sequence[str], target: str) -> DataFrame:
    """C4: r and t = r·sqrt((n-2)/(1-r²)) per feature (df = n-2)."""
    r = pair_correlations(df, [(c, target) for c in cols])
    t = F.col("r") * F.sqrt(F.try_divide(F.col("n") - 2, 1 - F.col("r") * F.col("r")))
    return r.select(F.col("feature_a").alias("feature"), "r", "n", t.alias("t"),
                    (F.col("n") - 2).alias("dof"))


# -- Student t tail (p-values on the per-feature rows only) -----------------------------

def _betacf(a: float, b: float, x: float) -> float:
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = 1.0 / (d if abs(d) > 1e-300 else 1e-300)
    h = d
    for m in range(1, 400):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > 1e-300 else 1e-300)
        c = 1.0 + aa / c if abs(1.0 + aa / c) > 1e-300 else 1e-300
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > 1e-300 else 1e-300)
        c = 1.0 + aa / c if abs(1.0 + aa / c) > 1e-300 else 1e-300
        de = d * c
        h *= de
        if abs(de - 1.0) < 1e-15:
            break
    return h


def betainc_reg(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b) (continued fraction)."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    lbt = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    if x < (a + 1) / (a + b + 2):
        return math.exp(lbt) * _betacf(a, b, x) / a
    return 1.0 - math.exp(lbt) * _betacf(b, a, 1 - x) / b


def t_two_sided_p(t: float, dof: float) -> float:
    if t is None or dof is None or dof <= 0 or (isinstance(t, float) and math.isnan(t)):
        return float("nan")
    if math.isinf(t):
        return 0.0
    return betainc_reg(dof / 2.0, 0.5, dof / (dof + t * t))


@F.pandas_udf(T.DoubleType())
def t_pvalue_udf(t: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([None if (pd.isna(a) or pd.isna(b)) else t_two_sided_p(float(a), float(b))
                      for a, b in zip(t, dof)], dtype="float64")


def point_biserial_pvalues(pb: DataFrame, alpha: float = 0.05) -> DataFrame:
    """C4 p-values (two-sided Student t) on the small per-feature table."""
    return pb.withColumn("p_value", t_pvalue_udf(F.col("t"), F.col("dof").cast("double"))) \
             .withColumn("significant", F.col("p_value") < alpha)


# -- C5, C6 ------------------------------------------------------------------------------

def pairs_above(corr: DataFrame, threshold: float) -> DataFrame:
    """Pairs with |r| > threshold (signed r kept), sorted by |r| desc."""
    return corr.where(F.abs("r") > threshold).orderBy(F.desc(F.abs("r")), "feature_a", "feature_b")


def multicollinear_drops(df: DataFrame, cols: Sequence[str], threshold: float = 0.8,
                         exclude: Sequence[str] = ()) -> DataFrame:
    """A column is dropped when |r| with any *earlier* column exceeds the
    threshold (earlier columns count even if dropped themselves).

    Returns one row per (dropped feature, earlier partner, r).
    """
    cols = [c for c in cols if c not in set(exclude)]
    corr = correlation_matrix(df, cols)
    return (corr.where(F.abs("r") > threshold)
            .select(F.col("feature_b").alias("feature"), F.col("feature_a").alias("partner"), "r"))


def drop_multicollinear(df: DataFrame, cols: Sequence[str], threshold: float = 0.8,
                        exclude: Sequence[str] = ()) -> tuple[DataFrame, list[str]]:
    """C6 applied: returns the frame without the dropped columns and the list."""
    drops = multicollinear_drops(df, cols, threshold, exclude)
    names = sorted({r["feature"] for r in drops.select("feature").distinct().collect()})  # ≤ len(cols)
    return df.drop(*names), names


# -- C7: VIF via the Gram matrix -------------------------------------------------------

def gram_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """C7 (part 1): XᵀX over rows with no null in ``cols`` — one aggregation."""
    clean = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).dropna()
    pairs = [(i, a, j, b) for i, a in enumerate(cols) for j, b in enumerate(cols) if j >= i]
    one = clean.selectExpr("count(*) AS n_rows", *[f"sum({_q(a)} * {_q(b)}) AS g_{i}_{j}" for i, a, j, b in pairs])
    structs = ", ".join(f"named_struct('feature_a', '{a}', 'feature_b', '{b}', 'xtx', g_{i}_{j}, "
                        f"'n_rows', CAST(n_rows AS BIGINT))" for i, a, j, b in pairs)
    return one.selectExpr(f"inline(array({structs}))")


def vif_from_gram(spark, gram: DataFrame, cols: Sequence[str]) -> DataFrame:
    """C7 (part 2): VIF_i = (XᵀX)_ii · ((XᵀX)⁻¹)_ii, uncentred as in OLS without
    intercept; infinite for a column that the others give exactly, null for
    one that is all zeros.  The k×k matrix (k ≤ max_features) is the only
    thing brought to the driver."""
    k = len(cols)
    idx = {c: i for i, c in enumerate(cols)}
    g = np.zeros((k, k))
    for r in gram.collect():  # k(k+1)/2 rows, bounded by the feature list
        i, j = idx[r["feature_a"]], idx[r["feature_b"]]
        g[i, j] = g[j, i] = r["xtx"] or 0.0
    vif = inflation(g)
    out = spark.createDataFrame([(c, v) for c, v in zip(cols, vif)], "feature string, vif double")
    return out.withColumn("severity", F.when(F.col("vif") > 10, "severe").when(F.col("vif") > 5, "moderate")
                          .otherwise("ok")).orderBy(F.desc("vif"))


RANK_TOLERANCE = 1e-10     # share of a column's square sum, not explained by the columns before it, that counts as none


def inflation(gram: np.ndarray) -> list[float | None]:
    """Variance inflation of each column of a Gram matrix, by pivoted Cholesky.

    Pivoting takes the column that the taken ones explain least, until none is left that they don't explain; the columns
    left out, and all those that take part in explaining them, are dependent.
    """
    size = np.sqrt(np.diag(gram))
    own = np.flatnonzero(size > 0)
    g = gram[np.ix_(own, own)] / np.outer(size[own], size[own])
    left, taken, rows = np.ones(len(own)), [], np.zeros((0, len(own)))
    while len(taken) < len(own):
        rest = left.copy()
        rest[taken] = -1
        p = int(rest.argmax())
        if rest[p] <= RANK_TOLERANCE:
            break
        row = (g[p] - rows[:, p] @ rows) / np.sqrt(left[p])
        rows, left = np.vstack([rows, row]), left - row * row
        taken.append(p)
    out: list[float | None] = [None] * len(gram)
    inverse = np.linalg.inv(g[np.ix_(taken, taken)]) if taken else np.zeros((0, 0))
    others = [j for j in range(len(own)) if j not in taken]
    share = np.abs(inverse @ g[np.ix_(taken, others)]) if others else np.zeros((len(taken), 0))
    for n, j in enumerate(taken):
        # the columns left out have no part in a column that explains none of them
        out[own[j]] = float("inf") if (share[n] > 1e-6).any() else float(inverse[n, n])
    for j in others:
        out[own[j]] = float("inf")
    return out


def compute_vif(df: DataFrame, cols: Sequence[str], max_features: int | None = None) -> DataFrame:
    cols = list(cols)[:max_features]
    return vif_from_gram(df.sparkSession, gram_matrix(df, cols), cols)


# -- C8, C10: suspect columns and recommended drops ---------------------------------------

def suspect_check(target_corr: DataFrame, all_cols: Sequence[str], suspects: Sequence[str],
                  threshold: float = 0.40) -> DataFrame:
    """Named suspects found → their |r|; absent ones → the first three
    columns containing the suspect's base name.  ``target_corr`` must cover
    ``all_cols``."""
    spark = target_corr.sparkSession
    cols = spark.createDataFrame([(list(all_cols),)], "cols array<string>").select(F.explode("cols").alias("feature"))
    wanted = spark.createDataFrame([(s, s.split("_")[0]) for s in suspects], "suspect string, base string")
    named = wanted.join(cols, F.col("suspect") == F.col("feature"), "left_semi").select("suspect", F.col("suspect").alias("feature"))
    # absent ones look through the list of column names, in its order
    like = wanted.join(cols, F.col("suspect") == F.col("feature"), "left_anti").select("suspect", F.explode(F.slice(F.filter(
        F.array(*[F.lit(c) for c in all_cols]), lambda c: c.contains(F.col("base"))), 1, 3)).alias("feature"))
    # at most 3 × len(suspects) rows
    return (F.broadcast(named.unionByName(like)).join(target_corr, "feature", "inner")
            .select("suspect", "feature", "abs_r", (F.col("abs_r") > threshold).alias("leaky")))


def recommended_drops(tiers: DataFrame, suspects: DataFrame, all_cols: Sequence[str],
                      importances: DataFrame | None = None, dominance: float = 0.30) -> DataFrame:
    """High-tier features ∪ every variant of the base name of a leaky suspect found by its own name
    (``rsplit('_', 1)``) ∪ variants of a dominant importance feature; sorted."""
    spark = tiers.sparkSession
    cols_df = spark.createDataFrame([(c,) for c in all_cols], "column string")
    high = tiers.where(F.col("tier") == "high").select(F.col("feature").alias("column"))
    bases = suspects.where("leaky and suspect = feature").select(F.regexp_extract("feature", r"^(.*)_[^_]*$", 1).alias("base"))
    if importances is not None:
        top = importances.orderBy(F.desc("importance"), "feature").limit(1).where(F.col("importance") > dominance)
        bases = bases.unionByName(top.select(
            F.when(F.col("feature").contains("_"), F.regexp_extract("feature", r"^(.*)_[^_]*$", 1))
            .otherwise(F.col("feature")).alias("base")))
    variants = cols_df.join(F.broadcast(bases.where(F.col("base") != "").distinct()),
                            F.col("column").startswith(F.concat(F.col("base"), F.lit("_"))) |
                            (F.col("column") == F.col("base")), "left_semi")
    return high.unionByName(variants).distinct().orderBy("column")
