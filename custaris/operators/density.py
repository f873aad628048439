"""Kernel density per feature and group on a fixed grid.

Gaussian kernel with Scott's bandwidth ``sd * n^(-1/5)``; the grid has ``points`` points over the range and half of it on
either side, as the reference's plots.  Values are binned linearly: each shares its weight between the two nearest of bins a
sixteenth of the bandwidth wide, so the binned counts are mergeable and one row a bin.  Every bin then reaches the grid
points within ``REACH`` bandwidths: bins times width, never rows times grid, and as the bins grow narrower the width in
grid points shrinks with them.

Groups with fewer than two values or no spread have no density and no rows; nulls are left out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .profile import melt

PARTS = 16                 # bins a bandwidth
REACH = 8                  # bandwidths beyond which the kernel is left out (below 2e-14 of its peak)


def kernel_density(df: DataFrame, cols: Sequence[str], by: str, points: int = 1000) -> DataFrame:
    """(feature, ``by``, point, x, density, n) for every feature and group."""
    long = melt(df, cols, [by]).where(F.col("value").isNotNull())
    s = long.groupBy("feature", by).agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"),
                                        F.stddev_samp("value").alias("sd")).where("n > 1 and sd > 0")
    s = s.select("feature", F.col(by).alias("__by"), "n", "lo", (F.col("hi") - F.col("lo")).alias("range"),
                 (F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2))).alias("h"))
    same = (F.col("l.feature") == F.col("s.feature")) & F.col(f"l.{by}").eqNullSafe(F.col("s.__by"))
    at = (F.col("value") - F.col("lo")) / (F.col("h") / PARTS)
    j = F.floor(at)
    bins = long.alias("l").join(s.alias("s"), same).select(F.col("s.feature").alias("feature"), "__by", F.explode(F.array(
        F.struct(j.alias("j"), (1 - (at - j)).alias("w")), F.struct((j + 1).alias("j"), (at - j).alias("w")))).alias("b"))
    bins = bins.groupBy("feature", "__by", "b.j").agg(F.sum("b.w").alias("w")).where("w > 0")
    step, first = F.col("range") * 2 / (points - 1), F.col("lo") - F.col("range") / 2
    x = F.col("lo") + F.col("j") * (F.col("h") / PARTS)
    both = (F.col("b.feature") == F.col("s.feature")) & F.col("b.__by").eqNullSafe(F.col("s.__by"))
    reach = bins.alias("b").join(s.alias("s"), both).select(
        F.col("s.feature").alias("feature"), F.col("s.__by").alias("__by"), "w", "h", x.alias("x"), first.alias("first"), step.alias("step"),
        F.greatest(F.lit(0), F.ceil((x - REACH * F.col("h") - first) / step)).cast("int").alias("from"),
        F.least(F.lit(points - 1), F.floor((x + REACH * F.col("h") - first) / step)).cast("int").alias("to"))
    reach = reach.where(F.col("from") <= F.col("to")).withColumn("i", F.explode(F.sequence("from", "to")))
    u = (F.col("first") + F.col("i") * F.col("step") - F.col("x")) / F.col("h")
    sums = reach.groupBy("feature", "__by", "i").agg(F.sum(F.col("w") * F.exp(-0.5 * u * u)).alias("k"))
    grid = s.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    hit = (F.col("g.feature") == F.col("k.feature")) & F.col("g.__by").eqNullSafe(F.col("k.__by")) & (F.col("g.i") == F.col("k.i"))
    density = F.coalesce(F.col("k"), F.lit(0.0)) / (F.col("n") * F.col("h") * (2 * 3.141592653589793) ** 0.5)
    return grid.alias("g").join(sums.alias("k"), hit, "left").select(
        F.col("g.feature").alias("feature"), F.col("g.__by").alias(by), F.col("g.i").alias("point"),
        (first + F.col("g.i") * step).alias("x"), density.alias("density"), F.col("n").cast("long").alias("n"), "range")


def density_sql(cols: Sequence[str], by: str, points: int, source: str = "c360") -> str:
    """DuckDB text of :func:`kernel_density`."""
    sel = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in cols)
    return f"""
WITH l AS (SELECT {by} AS g, feature, value FROM (SELECT {by}, {sel} FROM {source}) UNPIVOT (value FOR feature IN ({', '.join(cols)}))),
s AS (SELECT feature, g, n, lo, hi - lo AS rng, sd * pow(CAST(n AS DOUBLE), -0.2) AS h FROM (
      SELECT feature, g, count(*) AS n, min(value) AS lo, max(value) AS hi, stddev_samp(value) AS sd FROM l GROUP BY feature, g) WHERE n > 1 AND sd > 0),
t AS (SELECT feature, g, (value - lo) / (h / {PARTS}) AS t FROM l JOIN s USING (feature, g)),
b AS (SELECT feature, g, j, sum(w) AS w FROM (SELECT feature, g, floor(t) AS j, 1 - (t - floor(t)) AS w FROM t
      UNION ALL SELECT feature, g, floor(t) + 1, t - floor(t) FROM t) GROUP BY feature, g, j),
p AS (SELECT feature, g, n, lo, rng, h, lo - rng / 2 AS first, rng * 2 / ({points} - 1) AS step, unnest(range({points})) AS i FROM s),
k AS (SELECT p.feature, p.g, p.i, sum(w * exp(-0.5 * pow((first + i * step - (lo + j * (h / {PARTS}))) / h, 2))) AS k
      FROM p JOIN b ON b.feature = p.feature AND b.g = p.g
       AND abs(first + i * step - (lo + j * (h / {PARTS}))) <= {REACH} * h GROUP BY p.feature, p.g, p.i)
SELECT p.feature, p.g AS {by}, CAST(p.i AS INTEGER) AS point, first + p.i * step AS x,
       round_even(coalesce(k, 0) / (n * h * sqrt(2 * pi())) * rng, 6) AS scaled_density, CAST(n AS BIGINT) AS n
FROM p LEFT JOIN k ON k.feature = p.feature AND k.g = p.g AND k.i = p.i"""
