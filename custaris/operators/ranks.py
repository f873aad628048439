"""Distributed ordered statistics: prefix sums, exact quantiles, modes.

Exact quantiles, ROC curves and KS statistics all need "how many rows are
below this value".  The obvious Spark spellings do not scale:

* ``percentile`` / ``median`` / ``mode`` keep a hash map of every distinct
  value of a group and merge it in a single task;
* a window ordered by value with no partition sends the whole column to one
  task.

Here the work is split in two levels instead:

1. rows are reduced to distinct ``(group, value)`` with summed weights
   (map-side combined), so a value held by a third of all rows is one row;
   these counts are written once, so that what follows reads them and never
   the input again;
2. an approximate quantile sketch of the counts (mergeable, bounded memory)
   cuts each group into value ranges, about one for ``BUCKET_ROWS`` counts;
3. a window partitioned by ``(group, bucket)`` gives prefix sums inside a
   bucket; bucket totals (groups × buckets rows) get their own prefix sum and
   are joined back (AQE broadcasts them when the runtime size is small).

The result is exact; only the bucket boundaries are approximate, and they
influence only how the work is spread.  No large exchange is keyed on the
group alone: rows move by ``(group, bucket)``, and what moves by group are
sketches and at most ``MAX_BUCKETS`` totals a group.  Null group values are
groups of their own.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

_G = "__grp"
BUCKET_ROWS = 100_000        # counts of a bucket
MAX_BUCKETS = 1 << 14
MAX_BROADCAST_BOUNDS = 4 << 20  # bounds (groups × buckets doubles) that are broadcast; beyond it they are joined by shuffle


def _with_key(df: DataFrame, group_cols: Sequence[str]) -> DataFrame:
    """One non-null key column for the group, so that joins and windows treat null groups like any other."""
    parts = [F.coalesce(F.concat(F.lit("v"), F.col(f"`{c}`").cast("string")), F.lit("n")) for c in group_cols]
    return df.withColumn(_G, F.concat_ws("\u0001", F.lit("g"), *parts))


def _stored(df: DataFrame) -> DataFrame:
    """``df`` written in the shared folder and read back."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/custaris-ranks-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _bucketed(df: DataFrame, group_cols: Sequence[str], order_col: str, weight_cols: Sequence[str],
              descending: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows with key, bucket and prefix sums inside the bucket; bucket totals with their offsets)."""
    key = -F.col(order_col) if descending else F.col(order_col)
    rows = _stored(_with_key(df, group_cols).withColumn("__ord", key.cast("double")))
    buckets = min(MAX_BUCKETS, max(1, math.ceil(rows.count() / BUCKET_ROWS)))  # the count comes from the files' footers
    if buckets == 1:
        tagged = rows.withColumn("__bucket", F.lit(0))
    else:
        step = math.ceil(math.sqrt(buckets))
        probs = [i / buckets for i in range(1, buckets)]
        bounds = _stored(rows.groupBy(_G).agg(F.percentile_approx("__ord", probs, max(10_000, 4 * buckets)).alias("__bounds")))
        # every step-th bound is kept apart, so a row looks at 2 * step bounds and not at all of them
        small = bounds.count() * buckets <= MAX_BROADCAST_BOUNDS
        bounds = bounds.select(_G, "__bounds", F.expr(f"filter(__bounds, (b, i) -> i % {step} = {step - 1})").alias("__coarse"))
        at = F.size(F.filter("__coarse", lambda b: b < F.col("__ord")))
        tagged = (rows.join(F.broadcast(bounds) if small else bounds, _G, "inner").withColumn("__step", at)
                  .withColumn("__bucket", (F.col("__step") * step + F.size(F.filter(
                      F.slice("__bounds", F.col("__step") * step + 1, F.lit(step)), lambda b: b < F.col("__ord")))).cast("int"))
                  .drop("__bounds", "__coarse", "__step"))
    w_in = (Window.partitionBy(_G, "__bucket").orderBy("__ord")
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    totals = tagged.groupBy(_G, "__bucket").agg(*[F.sum(w).alias(f"__bt_{w}") for w in weight_cols])
    w_b = Window.partitionBy(_G).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    w_all = Window.partitionBy(_G)
    for w in weight_cols:
        tagged = tagged.withColumn(f"__in_{w}", F.sum(w).over(w_in) - F.col(w))
        totals = (totals.withColumn(f"__off_{w}", F.sum(f"__bt_{w}").over(w_b) - F.col(f"__bt_{w}"))
                  .withColumn(f"{w}_total", F.sum(f"__bt_{w}").over(w_all)))
    return tagged, totals


def prefix_sums(df: DataFrame, group_cols: Sequence[str], order_col: str,
                weight_cols: Sequence[str], *, descending: bool = False) -> DataFrame:
    """Exclusive prefix sums of ``weight_cols`` along ``order_col`` per group.

    ``df`` must hold one row per distinct ``(group, order_col)`` value (use
    :func:`value_counts` first).  Adds ``<w>_before`` (sum over strictly
    earlier values) and ``<w>_total`` (group total) for every weight column.
    """
    tagged, totals = _bucketed(df, group_cols, order_col, weight_cols, descending)
    out = tagged.join(totals.drop(*[f"__bt_{w}" for w in weight_cols]), [_G, "__bucket"], "inner")
    for w in weight_cols:
        out = out.withColumn(f"{w}_before", F.col(f"__off_{w}") + F.col(f"__in_{w}"))
    return out.drop("__ord", "__bucket", _G, *[f"__{k}_{w}" for k in ("in", "off") for w in weight_cols])


def value_counts(df: DataFrame, group_cols: Sequence[str], value_col: str, weight: str = "__c") -> DataFrame:
    """Distinct (group, value) with row counts; nulls are skipped."""
    return (df.where(F.col(value_col).isNotNull())
            .groupBy(*group_cols, value_col).agg(F.count("*").alias(weight)))


def exact_quantiles(df: DataFrame, group_cols: Sequence[str], value_col: str, probs: Sequence[float]) -> DataFrame:
    """Linear-interpolated quantiles (numpy default, DuckDB ``quantile_cont``).

    Returns ``group_cols + [prob, quantile]``; groups with no non-null value
    produce no rows.  A rank's bucket follows from the bucket totals; the value
    is then found by an equi-join on (group, bucket).
    """
    g = list(group_cols)
    tagged, totals = _bucketed(value_counts(df, g, value_col), g, value_col, ["__c"])
    n = F.col("__c_total")
    h = F.col("prob") * (n - 1)
    ranks = (totals.withColumn("prob", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
             .withColumn("__frac", h - F.floor(h))
             .withColumn("__r", F.explode(F.array(*[F.struct(F.lit(k).alias("which"), F.least(F.floor(h) + k, n - 1).alias("r")) for k in (0, 1)])))
             .where((F.col("__r.r") >= F.col("__off___c")) & (F.col("__r.r") < F.col("__off___c") + F.col("__bt___c")))
             .select(_G, "__bucket", "prob", "__frac", "__r.which", (F.col("__r.r") - F.col("__off___c")).alias("__at")))
    hit = tagged.join(ranks, [_G, "__bucket"]).where(
        (F.col("__at") >= F.col("__in___c")) & (F.col("__at") < F.col("__in___c") + F.col("__c")))
    v = F.col(f"`{value_col}`").cast("double")
    res = hit.groupBy(*g, "prob").agg(
        F.max(F.when(F.col("which") == 0, v)).alias("__vlo"), F.max(F.when(F.col("which") == 1, v)).alias("__vhi"),
        F.first("__frac").alias("__frac"))
    q = F.col("__vlo") + F.col("__frac") * (F.col("__vhi") - F.col("__vlo"))
    return res.select(*g, "prob", F.when(F.col("__frac") == 0, F.col("__vlo")).otherwise(q).alias("quantile"))


def quantiles_wide(df: DataFrame, group_cols: Sequence[str], value_col: str,
                   probs: Sequence[float], names: Sequence[str]) -> DataFrame:
    """:func:`exact_quantiles` pivoted to one column per probability."""
    q = exact_quantiles(df, group_cols, value_col, probs)
    aggs = [F.max(F.when(F.col("prob") == float(p), F.col("quantile"))).alias(n) for p, n in zip(probs, names)]
    if group_cols:
        return q.groupBy(*group_cols).agg(*aggs)
    return q.agg(*aggs)


def exact_median(df: DataFrame, group_cols: Sequence[str], value_col: str, name: str = "median") -> DataFrame:
    return quantiles_wide(df, group_cols, value_col, [0.5], [name])


def mode_of(df: DataFrame, group_cols: Sequence[str], value_col: str, name: str = "mode") -> DataFrame:
    """Most frequent non-null value per group, smallest value on ties.

    Two-level: counts per (group, value) are map-side combined, then
    ``max_by``-style selection keeps one struct per group (no per-group map).
    """
    vc = value_counts(df, group_cols, value_col)
    best = F.min_by(F.col(value_col), F.struct((-F.col("__c")).alias("a"), F.col(value_col).alias("b")))
    if group_cols:
        return vc.groupBy(*group_cols).agg(best.alias(name))
    return vc.agg(best.alias(name))
