"""Splits, folds, weights and set operations.

Splits are keyed hashes, not ``randomSplit``: a row's side depends only on
its key and a salt, so the split is repeatable, independent of partitioning,
needs no shuffle, and DuckDB can repeat it.  Because every class is cut by
the same hash threshold, each class keeps its share on both sides
(stratified in expectation).  ``exact=True`` ranks rows inside each class by
hash with the distributed prefix sums, giving exactly ⌈test_size·n_c⌉ test
rows per class without collecting a class into one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ranks as R

HASH_SPACE = 2 ** 32


def key_hash(key: Column | str, salt: str) -> Column:
    """Uniform integer in [0, 2^32) from md5(key ':' salt) (same text in DuckDB)."""
    k = F.col(key) if isinstance(key, str) else key
    hexs = F.substring(F.md5(F.concat(k.cast("string"), F.lit(f":{salt}"))), 1, 8)
    return F.conv(hexs, 16, 10).cast("long")


def hash_split(df: DataFrame, key: str, test_size: float = 0.2, seed: int = 42,
               col: str = "split", salt: str | None = None) -> DataFrame:
    """E1/E4: 'test' when hash < test_size·2^32, else 'train' (shuffle-free)."""
    h = key_hash(key, salt or str(seed))
    return df.withColumn(col, F.when(h < int(test_size * HASH_SPACE), "test").otherwise("train"))


def exact_stratified_split(df: DataFrame, key: str, label: str, test_size: float = 0.2,
                           seed: int = 42, col: str = "split") -> DataFrame:
    """E1 exact: per class, the ⌈test_size·n_c⌉ rows with the smallest hash are test."""
    h = df.withColumn("__h", key_hash(key, str(seed)))
    counts = h.groupBy(label, "__h").agg(F.count("*").alias("__c"))
    ranked = R.prefix_sums(counts, [label], "__h", ["__c"])
    take = F.ceil(F.col("__c_total") * test_size)
    marks = ranked.select(label, "__h", F.when(F.col("__c_before") < take, "test").otherwise("train").alias(col))
    return h.join(marks, [label, "__h"], "inner").drop("__h")


def hash_folds(df: DataFrame, key: str, k: int = 5, seed: int = 42, col: str = "fold") -> DataFrame:
    """fold = hash mod k (stratified in expectation; usable as ``foldCol``)."""
    return df.withColumn(col, (key_hash(key, f"fold{seed}") % k).cast("int"))


def time_or_hash_halves(df: DataFrame, key: str, time_col: str | None = None,
                        cut=None, seed: int = 42, col: str = "side") -> DataFrame:
    """E5: reference/current halves — by date when a time column is given, else by hash."""
    if time_col is not None and cut is not None:
        side = F.when(F.col(time_col) < F.lit(cut), "reference").otherwise("current")
    else:
        side = F.when(key_hash(key, f"half{seed}") < HASH_SPACE // 2, "reference").otherwise("current")
    return df.withColumn(col, side)


def monitoring_sides(reference: DataFrame, key: str, production: DataFrame | None = None, time_col: str | None = None,
                     cut=None, seed: int = 42, col: str = "side", flag: str = "placeholder") -> DataFrame:
    """E5: what drift monitoring compares.  With a production set, all of ``reference`` against all of it
    (columns only one side has are null on the other); without one, halves of ``reference`` by date or hash.
    ``flag`` is true for hash halves: they hold no new data, so their differences are noise."""
    if production is not None:
        both = concat_rows([reference.withColumn(col, F.lit("reference")), production.withColumn(col, F.lit("current"))])
        return both.withColumn(flag, F.lit(False))
    halves = time_or_hash_halves(reference, key, time_col, cut, seed, col)
    return halves.withColumn(flag, F.lit(time_col is None or cut is None))


def balanced_weights(df: DataFrame, label: str, col: str = "weight") -> DataFrame:
    """N / (n_classes · n_c) per row (sklearn 'balanced')."""
    counts = df.groupBy(label).agg(F.count("*").alias("__nc"))
    n = df.agg(F.count("*")).scalar()
    k = counts.agg(F.count("*")).scalar()
    # one row per class label → broadcast
    return (df.join(F.broadcast(counts), label, "left")
            .withColumn(col, (n / (k * F.col("__nc"))).cast("double")).drop("__nc"))


def concat_rows(frames: Sequence[DataFrame]) -> DataFrame:
    """Row concatenation by column name."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def align_by_key(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Column concatenation — by key, never by position."""
    return left.join(right, key, "inner")
