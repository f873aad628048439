"""Helpers shared by the training-data operators.

Words are maximal runs of ``[^\\x20\\x09-\\x0D]``; ``bytes.split()`` and
``bytes.lower()`` have exactly that separator set and touch A-Z only, so Python
and SQL code agree on tokens.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

WORD_RE = r"[^\x20\x09-\x0D]+"
SPACE_RE = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back (lineage cut, survives lost executors)."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/custaris-llm-{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def crc_mod(id_col: str, m: int) -> Column:
    """crc32 of the id's decimal text modulo ``m``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % F.lit(m)


def words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z only) words of a text."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def slices(batches: Iterable[pa.RecordBatch], text_col: str = "text", limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each piece holds about ``limit`` bytes of text (one longer text stands alone)."""
    for b in batches:
        at = size = 0
        lengths = pc.fill_null(pc.binary_length(b.column(text_col)), 0).to_pylist()
        for i, n in enumerate(lengths):
            if size and size + n > limit:
                yield b.slice(at, i - at)
                at, size = i, 0
            size += n
        if b.num_rows > at:
            yield b.slice(at)


def thinned(df: DataFrame, h: Column, total: int, rows: int) -> DataFrame:
    """About three times ``rows`` of ``total`` rows by hash ``h``, from which a bounded sample is then taken.

    The share follows from the total, so that what a top-``rows`` step moves doesn't grow with the table.
    """
    share = 3 * rows / max(total, 1)
    return df if share >= 1 else df.where(F.pmod(h, F.lit(1 << 40)) < F.lit(int(share * (1 << 40))))


def let(value: Column, body) -> Column:
    """Bind ``value`` once as a lambda variable, so that ``body`` may use it many times."""
    return F.transform(F.array(value), body)[0]


SPREAD = 1024              # tasks' worth of parts into which the edges of one node are dealt


def with_least(edges: DataFrame, key: str, other: str) -> DataFrame:
    """``edges`` with ``m``, the least ``other`` of each ``key``.

    Edges are dealt by (key, part of the other node): a hub's edges meet in up to ``SPREAD`` groups, never in one, and
    only one row a part is joined with the hub's least neighbour.
    """
    dealt = edges.withColumn("part", F.pmod(F.xxhash64(other), F.lit(SPREAD)))
    parts = dealt.groupBy(key, "part").agg(F.min(other).alias("m"))
    least = parts.groupBy(key).agg(F.min("m").alias("m"))
    return dealt.join(parts.select(key, "part").join(least, key), [key, "part"]).select(*edges.columns, "m")


def components(edges: DataFrame, src: str = "a", dst: str = "b") -> DataFrame:
    """(node, root) for every node of ``edges``; root is the smallest node reachable.

    Alternating large-star and small-star steps on DataFrames; each step is written to the shared folder, and a
    step that changes nothing ends the loop.  Only two sums reach the driver.
    """
    e = edges.select(F.least(src, dst).alias("lo"), F.greatest(src, dst).alias("hi")).where("lo < hi").distinct()
    e = materialize(e, "cc")
    last = None
    while True:
        # large star: every larger neighbour of a node goes to the node's smallest neighbour
        both = e.select("lo", "hi").union(e.select(F.col("hi").alias("lo"), F.col("lo").alias("hi")))
        big = with_least(both, "lo", "hi").where("hi > lo").select(F.least("lo", "m").alias("lo"), "hi").where("lo < hi").distinct()
        # small star: the smaller neighbours of a node and the node itself go to the smallest of them
        j = with_least(big, "hi", "lo")
        e2 = (j.select(F.col("m").alias("lo"), "hi")
              .union(j.select(F.col("m").alias("lo"), F.col("lo").alias("hi"))).where("lo < hi").distinct())
        e = materialize(e2, "cc")
        mark = e.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first()
        if mark == last:
            break
        last = mark
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(
        e.select(F.col("lo").alias("node"), F.col("lo").alias("root"))).distinct()
