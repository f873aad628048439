"""Mixing sources to target weights by systematic sampling (DataFrame only).

Every document of a source has the same expected number of copies, ``target / source size`` (at most 3).  Along a
fixed order of the source's documents the prefix sum of expected copies is ``rank * rate``; with one offset ``u`` of
the source, a document is emitted once for each integer boundary in ``(rank-1)*rate+u .. rank*rate+u``.

The order is (size class, md5 of the id): size classes (eight to an octave) keep the taken words close to the target.
Ranks never need a window over a whole source: documents are counted by (source, size class, first md5 byte), the
prefix sum runs over those counts (at most ~130,000 a source), and row numbers are local to such a cell.

Defined results: null or empty text has size 0; null source is a source of its own (last); null ids sort as the empty
text; equal rows are separate documents; an empty table gives no rows; other columns pass through :func:`mix`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.joins import bounded_broadcast
from .common import WORD_RE

WEIGHTS = (5, 2, 1)      # repeating, by code point of the source name
MAX_REPEAT = 3           # no document is taken more often
SEED = "custaris-mix"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RE)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target, rate, u) from (source, size); one row a source.

    Shares of the whole by weight, each at most 3 source sizes, the excess reshared by weight: the water level L
    with ``target = least(3*size, L*weight)``.  With sources ordered by size/weight, L is the largest of
    ``(total - capped before) / (weight from here on)``.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(x) for x in WEIGHTS]),
                     ((F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1).cast("int"))
    per = per.withColumn("weight", w)
    fill = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    level = ((F.sum("source_size").over(Window.partitionBy())
              - F.coalesce(F.sum("source_size").over(before), F.lit(0)) * MAX_REPEAT).cast("double")
             / F.sum("weight").over(after))
    per = per.withColumn("level", level).withColumn("level", F.max("level").over(Window.partitionBy()))
    per = per.withColumn("target", F.least((F.col("source_size") * MAX_REPEAT).cast("double"),
                                           F.col("level") * F.col("weight")))
    name = F.coalesce(F.concat(F.lit("s:"), F.col("source")), F.lit("n"))
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(SEED), name)), 1, 3), 16, 10).cast("double") + F.lit(0.5)) / F.lit(4096.0)
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(MAX_REPEAT))))
    return per.select("source", "source_size", "target", F.coalesce(rate, F.lit(0.0)).alias("rate"), u.alias("u"))


def mix(docs: DataFrame, sizes: DataFrame | None = None, id_col: str = "doc_id", source_col: str = "source",
        text_col: str = "text", size_col: str | None = None) -> DataFrame:
    """``docs`` with ``mix_size, mix_source_size, mix_target, mix_copies`` (columns of those names are replaced).

    ``sizes`` may give (source, size) already reduced from the same rows; ``size_col`` names a ready size column.
    """
    docs = docs.drop("mix_size", "mix_source_size", "mix_target", "mix_copies")
    size = F.col(size_col) if size_col else n_words(F.col(text_col))
    key = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    d = docs.withColumn("__mx_size", size).withColumn("__mx_key", key)
    octave = F.length(F.bin("__mx_size"))
    cls = octave * 8 + F.expr("cast(shiftright(__mx_size, greatest(length(bin(__mx_size)) - 4, 0)) as int) % 8")
    d = d.withColumn("__mx_class", cls).withColumn("__mx_sub", F.substring("__mx_key", 1, 2))
    d = d.withColumn("__mx_src", F.col(source_col))
    # one key without nulls, so that the count join and the row numbers share one shuffle of the documents
    name = F.coalesce(F.concat(F.lit("s:"), F.col("__mx_src")), F.lit("n"))
    d = d.withColumn("__mx_cell", F.concat_ws("|", F.col("__mx_class").cast("string"), "__mx_sub", name))
    cells = d.groupBy("__mx_cell", "__mx_src", "__mx_class", "__mx_sub").agg(
        F.count("*").alias("__mx_n"), F.sum("__mx_size").alias("__mx_s"))
    targets = source_targets(sizes if sizes is not None else
                             cells.select(F.col("__mx_src").alias("source"), F.col("__mx_s").alias("size")))
    run = Window.partitionBy("__mx_src").orderBy("__mx_class", "__mx_sub").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("__mx_off", F.coalesce(F.sum("__mx_n").over(run), F.lit(0)))
    t = targets.select(*[F.col(c).alias(f"__mt_{c}") for c in targets.columns])
    cells = cells.join(bounded_broadcast(t, 100_000), F.col("__mx_src").eqNullSafe(F.col("__mt_source")))
    cells = cells.select("__mx_cell", "__mx_off", "__mt_source_size", "__mt_target", "__mt_rate", "__mt_u")
    local = Window.partitionBy("__mx_cell").orderBy("__mx_key", F.col(id_col), "__mx_size")
    d = d.withColumn("__mx_row", F.row_number().over(local)).join(cells, "__mx_cell")
    rank = F.col("__mx_off") + F.col("__mx_row")
    copies = (F.floor(rank * F.col("__mt_rate") + F.col("__mt_u"))
              - F.floor((rank - 1) * F.col("__mt_rate") + F.col("__mt_u")))
    return d.select(*[F.col(f"`{c}`") for c in docs.columns], F.col("__mx_size").alias("mix_size"),
                    F.col("__mt_source_size").alias("mix_source_size"), F.col("__mt_target").alias("mix_target"),
                    copies.cast("long").alias("mix_copies"))


def emit(mixed: DataFrame) -> DataFrame:
    """One row for each copy; the ``mix_*`` columns go."""
    out = mixed.where("mix_copies > 0").withColumn("__mx_c", F.explode(F.sequence(F.lit(1), F.col("mix_copies").cast("int"))))
    return out.drop("__mx_c", "mix_size", "mix_source_size", "mix_target", "mix_copies")


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    """All ``documents`` with the words the mix takes of each."""
    from .common import documents, materialize
    d = documents(spark, sf_dir)
    d = materialize(d.select("doc_id", "source", n_words(F.col("text")).alias("size")), "mix")
    out = mix(d, size_col="size")
    return out.select("doc_id", "size", F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"),
                      (F.col("mix_copies") * F.col("size")).alias("taken"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k FROM documents),
per AS (
  SELECT *, [5, 2, 1][CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS INT)] AS weight
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source)),
lev AS (
  SELECT *, max(l) OVER () AS level FROM (
    SELECT *, CAST(sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (
        ORDER BY source_size / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
      / sum(weight) OVER (ORDER BY source_size / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS l
    FROM per)),
tg AS (
  SELECT source, source_size, target, u, CASE WHEN source_size > 0 THEN least(target / source_size, 3.0::DOUBLE) ELSE 0 END AS rate
  FROM (SELECT source, source_size, least(CAST(3 * source_size AS DOUBLE), level * weight) AS target,
    (CAST('0x' || substr(md5('custaris-mix' || coalesce('s:' || source, 'n')), 1, 3) AS INTEGER)::DOUBLE + 0.5::DOUBLE) / 4096.0::DOUBLE AS u
    FROM lev)),
r AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY length(bin(size)) * 8
      + (size >> CAST(greatest(length(bin(size)) - 4, 0) AS BIGINT)) % 8, k, doc_id, size) AS rk FROM d)
SELECT r.doc_id, r.size, tg.source_size, tg.target,
       CAST(floor(rk * rate + u) - floor((rk - 1) * rate + u) AS BIGINT) * r.size AS taken
FROM r JOIN tg ON r.source IS NOT DISTINCT FROM tg.source
"""
