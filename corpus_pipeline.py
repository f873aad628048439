"""Corpus pipeline: quality rules, near-dedup, redaction, mixing to target weights, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; written as Parquet, it is the next stage's docs.  All
but the last return the columns of ``documents``.  A stage's statistics (thresholds, groups, candidate models, targets)
are those of the documents it is given.

Defined results follow the operators': null texts fail the quality rules, null ids pass near-dedup, repeated rows of an
id count as one document there, copies made by the mix stay separate rows, an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from custaris.llm import mixing, neardup, pieces, pii, quality
from custaris.llm.common import documents, materialize


NEAR_PERCENT = 80          # least similarity of near copies in the corpus; op1's own contract is 85


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the adaptive thresholds keep."""
    return quality.filter_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the smallest id, of each component of near copies (word shingles, Jaccard 0.8 or more)."""
    return neardup.deduplicate(docs, percent=NEAR_PERCENT)


def redact_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by a mark of its kind; n_chars follows the text."""
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.char_length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it."""
    return mixing.emit(mixing.mix(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Columns of documents with ``piece_ids`` and ``piece_text`` (the decoded text)."""
    return pieces.encode_decode(docs, pieces.default_model())


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("redact_personal", redact_personal),
          ("mix_sources", mix_sources), ("tokens", tokens)]

#: no SQL twin: candidate models and subword merges aren't SQL; tests compare with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written in the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
