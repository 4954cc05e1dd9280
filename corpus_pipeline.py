"""The corpus pipeline: documents of low quality go, then exact copies, then all
but one of each group of near copies; what is left is mixed by source to target
weights and encoded.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows its
predecessor kept; all but the last return the columns of ``documents``.  The
mixing stage keeps every row and decides the order: its files, by name, and the
rows in a file follow the mixture, and the encoding stage reads each row's
position from there.

In every stage: null text counts as empty, long texts are read whole, further
columns of any name pass through, and an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from koine.llm import bpe, exact_dedup, jaccard_join, mixing, quality
from koine.llm.tables import table
from koine.sources.scratch import written

#: Target weight of each source; None: tempered weights of their row counts.
WEIGHTS: dict[str | None, float] | None = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the Bradley-Terry classifier rejects: repeated rows
    together, rows without id by their text like any other; a score of exactly
    the threshold stays, and without labels of both classes all do."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group of equal texts: one row, also of rows
    that repeat both id and text, or have no id.  Null and empty texts are one group."""
    return exact_dedup.drop_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group of near copies.  Rows without id, text
    or words are in no group and stay; rows of one id stay or go together."""
    return jaccard_join.drop_near_copies(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the documents into the order of the mixture; a null source is one of
    its own, ties in a source go by id, repeated rows follow one another."""
    return mixing.in_order(docs, WEIGHTS)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with their digests and its position in the
    mixture: a row per row, null ids stay null, null text has no tokens."""
    return bpe.tokenize(mixing.with_position(docs, ["doc_id", "text"]), with_ids=True, keep=("position",))


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("mixing", mixing_stage),
    ("encoding", encoding_stage),
]

#: The classifier and the encoder cannot be written in SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is a table before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
