"""From raw documents to packed training sequences.

Five stages, each of which works on all that the one before has kept: quality rules, toxicity, fuzzy line deduplication,
near-duplicate documents, best-fit packing. All but the last return the columns of ``documents``; the last returns a row for
each packed piece. Between stages the rows are written to the shared folder as Parquet and read again.

Line deduplication comes before near duplicates, so copies lose the lines that they share with an earlier document first. A copy of
which nothing is left goes there; the rest of one (lines of its own) stays as a document with just these lines, however
short, since they stand nowhere else. Near-duplicate removal then finds copies whose text is broken into lines in another way.

Defined results: null and empty texts fall to the quality rules; a document that line deduplication leaves without any text
goes, as each of its lines stands elsewhere; rows that repeat an id are judged one by one, and of wholly equal rows one
stays; an empty table gives an empty result; columns beyond those of ``documents`` are kept until packing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import line_dedup, ngram_join, packing, quality_rules, toxicity
from quern.llm.tables import parquet, stage

#: SQL can't express the learnt and the approximate stages; tests compare them with brute force.
ORACLE_SQL = None


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that every quality rule keeps."""
    return quality_rules.filter_documents(docs)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5; the model learns from this stage's own labelled documents."""
    return toxicity.filter_documents(docs, *toxicity.model(spark, docs, sf_dir))


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat an earlier one, exactly or nearly; n_chars follows the text."""
    removed = f"_{uuid.uuid4().hex}"
    out = line_dedup.clean(docs, count_col=removed)
    out = out.where(F.col("text").isNotNull() | (F.col(removed) == 0))
    if "n_chars" in docs.columns:
        size = F.char_length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.col(removed) > 0, size).otherwise(F.col("n_chars")))
    return out.drop(removed)


def duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return ngram_join.deduplicate(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", rules_stage),
    ("toxicity", toxicity_stage),
    ("line dedup", lines_stage),
    ("near duplicates", duplicates_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``."""
    docs = parquet(spark, sf_dir, "documents")
    for name, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
