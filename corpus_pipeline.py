"""Corpus pipeline: five stages from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept, written as Parquet and
read again. All but the last return rows of documents with all their columns. A stage's result is computed when it is
written, so a stage leaves the session with small Arrow batches: by default a whole task's texts travel as one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm.common import bound_arrow_rows, ensure_checkpoint_dir, read_table
from palimpsest.llm.decontam import keep_clean
from palimpsest.llm.exactdedup import keep_last_copies
from palimpsest.llm.langid import keep_identified
from palimpsest.llm.packing import pack
from palimpsest.llm.shingles import BATCH_ROWS, keep_one_of_each


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; dictionaries come from the labelled documents among them."""
    bound_arrow_rows(spark, BATCH_ROWS)
    return keep_identified(docs, docs.select("doc_id", "text", "lang"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id."""
    bound_arrow_rows(spark, BATCH_ROWS)
    return keep_last_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, by fingerprints and by verified five-word shingles, the least doc_id."""
    bound_arrow_rows(spark, BATCH_ROWS)
    return keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, re-parameterised ones included."""
    bound_arrow_rows(spark, BATCH_ROWS)
    return keep_clean(docs, read_table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences along a space-filling curve."""
    bound_arrow_rows(spark, BATCH_ROWS)
    return pack(docs)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Tokens, compression and templates are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result but the last goes through Parquet in the shared folder."""
    ensure_checkpoint_dir(spark)
    shared = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = f"{shared}/pipeline-{uuid.uuid4().hex}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
