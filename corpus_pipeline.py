"""The corpus pipeline: toxicity, exact dedup, near duplicates, repeated passages, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows its predecessor kept; every result is
written as Parquet and read again as the next stage's ``docs``. All but the last return the columns of
``documents``. Nulls, empty texts, repeated rows and empty tables are as the operators define them: a null
text counts as empty; rows without an id and rows that share an id are rows of their own, of which only
copies go; of texts without words, equal ones are copies, others aren't.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from arbiter.llm import exact_dedup, ngram_join, packing, suffix_dedup, toxicity
from arbiter.llm.common import Workspace, close, opened


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it is fitted on the labelled training rows."""
    return toxicity.reject(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the smallest id stays."""
    return exact_dedup.kept_documents(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near duplicates, the document with the smallest id stays."""
    return ngram_join.kept_documents(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of over 50 words that also stand elsewhere go; a text may end up empty."""
    return suffix_dedup.cleaned_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces, placed in sequences of at most 2048 tokens."""
    return packing.pack_documents(docs)


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_copies), ("n-gram Jaccard join", drop_near_copies), ("suffix-array dedup", cut_repeats), ("best-fit packing", pack)]

#: The classifier, the byte-wise removal and the packing have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, work, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), Workspace(spark, "pipeline"), None
    for _, stage in STAGES[:-1]:
        mark = opened()
        docs = work.save(stage(spark, docs, sf_dir))
        close(mark)  # the stage's own tables, and what it has read
        if before is not None:
            work.drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
