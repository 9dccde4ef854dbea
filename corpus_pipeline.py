"""The corpus pipeline: toxic documents, exact copies and near copies go, personal data is masked, the rest is packed.

Every stage takes all that the one before kept, with all columns whatever their names, and the last gives pieces. Null texts are empty and
stay as they are but for copies; null and repeated ids are allowed; an empty table goes through as an empty table."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from pixelloom.llm import dedup, jaccard, packing, pii, toxicity
from pixelloom.llm.common import drop_scratch, materialize, shrink_heaps
from pixelloom.llm.queries import CATEGORIES, WORD_BPE


def _begins_small(stage):
    """stage, begun when the executors have given back the heap that the one before left unused."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        shrink_heaps(spark)
        return stage(spark, docs, sf_dir)

    return run


@_begins_small
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain doesn't find toxic. The chain is fitted on a bounded sample of the labels (toxicity.SAMPLE); without
    labels of both values nothing goes. Null texts are scored as empty ones."""
    chain = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), CATEGORIES)
    return toxicity.reject(docs, chain)


@_begins_small
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of documents whose texts are equal without white space: that with the longest text, then the smallest id (null ids
    last), then the first read. Null and empty texts are one group."""
    return dedup.keep_first(docs)


@_begins_small
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of documents that share four fifths of their five-word shingles: that of the smallest id (null ids last), then of the
    smaller row key. Texts without words all stay."""
    return jaccard.keep_one(docs, size=5, num=80, den=100)


@_begins_small
def mask_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind and n_chars counted anew; null texts stay null."""
    return pii.redact(docs)


@_begins_small
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in training windows; a null text gives the token that ends it."""
    return packing.pack_documents(docs, WORD_BPE)


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("ngram_jaccard", drop_near_copies), ("pii", mask_personal), ("packing", pack)]

#: Tokenization and the classifier have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read as the next one's input, and dropped when the stage after
    it is written. Lost executors repeat work of one stage at most."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        made = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if k:
            drop_scratch(docs)
        docs = made
    return STAGES[-1][1](spark, docs, sf_dir)
