"""Corpus pipeline: quality classifier, quality rules, SimHash near-dedup, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codeweave.llm import mixing, nearcopies, ordinal, packing, perplexity
from codeweave.llm._util import durable, table


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose grade is more likely than not the highest."""
    labels = ordinal.graded(table(spark, sf_dir, "labels"))
    return ordinal.keep_good(docs, ordinal.fit(docs, labels))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rule counts, of which only texts of fewer than 5 words are too short here, and lie in their language's band of perplexity.

    Rows are carried through the measuring, so that null and repeated ids are judged row by row and texts aren't shuffled.
    """
    return perplexity.keep_good(docs, min_words=5)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: five-word shingles with a Jaccard similarity of 0.8 or more.

    The row with the smallest id stays, nulls last; rows that are equal in every column are copies like any others.
    """
    return nearcopies.unique_documents(docs, size=5)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.emit(docs, weights=(3, 1, 2), budget=1.5, most=2.0)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in bins of 512 to 4096 words."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", classify),
    ("quality rules", rules),
    ("SimHash near-dedup", near_dedup),
    ("source mixing", mix),
    ("best-fit packing", pack),
]

#: No SQL says what these stages do; tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = durable(docs)
    return docs
