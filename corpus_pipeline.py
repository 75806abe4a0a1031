"""A corpus from raw documents to packed batches: the stages, each of which works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orbitframe.llm import line_dedup, mixing, ngram_join, packing, toxicity
from orbitframe.llm.common import stored, table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain, fitted on the labelled ones among docs, does not reject."""
    return toxicity.clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the lines that line dedup keeps; those that lose every line go."""
    return line_dedup.deduplicated(docs)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id of each class of linked documents."""
    return ngram_join.kept(docs)


def mix_of_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per document and epoch that the mix takes words of."""
    return mixing.mixed_documents(docs)


def packed_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per mixed document: its length bucket, batch and slot."""
    return packing.packed(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("line_dedup", without_repeated_lines),
    ("ngram_join", without_near_duplicates),
    ("mixing", mix_of_sources),
    ("packing", packed_batches),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs)
    return docs


#: A trained classifier is not to be had in SQL.
ORACLE_SQL = None
