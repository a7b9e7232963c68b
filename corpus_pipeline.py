"""From raw documents to packed token windows, as five stages.

Each stage takes what its predecessor kept, written as Parquet and read again,
so lineage ends between stages and a lost executor repeats one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from citewell.llm import exact_dedup, language_id, ngram_join, packing, quality_model
from citewell.llm.common import table, written


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model accepts; it learns from the labelled rows among them."""
    return language_id.keep_identified(docs, language_id.fit_or_unknown(language_id.learnable(docs)))


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label scorer accepts."""
    return quality_model.keep_good(docs, quality_model.fit(docs))


def different(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first of each group of equal texts."""
    return exact_dedup.keep_first_copies(docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return ngram_join.keep_one_per_class(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents left, packed into windows of 1024 ids."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", identified),
    ("quality_classifier", good),
    ("exact_dedup", different),
    ("near_duplicates", distinct),
    ("packing", packed),
]

#: Training, MinHash and byte-pair encoding have no SQL form; tests hold the result against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; the last stage's rows."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
