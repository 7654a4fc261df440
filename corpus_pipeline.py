"""A training corpus from raw documents: five stages, each a table that the next one reads.

Toxic documents and those in no known language go, then exact and near copies, and what is
left is packed into windows. Stages but the last return the columns of documents.

Defined results: a null text counts as empty; an empty one is not toxic, and goes in the language
stage as all texts without a letter do; other nulls do not matter, and of equal texts the row
with a doc_id and the smallest one stays, once; without labels, or without rows that have a
language, the model rejects no text as toxic or every text as of no language; empty tables give
empty results; extra columns go through all stages but the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import exact_dedup, language, near_copies, packing, toxicity
from marlstone.llm.common import settle, small_batches, table

#: SQL can express neither classifiers nor tokens; tests hold the stages against brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below toxicity.REJECT; the lexicon is learned from the labels of sf_dir."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    small_batches(spark)
    return docs.where(toxicity.scorer(model)(F.coalesce("text", F.lit(""))) < toxicity.REJECT)


def drop_unknown_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language that scores at least language.REJECT."""
    model = language.train(docs)
    small_batches(spark)
    return docs.where(language.accepted(model)(F.coalesce("text", F.lit(""))))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.deduplicate(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_unknown_languages),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
