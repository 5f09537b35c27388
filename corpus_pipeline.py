"""A training corpus from `documents`, in five stages.

Each stage takes the rows that the one before it kept and returns the columns of
documents, but for the last, which returns packed pieces.  Stages share executors, so each
sets the session's bound on what a Python worker gets at once (`common.short_batches`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyvault.llm import language, mixing, near, packing, pii
from tallyvault.llm.common import settle, short_batches, table


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents in a language that the labels of `documents` teach.

    Null texts and texts without a letter are in no language and go; repeated rows are judged
    alike; without labels all texts with a letter stay.
    """
    short_batches(spark)
    return language.accepted(docs, language.fit(docs))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates.

    Rows without an id or without words stay, as do all that differ; of repeated rows one stays.
    """
    short_batches(spark)
    return near.deduplicated(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask personal data in every text; all documents stay, null and empty texts as they are."""
    short_batches(spark)
    return pii.mask(docs)


def to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat documents, or leave them out, as the sources' weights have it, in block permutations; the budget is the tokens that came in.

    A null source is one source.  Repeated rows are in the mix each by itself.
    """
    short_batches(spark)
    return mixing.resampled(docs)


def into_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents' tokens into sequences; null and empty texts are the end token alone, repeated rows are packed each."""
    short_batches(spark)
    return packing.packed(docs)


STAGES = [
    ("language", known_language),
    ("near_duplicates", one_of_each),
    ("personal_data", without_personal_data),
    ("mixing", to_weights),
    ("packing", into_sequences),
]

#: Language identification, deobfuscation and tokens are not within reach of SQL; tests/llm/test_table_operators.py checks the stages: rejection, near duplicates, masks and the mix by brute force, packing by its pieces.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each from what the one before it wrote."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = settle(docs)
    return docs
