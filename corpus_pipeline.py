"""A training corpus from raw documents: language ID, near-dedup, redaction of personal data, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.llm import language_id, mixing, near_dedup, packing, pii
from sessionloom.llm._shared import cut, table


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with an identified language; those without a letter, so without one, go, null and empty texts among them. A null lang is filled in.

    Repeated rows and null ids fare as their texts do; an empty table gives an empty result. Where no language can be learned from the rows, the
    documents with a letter stay as they are. Ties between languages keep the document.
    """
    models = language_id.train(docs)
    if not models:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = language_id.identify(docs, models).where(F.col("lang_pred") != "und")
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near-duplicates (five words, similarity 0.8).

    Null, empty and wordless texts are like no other and stay; of repeated rows one stays; a null id counts as the largest. An empty table
    gives an empty result.
    """
    return near_dedup.dedup(docs, words=5, percent=80)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its type; null and empty texts, repeated rows and null ids stay as they are."""
    return pii.redact(docs, pii.train(docs))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; at most one copy a source is cut, at the source's exact budget.

    A null source is a source of its own; null, empty and wordless texts have no words to take and go; repeated rows and null ids
    count each for itself. An empty table gives an empty result.
    """
    return mixing.mixed_copies(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of tokenized documents with their sequence and offset; a null or empty text is one piece of one id, an empty table has none."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language_stage),
    ("near_dedup", dedup_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Trained models and a tokenizer decide; SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written to the shared folder before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs
