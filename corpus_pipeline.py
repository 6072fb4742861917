"""A training corpus from ``documents``: language, quality, near-duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again
as the next stage's documents. All but the last return the columns of ``documents``, whatever other columns
there are and however they are named; rows of an empty table stay none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerlake.llm import decontaminate, langid, packing, quality, simhash
from ledgerlake.llm.registry import TOKENIZER
from ledgerlake.llm.shared import table, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled rows teach; those rejected by distance go.

    Null texts and texts without a letter go. Repeated rows share their fate; ids aren't looked at but to draw the sample.
    """
    return langid.keep_known(docs)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on their own weak labels, keeps.

    Null texts and texts without a word go. Repeated rows share their fate; a score on the threshold is kept.
    """
    return quality.keep_good(docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, five-word shingles at a similarity of 0.8 or more: the smallest doc_id.

    Texts without words are duplicates of one another. Of rows that repeat that doc_id the smallest text stays; rows
    without a doc_id stay.
    """
    return simhash.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of ``benchmark``.

    Each row is judged by its own text, also where its doc_id is null or repeated. Null texts stay, items without
    words match nothing.
    """
    return decontaminate.keep_uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences that the remaining documents fill.

    A null text counts as empty and makes a piece of its end id. Rows with a null or repeated doc_id are packed like
    others; documents keep the order in which tasks read them.
    """
    return packing.pieces(docs, TOKENIZER()).drop("ids")


STAGES = [
    ("language", language),
    ("quality", good_quality),
    ("near_duplicates", distinct),
    ("decontamination", decontaminated),
    ("packing", packed),
]

#: No stage but the last can be written in SQL; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written before the next stage reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
