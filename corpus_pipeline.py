"""The corpus pipeline: stages over the documents, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cardlake.llm import exact_dedup, mixing, near_dups, sentence_pieces, toxicity
from cardlake.llm.common import stored, table


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones, does not reject."""
    return toxicity.harmless(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of equal texts, that with the smallest id."""
    return exact_dedup.deduplicated(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near duplicates: five-word shingles, similarity of 0.8 or more."""
    return near_dups.deduplicated(docs, width=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, those of small sources up to twice, at the weights of the mixture."""
    return mixing.mixed(docs, ratio=None, repetitions=2.0)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' ids, and the text that they stand for."""
    # Stored between, so that a task needs one Python worker at a time, not two.
    return sentence_pieces.decode(stored(sentence_pieces.encode(docs), "pieces"))


STAGES = [
    ("toxicity", toxic),
    ("exact dedup", exact),
    ("near dedup", near),
    ("mixing", mix),
    ("sentencepiece", pieces),
]
# A classifier and a tokenizer have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
