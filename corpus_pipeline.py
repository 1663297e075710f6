"""Corpus pipeline: toxic and bad documents go, one of each group of near duplicates stays, personal data is taken out,
and what is left is packed into training sequences.

Each stage is a function of the session, its predecessor's rows and the folder of the tables; its rows are written to the
shared folder and read again.  Every stage takes nulls in any column and further columns, and gives no rows for none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lathe.llm import neardup, packing, pii, quality, toxicity
from lathe.llm.batches import read_table
from lathe.llm.shared import written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold; the network learns from the labelled documents of ``sf_dir``.

    A row's verdict follows its text alone, a null being as an empty text, so equal rows stay or go together.
    """
    net = toxicity.train(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, net)


def drop_bad(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep: null and empty texts have too few words and go; equal rows go together."""
    return quality.keep_good(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates; repeated rows are one, null and empty texts all stay."""
    return neardup.keep_one(docs)


def take_out_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, repeated ones too, their personal data replaced by its kind; null texts stay null."""
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences; null and empty texts are an end id each, repeated rows documents of their own."""
    return packing.digest(packing.pack(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", drop_bad),
    ("near duplicates", drop_near_duplicates),
    ("personal data", take_out_personal),
    ("packing", pack),
]

#: Trained networks and tokenisers are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
