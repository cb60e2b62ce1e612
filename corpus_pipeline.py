"""The corpus pipeline: toxicity, exact and near deduplication, mixing and packing.

Each stage takes its predecessor's documents and decides on all of them; all but the
last return documents with all their columns, of whatever names. Between stages the
documents are written to the shared folder and read again. Null texts count as empty,
and an empty table passes through all stages as one. Rows are told apart by their
place in the table, so repeated rows are decided on one by one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import exact, mixing, neardup, packing, toxicity
from millrace.llm.common import new_path, read, scratch
from millrace.llm.queries import word_tokenizer

#: Word-shingle similarity in percent from which the stage takes documents for copies.
NEAR = 80


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain trained on the labels does not reject.

    Null and empty texts have no features and stay. Repeated rows get the same decision.
    Without labels of both kinds all documents stay.
    """
    return toxicity.drop_toxic(docs, read(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of texts that are equal but for white space.

    Null and empty texts are one group. Of repeated rows one stays. A null id stays only
    where its group has no other.
    """
    return exact.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of near copies.

    Documents without words have no copies and stay. Of repeated rows one stays.
    """
    return neardup.drop_near_copies(docs, NEAR)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks for.

    Null sources are a source of their own. Documents without words add nothing to a
    target and come with whole passes over their source only.
    """
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence.

    A text without tokens is one piece that holds the end id. Repeated rows, as the mix
    makes them, are packed once each.
    """
    return packing.pack(docs, word_tokenizer())


STAGES = [
    ("toxicity", reject_toxic),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mix", mix_sources),
    ("pack", pack_sequences),
]

#: A trained classifier and a knapsack are not for SQL; tests hold the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; what a stage but the last leaves behind is deleted at its end."""
    docs = read(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        path = new_path(spark, name)
        with scratch(spark):
            step(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
