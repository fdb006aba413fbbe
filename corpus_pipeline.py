"""The corpus pipeline: documents through five operators, in order.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir),
works on all rows that its predecessor kept, and returns a DataFrame with the
columns of documents, but for the last, which returns packed pieces.  ``run``
writes each stage's rows as Parquet and reads them for the next one.

Defined results of all stages: null text counts as empty; rows that repeat are
rows of their own until exact dedup; null ids are kept like others; an empty
table gives no rows; columns besides doc_id, text and source pass through as
they are, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumasift.llm import exact_dedup, mixing, ngram_join, packing, toxicity
from lumasift.llm.common import saved, table
from lumasift.session import ship


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labelled ones among them, rejects go.

    Empty texts score what the classes' shares give and stay; without labels of
    both classes nothing goes; ids that repeat are judged each by its text.
    """
    ship(spark)
    return toxicity.clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays (null ids are smallest; of rows that repeat an id one stays)."""
    ship(spark)
    return exact_dedup.survivors(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are linked the one with the smallest id stays, and all texts without words.

    Null ids are largest; of rows that repeat id and text one stays.
    """
    ship(spark)
    return ngram_join.representatives(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, at most twice; texts without words stay out."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, each with its place in a sequence; an empty text is the end id alone, ties go by row."""
    ship(spark)
    return packing.pack(packing.pieces(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing to target weights", mix_sources),
    ("best-fit packing", pack),
]

#: A learned classifier and hash-drawn copies: SQL can't express these stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; its labels teach the first."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
