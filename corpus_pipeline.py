"""From raw documents to encoded training text: five operators, each written as Parquet and read again by the next.

1. quality: the convolutional network drops documents it scores below its threshold;
2. near_duplicates: one document of each group whose five-word shingles are alike (Jaccard 0.8) stays, the one with the
   smallest id;
3. pii: personal data is replaced by marks of its kind;
4. mixing: sources are repeated towards their target weights, copies are shuffled globally;
5. encoding: texts become piece ids with N-best alternatives.

The first four return the columns of documents.  Null, empty and very long texts pass through every stage (an empty text
is scored like any other); an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sofralytics.llm import mixing, near_copies, pii, quality_cnn, sentencepiece
from sofralytics.llm.common import documents, saved, small_batches
from sofralytics.llm.queries import PIECES


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose score reaches the threshold; learnt from the labels of documents that are not held out."""
    small_batches(spark)
    return quality_cnn.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return near_copies.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with personal data replaced."""
    return pii.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated towards shares in proportion to the square root of their source's characters."""
    return mixing.mix(docs).select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids in place of the text."""
    small_batches(spark)
    return sentencepiece.encode(docs, sentencepiece.Vocabulary.load(PIECES))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("pii", personal_data), ("mixing", mixed), ("encoding", encoded)]

# The network and the segmentation have no SQL form; tests compare the stages with brute force on a small fixture.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
