"""A training-corpus pipeline of five operators; each stage works on all that the one before it kept.

1. language: documents whose language cannot be told (no letter, or a calibrated confidence too low) go;
2. near duplicates: of each group of documents with a 5-word-shingle similarity of 0.8 or more the first stays;
3. personal data: spans are masked by their kind, n_chars follows the text;
4. mixture: documents are repeated or left out so that the sources' words come to their targets;
5. pieces: each document with its SentencePiece ids.

Stages 1 to 4 return the columns of documents, stage 5 adds ids and n_tokens. A stage accepts null texts, ids and
sources, repeated rows and an empty table, as its operator's module says.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saffron.llm import langid, mixing, neardup, pieces, pii
from saffron.llm._spark import ship
from saffron.llm.queries import piece_model

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return langid.accepted(docs, langid.learn(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return neardup.first_of_each(docs, words=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return pii.mask(docs).withColumn("n_chars", F.length("text").cast("long"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return mixing.mixed(docs)


def sentence_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return pieces.with_ids(docs, piece_model()).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES: list[tuple[str, Stage]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixture", mixture),
    ("sentence_pieces", sentence_pieces),
]

#: The stages learn a model and read a tokenizer's file, which SQL cannot express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
