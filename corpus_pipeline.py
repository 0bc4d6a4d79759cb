"""The training-data pipeline: language, near copies, test leaks, mixture, token files."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gleaner.llm.common import new_folder, table
from gleaner.llm.decontamination import decontaminate
from gleaner.llm.language_id import known_languages, train_languages
from gleaner.llm.mixing import mixed_documents
from gleaner.llm.simhash import without_near_copies
from gleaner.llm.token_files import token_output

#: Near copies are joined and models fitted over rows: SQL can't express that; tests hold run() against brute force.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those without a letter (null and empty texts are so) or below the calibrated limit go.

    Repeated rows stay as often as they are there; a null id or source stays null.
    """
    return known_languages(docs, train_languages(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: 0.8 of the shingles of 5 words in common, or more.

    The smallest doc_id stays, null ids last; of wholly repeated rows one. Null texts and texts without a word are copies of each other.
    """
    return without_near_copies(docs, words_in_shingle=5, similarity=0.8)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark; null and empty texts hold none. Rows alike in id and text stay or go together."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the source weights take them; those without a word go. A null source is one of its own."""
    return mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files; a row for each document in them, in the order of their ids, null ids first, then of their texts."""
    return token_output(docs, public_tokenizers.path("word_bpe_49k.json"), memo_words=300_000)  # beside what earlier stages hold


STAGES = [
    ("language", language),
    ("near_copies", near_copies),
    ("benchmark_leaks", benchmark_leaks),
    ("mixture", mixture),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    folder = new_folder(spark, "pipeline")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
