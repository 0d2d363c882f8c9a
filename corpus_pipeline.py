"""The corpus pipeline: language, near duplicates, benchmark passages, mixture, token files.

Every stage takes the documents that the one before it kept, whole, and its
decisions take effect: what it rejects is gone for those after it. A stage may
run by itself, in a session of the caller's, so each sets what it relies on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from busbar.llm import decontaminate, language_id, mixture, ngram_jaccard, token_files
from busbar.llm.common import held_out, table
from busbar.session import materialize, prepare

#: A language is accepted if it has at least this share of the probability.
LEAST_SCORE = 0.5
#: Near duplicates: words in a shingle, and similarity in per cent.
SHINGLE_WORDS, SIMILAR = 5, 80


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; texts without letters, and undecided ones, go."""
    prepare(spark)
    train = ~held_out(F.col("doc_id"), 4, 2)
    told = language_id.identify(docs, language_id.public_vocabulary(), train)
    return told.filter((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


def no_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id."""
    prepare(spark)
    return ngram_jaccard.one_of_each_group(docs, SHINGLE_WORDS, SIMILAR)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated with benchmark items."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")).filter("NOT contaminated").select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as the mixture takes them, some of them twice."""
    prepare(spark)
    return mixture.mixed_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mixture: place, number of ids and checksum of every document in them."""
    prepare(spark)
    files = token_files.write_token_files(docs, token_files.public_vocabulary())
    return token_files.read_token_files(files).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [
    ("language_id", known_language),
    ("ngram_jaccard", no_near_duplicates),
    ("decontaminate", no_benchmark),
    ("mixture", mixed),
    ("token_files", encoded),
]
#: Neither language model, nor components, nor token ids can be had from SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
