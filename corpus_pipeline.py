"""A corpus pipeline over `documents`: quality rules, near-dedup, substring dedup, mixing, tokens.

Each stage works on all that its predecessor kept, which run() writes to the shared folder and reads again. All stages
but the last keep the columns of documents and any others, whatever their names; an empty table stays one; repeated rows
are rows of their own; texts of any length are taken whole."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from clonal_spark.llm import bpe, column_bwt, minhash, mixing, repetition
from clonal_spark.session import Scratch, ship_package


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules keep. A null or empty text has no word and goes; ids take no part."""
    ship_package(spark)
    return repetition.apply(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the least doc_id. Rows with that doc_id all stay, as do
    null ids and texts without a word."""
    return minhash.apply(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes that repeated strings of 200 bytes cover, so that passages of over 50 words go; n_chars
    follows the text. A null text stays null; repeated rows lose what they share, as any two documents do."""
    return column_bwt.apply(docs, n_chars_col="n_chars", length=column_bwt.PASSAGE)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources ask for. A null source is a source of its own; a text
    without a word has size 0 and is not taken."""
    return mixing.apply(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of each document's ids and of their decoded bytes; a null text is an empty one."""
    return bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("mixing", mix), ("bpe", tokens)]

#: SQL has no form of the near-dedup, substring and encoding stages; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), f"{k}-{name}")
        if k:
            scratch.drop(f"{k - 1}-{STAGES[k - 1][0]}")
    return docs
