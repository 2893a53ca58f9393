"""Corpus preparation in five stages, each a function of (spark, docs, sf_dir) that returns a DataFrame.

run(spark, sf_dir) applies them to documents; each stage's result is written to the shared folder and read again as the next one's
input. All stages but the last return the columns of documents; the last one returns what op9 does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seqloom.llm import bpe, common, exact_dedup, minhash, mixing, toxicity
from seqloom.session import ship


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the string-kernel machine, trained on the labelled ones among docs, predicts to be toxic."""
    ship(spark)
    return toxicity.clean(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, keeps the one with the smallest id."""
    ship(spark)
    return exact_dedup.dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, keeps the document with the smallest id."""
    ship(spark)
    return minhash.dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents of small sources, up to one and a half times; every document is in at least once."""
    ship(spark)
    return mixing.remix(docs, max_repetition=1.5, budget=None)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of every text, and the text that they decode to, as digests; a row for each repetition."""
    ship(spark)
    return bpe.roundtrip_digest(docs, common.tokenizer_path("byte_bpe_50k.json"))


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("minhash", drop_near_copies), ("mixing", mix_sources), ("bpe", encode)]

#: SQL can express neither the trained model nor the tokenizer; tests/llm holds the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), name)
    return docs
