"""From raw documents to packed training sequences, in stages.

Each stage takes the documents that its predecessor kept, as a written table,
and applies one operator of ``shelfwise.llm`` to all of them. All stages but the
last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from shelfwise.llm import mixing, ngram_join, packing, pii, toxicity
from shelfwise.llm.common import keep
from shelfwise.llm.queries import on_workers

# The stages' results depend on trained models and a tokenizer, which SQL cannot express.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    on_workers(spark)
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five-word n-grams, Jaccard index 0.8 or more."""
    on_workers(spark)
    return ngram_join.drop_near_duplicates(docs, words=5, threshold=(80, 100))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and credentials are replaced by their kind."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are repeated to weights of their size to the power 0.5, in a global pseudo-random order."""
    return mixing.mix(docs, by="source", alpha=0.5, seed=17)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences of 2048 tokens."""
    on_workers(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=2048, separator=0)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared scratch folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
