"""Registered queries of the training-data operators, each over its whole table.

A query is a thin call of its operator with production parameters; results
that are digests (checksums, ids) are derived from the operator's output.
"""

from __future__ import annotations

import os
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm import (
    bpe,
    collocations,
    embedding_dedup,
    mixing,
    ngram_join,
    packing,
    pii,
    records,
    token_counts,
    topk,
    toxicity,
    url_reputation,
    whitening,
)
from shelfwise.llm.oracles import ORACLES  # noqa: F401 (registered beside the queries)

Query = Callable[[SparkSession, str], DataFrame]

# The rules of the URL query.
URL_RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


# Memory settings of Python workers, unless the session has its own: freed memory goes back to the system at once.
WORKER_MEMORY = {
    "ARROW_DEFAULT_MEMORY_POOL": "system",
    "MALLOC_ARENA_MAX": "2",
    "MALLOC_MMAP_THRESHOLD_": "1048576",
    "MALLOC_TRIM_THRESHOLD_": "1048576",
}
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"  # rows are of any width, so a batch is bounded by bytes too
BATCH_BYTES = 16 << 20


def on_workers(spark: SparkSession) -> None:
    """Prepare the session for Python workers.

    They can import this package from where the driver has it, if it is not
    installed for them, and batches of wide rows do not fill their memory.
    """
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if _ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([_ROOT, *filter(None, paths)])
    for name, value in WORKER_MEMORY.items():
        environment.setdefault(name, value)
    given = spark.conf.get(BATCH, None)
    if given is None or not given.isdigit() or int(given) > BATCH_BYTES:
        spark.conf.set(BATCH, BATCH_BYTES)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    on_workers(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, k=5, scale=256)


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(_table(spark, sf_dir, "documents"), words=3, threshold=(90, 100))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack(_table(spark, sf_dir, "documents"), path, capacity=2048, separator=0)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    return mixing.mix(docs, by="source", alpha=0.5, seed=17, copy_column="copy")


def op5_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return records.read_digests(records.write_records(_table(spark, sf_dir, "documents"), path, end_id=2))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), path, limit=4096)


def op8_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_reputation.judge(_table(spark, sf_dir, "pages"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"), cosine=0.95)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(_table(spark, sf_dir, "documents"))


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    decoded = bpe.decode(bpe.encode(_table(spark, sf_dir, "documents"), path), path)
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    white = whitening.whiten(_table(spark, sf_dir, "embeddings"), scale=256, components=4)
    return white.select(
        F.col("id").alias("vec_id"), "component", "n", F.expr("try_cast(deviation AS long)").alias("deviation"),
        "whitened", "explained", "identity_error",
    )


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"), least=100, top=2000)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_top_k,
        op2_ngram_jaccard,
        op3_packing,
        op4_mixing,
        op5_records,
        op6_toxicity,
        op7_token_counts,
        op8_url_reputation,
        op9_embedding_dedup,
        op10_pii,
        op11_bpe,
        op12_whitening,
        op13_collocations,
        pipeline,
    )
}
