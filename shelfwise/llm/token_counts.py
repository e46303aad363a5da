"""Operator 7: token counts through a digest cache.

The cache is a Parquet table ``(content_digest, tokenizer_digest, n_tokens)``.
A run digests every text, joins the digests to the stored counts, encodes only
the distinct contents that are missing, and appends them to the cache, so the
next run over an overlapping corpus encodes only what is new. The content is
normalised only where that cannot change a count: a null text is the empty one.

Defined results: null or empty texts have 0 bytes and 0 tokens; repeated rows
each get a row; a null ``doc_id`` stays null; an empty table gives no rows;
other columns are not read. Very long texts are encoded whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import scratch_path, sliced
from shelfwise.llm.tokens import byte_bpe, piece_counter

CACHE_SCHEMA = "content_digest binary, tokenizer_digest string, n_tokens long"


def tokenizer_digest(path: str) -> str:
    """Digest of the vocabulary file and of the library's version: counts of one never serve another."""
    if path.endswith(".model"):
        import sentencepiece as library
    else:
        import tokenizers as library
    with open(path, "rb") as f:
        content = hashlib.sha256(f.read()).hexdigest()
    return hashlib.sha256(f"{library.__name__} {library.__version__} {content}".encode()).hexdigest()


def _count_batches(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = batch.column("text").to_pylist()
            if path.endswith(".model"):
                counts = piece_counter(path).count(texts)
            else:
                counts = [len(ids) // 4 for ids in byte_bpe(path).encode(texts)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("content_digest"), pa.array(counts, pa.int64())], ["content_digest", "n_tokens"]
            )

    return run


def count_tokens(
    docs: DataFrame,
    tokenizer_path: str,
    cache_path: str | None = None,
    limit: int = 4096,
    scratch: str | None = None,
) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row of ``docs (doc_id, text)``.

    ``cache_path``: the cache table, created if missing (a new one in the
    scratch folder if not given). A run that dies before its append leaves the
    cache as it was.
    """
    spark = docs.sparkSession
    version = tokenizer_digest(tokenizer_path)
    cache_path = cache_path or scratch_path(spark, "token-cache", scratch)
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(cache_path)

    def stored() -> DataFrame:
        cache = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).filter(F.col("tokenizer_digest") == version)
        return cache.groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens"))

    text = F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(text.cast("binary"), 256))
    rows = docs.select("doc_id", text.alias("text"), digest.alias("content_digest"))
    keys = rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "content_digest")
    # One row stands for each missing content; its id finds the text again without sorting texts by digest.
    # Ids are compared as text with a stand-in for null, so any id type and null ids work.
    holder = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    missing = (
        keys.groupBy("content_digest")
        .agg(F.min(holder).alias("holder"))
        .join(stored(), "content_digest", "left_anti")
    )
    texts = rows.select(holder.alias("holder"), "text", "content_digest").join(
        missing.hint("shuffle_hash"), ["holder", "content_digest"], "left_semi"
    )
    (
        texts.select("content_digest", "text")
        .mapInArrow(_count_batches(tokenizer_path), "content_digest binary, n_tokens long")
        .select("content_digest", F.lit(version).alias("tokenizer_digest"), "n_tokens")
        .write.mode("append").parquet(cache_path)
    )
    return keys.join(stored(), "content_digest", "left").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
