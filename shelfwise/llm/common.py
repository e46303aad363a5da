"""Helpers shared by the operators: written tables and size-checked broadcasts."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.session import scratch_root

BROADCAST_ROWS = 10_000  # rows of at most a few hundred bytes: a few MB at most


def scratch_path(spark: SparkSession, name: str, scratch: str | None = None) -> str:
    """A fresh folder in the session's shared scratch location."""
    return f"{scratch_root(spark, scratch)}/shelfwise-llm/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str, scratch: str | None = None) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back.

    This cuts the lineage: whatever is built on the result survives lost
    executors by reading files again, and the work is done once however often
    the result is used.
    """
    path = scratch_path(df.sparkSession, name, scratch)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, else as it is.

    Without the hint Spark joins by shuffling, and adaptive execution splits
    the hot keys. ``df`` should be cheap to count (a written table).
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in slices: what Python makes of a text is many times its size, so few are opened at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
