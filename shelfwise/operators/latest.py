"""Latest record per key (``ROW_NUMBER() OVER (PARTITION BY k ORDER BY d DESC) = 1``)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def day_order(day: str = "Date", key: str = "Date_SK") -> Column:
    """One ``bigint`` that orders rows by calendar day, then by the day's surrogate key.

    ``unix_date(day) * 2^32 + (key + 2^31)``: the key (an int) fills the low 32
    bits, so the order is exactly (day, key).
    """
    return F.unix_date(F.col(day)).cast("long") * F.lit(1 << 32) + (F.col(key).cast("long") + F.lit(1 << 31))


def latest_per_key(
    df: DataFrame,
    keys: Sequence[str],
    order: Column,
    values: Sequence[str],
) -> DataFrame:
    """For each ``keys`` group, the ``values`` of the row with the greatest ``order``.

    Written as ``max_by`` aggregates rather than a ranking window: with a
    fixed-width ``order`` (e.g. :func:`day_order`) and fixed-width values the
    aggregation is hash-based and combined map-side, so a key with a huge
    number of rows is reduced to one candidate per task before the shuffle and
    nothing is sorted. ``order`` must identify one row per key (the fact's
    grain is unique), so every value comes from that same row.
    """
    return df.groupBy(*keys).agg(*[F.max_by(F.col(v), order).alias(v) for v in values])


def latest_per_key_ranked(
    df: DataFrame,
    keys: Sequence[str],
    order: Column,
    values: Sequence[str],
) -> DataFrame:
    """Same result through ``row_number()``; kept to check the aggregate form in tests."""
    w = Window.partitionBy(*keys).orderBy(order.desc())
    return (
        df.withColumn("_rn", F.row_number().over(w))
        .filter(F.col("_rn") == 1)
        .select(*keys, *values)
    )
