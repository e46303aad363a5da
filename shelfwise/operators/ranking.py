"""Global ranking and running totals without an unbounded single-partition window.

``SUM(x) OVER (ORDER BY x DESC)`` and ``ROW_NUMBER() OVER (ORDER BY x DESC)``
without ``PARTITION BY`` make Spark move every row into one task. Here the rows
are range-partitioned on the sort order, each partition computes local row
numbers and running sums, and a few totals per partition (one row each) give the
offsets that turn them into global values. A value may span partitions: what the
later ones hold of it is carried back to the earlier ones, one number a partition,
so no row is ever joined or grouped by its value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.session import scratch_root


def cumulative_share(
    df: DataFrame,
    value: str,
    tie_breaker: str,
    rank_col: str = "rank",
    count_col: str = "total_count",
    total_col: str = "grand_total",
    running_col: str = "running_total",
    partitions: int | None = None,
) -> DataFrame:
    """Add ranking columns over the order ``value DESC, tie_breaker ASC``.

    * ``rank_col``    ``ROW_NUMBER() OVER (ORDER BY value DESC)`` (ties by ``tie_breaker``)
    * ``count_col``   ``COUNT(*) OVER ()``
    * ``total_col``   ``SUM(value) OVER ()``
    * ``running_col`` ``SUM(value) OVER (ORDER BY value DESC)`` with the default
      RANGE frame, so rows with equal ``value`` share one running total.

    The range-partitioned rows are checkpointed to the shared folder. Their
    number of partitions is ``partitions``, or by default what adaptive
    execution makes of the rows' size.
    """
    order = [F.col(value).desc(), F.col(tie_breaker).asc()]
    scratch_root(df.sparkSession)  # checkpoint() writes under the session's shared folder

    # Partition numbers are fixed once by writing the partitioned rows, so the
    # per-partition totals below and the rows they are joined back to agree.
    dealt = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    parts = dealt.withColumn("_part", F.spark_partition_id()).checkpoint()

    local = Window.partitionBy("_part").orderBy(*order)
    tied = Window.partitionBy("_part").orderBy(F.col(value).desc())
    rows = parts.withColumn("_idx", F.row_number().over(local)).withColumn("_run", F.sum(value).over(tied))

    ranked = rows.join(F.broadcast(_carried(rows, value)), "_part")
    # The last tie of a partition may go on in the next ones: their part of it is carried back.
    on_border = F.when(F.col(value).eqNullSafe(F.col("_last")), F.col("_carry")).otherwise(F.lit(0))
    per_part = parts.groupBy().agg(F.count(F.lit(1)).alias("_n"), F.sum(value).alias("_s"))
    return ranked.select(
        *df.columns,
        (F.col("_n_before") + F.col("_idx")).alias(rank_col),
        per_part.select("_n").scalar().alias(count_col),
        per_part.select("_s").scalar().alias(total_col),
        _running(F.col("_s_before"), F.col("_run"), on_border, parts.schema[value].dataType).alias(running_col),
    )


def _running(before: Column, run: Column, carry: Column, kind: T.DataType) -> Column:
    """The three parts of a running total, typed like the sum of ``value``; null where no value has come yet."""
    total = F.coalesce(before, F.lit(0)) + F.coalesce(run, F.lit(0)) + carry
    total = F.when(before.isNotNull() | run.isNotNull(), total)
    if isinstance(kind, T.DecimalType):
        return total.cast(T.DecimalType(min(38, kind.precision + 10), kind.scale))
    return total


def _carried(rows: DataFrame, value: str) -> DataFrame:
    """What each partition has to know of the others: one row per partition.

    ``_n_before`` and ``_s_before`` are the rows and the total before it,
    ``_last`` is its last value, and ``_carry`` the total of the rows with that
    value in the partitions behind it. A value that spans partitions is the
    first one of all of them but the first, so their totals of their first value
    (``_head``), added up from the back, are what is carried.
    """
    ends = rows.groupBy("_part").agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum(value).alias("_s"),
        F.max(value).alias("_first"),
        F.max_by("_run", value).alias("_head"),  # the running total of the first tie
        F.when(F.count(value) == F.count(F.lit(1)), F.min(value)).alias("_last"),  # nulls come last
    )
    by_part = Window.orderBy("_part")
    before = by_part.rowsBetween(Window.unboundedPreceding, -1)
    behind = Window.partitionBy("_first").orderBy(F.col("_part").desc())
    ends = ends.withColumn("_heads", F.sum("_head").over(behind))
    follows = F.lead("_first").over(by_part).eqNullSafe(F.col("_last")) & F.col("_last").isNotNull()
    return ends.select(
        "_part",
        "_last",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n_before"),
        F.sum("_s").over(before).alias("_s_before"),
        F.coalesce(F.when(follows, F.lead("_heads").over(by_part)), F.lit(0)).alias("_carry"),
    )


def cumulative_share_single(
    df: DataFrame,
    value: str,
    tie_breaker: str,
    rank_col: str = "rank",
    count_col: str = "total_count",
    total_col: str = "grand_total",
    running_col: str = "running_total",
) -> DataFrame:
    """The same columns with plain global windows (one task); reference for tests."""
    ordered = Window.orderBy(F.col(value).desc(), F.col(tie_breaker).asc())
    ranged = Window.orderBy(F.col(value).desc())
    everything = Window.partitionBy()
    return df.select(
        *df.columns,
        F.row_number().over(ordered).alias(rank_col),
        F.count(F.lit(1)).over(everything).alias(count_col),
        F.sum(value).over(everything).alias(total_col),
        F.sum(value).over(ranged).alias(running_col),
    )
