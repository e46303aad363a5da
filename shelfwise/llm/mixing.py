"""Operator 4: mixing sources to target weights by Poisson replication.

A source of ``n`` documents that is to make up the share ``w`` of a mixture of
``size`` documents repeats each document ``w * size / n`` times on average.
Each document's number of copies is a Poisson draw with that mean: a hash of
the seed and ``doc_id`` gives a uniform number, and inverting the Poisson
distribution function turns it into a count. No document depends on another,
so a rerun, a retry or a later append gives every document the same count.
Copies are then put in a global pseudo-random order.

A mean above ``STEP`` is split into equal parts, each drawn with a hash of its
own; a sum of Poisson draws is a Poisson draw, so this is exact and keeps the
table of the distribution function short for any weight.

Only DataFrame functions are used.

Defined results: a null source is a source of its own; a source without a
target weight, or with one of zero, leaves the mixture; repeated rows draw the
same count each; a null ``doc_id`` draws as the text "null"; an empty table
gives no rows. Input columns may have any names; those of the form ``__mix_*``
are reserved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import keep, small_side

STEP = 8.0  # largest mean inverted at once
HASH_BITS = 52  # so many bits of the hash make an exact double


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) from a hash of the parts: the first 52 bits of MD5."""
    texts = [F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("null")) for p in parts]
    digits = F.substring(F.md5(F.concat_ws(":", *texts)), 1, HASH_BITS // 4)
    return F.conv(digits, 16, 10).cast("long").cast("double") / F.lit(float(1 << HASH_BITS))


def tempered_weights(docs: DataFrame, by: str, alpha: float) -> DataFrame:
    """``weight`` per value of ``by``: its number of rows to the power ``alpha``."""
    return docs.groupBy(F.col(f"`{by}`").alias("__mix_source")).agg(
        F.pow(F.count(F.lit(1)).cast("double"), F.lit(alpha)).alias("weight")
    ).withColumnRenamed("__mix_source", by)


def repetition_rates(docs: DataFrame, weights: DataFrame, by: str, size: float | None = None) -> DataFrame:
    """``__mix_source, rate``: mean copies per document, for weights ``(by, weight)``; ``size``: documents wanted."""
    counts = docs.groupBy(F.col(f"`{by}`").alias("__mix_source")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    wanted = weights.select(
        F.col(f"`{by}`").alias("__mix_target"), F.col("weight").cast("double").alias("weight")
    ).filter("weight > 0")
    joined = counts.join(wanted, F.col("__mix_source").eqNullSafe(F.col("__mix_target"))).drop("__mix_target")
    weight, present = joined.agg(F.sum("weight"), F.sum("n")).first()
    wanted_size = float(present or 0) if size is None else float(size)
    rate = F.col("weight") / F.lit(float(weight or 1)) * F.lit(wanted_size) / F.col("n")
    return joined.select("__mix_source", rate.alias("rate"))


def with_distribution(rates: DataFrame) -> DataFrame:
    """Add the number of parts of each rate and the distribution function of one part as an array."""
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / STEP)).cast("int")
    # Beyond mean + 12 deviations + 30 the remaining probability is below 2**-52.
    return rates.select(
        "__mix_source", parts.alias("__mix_parts"), (F.col("rate") / parts).alias("__mix_mean")
    ).withColumn(
        "__mix_cdf",
        F.expr(
            """aggregate(
                 sequence(1, cast(ceil(__mix_mean + 12 * sqrt(__mix_mean) + 30) as int)),
                 named_struct('p', exp(-__mix_mean), 'sum', exp(-__mix_mean), 'all', array(exp(-__mix_mean))),
                 (s, k) -> named_struct('p', s.p * __mix_mean / k, 'sum', s.sum + s.p * __mix_mean / k,
                                        'all', array_append(s.all, s.sum + s.p * __mix_mean / k)),
                 s -> s.all)"""
        ),
    )


def draw_copies(docs: DataFrame, rates: DataFrame, by: str, seed: int) -> DataFrame:
    """``docs`` with ``__mix_n``, the number of copies of each document (rows of no copies stay)."""
    table = small_side(with_distribution(rates))
    drawn = docs.join(table, F.col(f"`{by}`").eqNullSafe(F.col("__mix_source")))
    part = F.transform(
        F.sequence(F.lit(1), F.col("__mix_parts")), lambda j: uniform(F.lit(seed), F.col("doc_id"), j)
    )
    inverted = F.aggregate(
        part, F.lit(0), lambda n, u: n + F.size(F.filter("__mix_cdf", lambda c: c <= u))
    )
    return drawn.withColumn("__mix_n", inverted).drop("__mix_source", "__mix_parts", "__mix_mean", "__mix_cdf")


def mix(
    docs: DataFrame,
    weights: DataFrame | None = None,
    by: str = "source",
    alpha: float = 0.5,
    size: float | None = None,
    seed: int = 17,
    copy_column: str | None = None,
    scratch: str | None = None,
) -> DataFrame:
    """``docs`` replicated to the target weights, in a global pseudo-random order.

    ``weights``: ``(by, weight)``; by default each source's rows to the power
    ``alpha``, which raises small sources without making all equal. ``size``:
    expected documents of the mixture, by default as many as there are.
    ``copy_column``: name for the number of the copy, from 0; an input column
    of that name is replaced.
    """
    if weights is None:
        weights = tempered_weights(docs, by, alpha)
    rates = keep(repetition_rates(docs, weights, by, size), "rates", scratch)
    drawn = draw_copies(docs, rates, by, seed).filter("__mix_n > 0")
    copies = drawn.withColumn("__mix_copy", F.explode(F.sequence(F.lit(0), F.col("__mix_n") - 1)))
    order = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("__mix_copy"))
    mixed = copies.withColumn("__mix_order", order).repartitionByRange("__mix_order").sortWithinPartitions("__mix_order")
    columns = [F.col(f"`{c}`") for c in docs.columns if c != copy_column]
    if copy_column:
        columns.append(F.col("__mix_copy").cast("long").alias(copy_column))
    return mixed.select(*columns)
