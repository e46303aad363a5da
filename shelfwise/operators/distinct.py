"""Exact distinct counts that are combined map-side, by bitmaps of 64 values.

``COUNT(DISTINCT x)`` makes Spark shuffle a row per group and value, and two of
them in one aggregate first multiply the rows (Expand). Here a value is a bit:
``x div 64`` names a word and ``x mod 64`` a bit of it. An aggregate per group
and word takes the ``bit_or`` of the bits, a ``bigint`` in a hash aggregate, so
every task sends one row for up to 64 values, however often they repeat; the
distinct count is the sum of the words' bit counts. Any integers will do; the
denser they are, the fewer words there are (at worst one per value, as in a plain
distinct). Other aggregates ride along as partial results per word.

With several distinct columns the first aggregate is per group and all their
words. Only its result, smaller than the rows by up to 64 per column, is then laid
out per column.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# name: (the aggregate over rows, how partial results are combined, e.g. F.sum)
Partials = Mapping[str, tuple[Column, Callable[[str], Column]]]


def _word(column: str) -> Column:
    return F.shiftright(F.col(column).cast("long"), 6)


def _bit(column: str) -> Column:
    return F.expr(f"shiftleft(1L, CAST(CAST(`{column}` AS LONG) & 63 AS INT))")


def _combine(df: DataFrame, partials: Partials) -> list[Column]:
    """The partial results combined once more, in their own types."""
    return [combine(name).cast(df.schema[name].dataType).alias(name) for name, (_, combine) in partials.items()]


def with_distinct_counts(
    rows: DataFrame, groups: Sequence[str], counted: Mapping[str, str], partials: Partials
) -> DataFrame:
    """``groups``, one column per key of ``counted`` (distinct non-null values of an integer column), and ``partials``.

    A partial result keeps its type when it is combined, so its aggregate
    should be wide enough for the whole group.
    """
    groups, names = list(groups), list(counted)
    words = {name: f"_word_{i}" for i, name in enumerate(names)}
    bits = {name: f"_bits_{i}" for i, name in enumerate(names)}
    cells = rows.groupBy(*groups, *[_word(column).alias(words[name]) for name, column in counted.items()]).agg(
        *[F.bit_or(_bit(column)).alias(bits[name]) for name, column in counted.items()],
        *[aggregate.alias(name) for name, (aggregate, _) in partials.items()],
    )
    if len(names) == 1:
        count = F.coalesce(F.sum(F.bit_count(bits[names[0]])), F.lit(0)).cast("long")
        return cells.groupBy(*groups).agg(count.alias(names[0]), *_combine(cells, partials))
    # One row per distinct column; the partial results stay with the first.
    entries = [
        F.struct(F.lit(i).alias("_of"), F.col(words[name]).alias("_word"), F.col(bits[name]).alias("_bits"))
        for i, name in enumerate(names)
    ]
    laid_out = cells.select(*groups, *partials, F.explode(F.array(*entries)).alias("_e")).select(
        *groups, "_e.*", *[F.when(F.col("_e._of") == 0, F.col(name)).alias(name) for name in partials]
    )
    merged = laid_out.groupBy(*groups, "_of", "_word").agg(F.bit_or("_bits").alias("_bits"), *_combine(cells, partials))
    counts = [
        F.coalesce(F.sum(F.when(F.col("_of") == i, F.bit_count("_bits"))), F.lit(0)).cast("long").alias(name)
        for i, name in enumerate(names)
    ]
    return merged.groupBy(*groups).agg(*counts, *_combine(cells, partials))
