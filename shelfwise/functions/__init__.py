"""Column helpers for the arithmetic rules the analyses depend on.

The reference is T-SQL. Three of its typing rules change results and are kept:

* ``AVG`` over an integer column is an integer, truncated toward zero
  (:func:`int_avg`); its output then drives labels such as "average stock = 0".
* money and ratios are exact decimals; Spark's decimal precision rules are the
  same as SQL Server's, so ``decimal / decimal`` keeps at least 6 decimals and
  ``ROUND`` rounds half away from zero on the exact value.
* ``AVG(CAST(x AS FLOAT))`` is a mean of integers. It is computed here as an
  exact decimal (:func:`exact_mean`), so rounding and sums of means do not
  depend on the order in which partitions are added up.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def int_avg(c: ColumnOrName) -> Column:
    """``AVG(int)`` with T-SQL semantics: ``sum div count``, NULL for no values."""
    c = _col(c)
    return F.call_function("div", F.sum(c), F.nullif(F.count(c), F.lit(0)))


def exact_mean(c: ColumnOrName) -> Column:
    """Mean of an integer column as ``decimal(38,18)`` (exact to 18 places, half up)."""
    c = _col(c)
    return F.sum(c).cast("decimal(20,0)") / F.nullif(F.count(c), F.lit(0)).cast("decimal(20,0)")


def exact_ratio(num: ColumnOrName, den: ColumnOrName) -> Column:
    """``num / den`` for integer operands as ``decimal(38,18)``; NULL when ``den`` is 0."""
    return _col(num).cast("decimal(20,0)") / F.nullif(_col(den), F.lit(0)).cast("decimal(20,0)")


def _big(c: Column) -> Column:
    return c.cast("decimal(38,0)")


def moment_sums(c: ColumnOrName, prefix: str) -> list[Column]:
    """``count``, ``sum`` and ``sum of squares`` of an integer column (exact), as aggregates.

    They give the sample variance exactly: ``(n*q - s*s) / (n*(n-1))``. The
    per-row work stays in ``bigint`` (codegen'd, combined map-side; with ANSI
    mode an overflow fails instead of wrapping); only the per-group results
    are widened to ``decimal(38,0)`` by the formulas below.
    """
    c = _col(c).cast("long")
    return [
        F.count(c).alias(f"{prefix}_n"),
        F.sum(c).alias(f"{prefix}_s"),
        F.sum(c * c).alias(f"{prefix}_q"),
    ]


def with_rounded_sample_sd(df: DataFrame, prefix: str, out: str) -> DataFrame:
    """Add ``out`` = ``ROUND(COALESCE(STDEV(x), 0), 0)`` from :func:`moment_sums`, exactly (half up).

    A floating ``stddev_samp`` depends on the order partial results are merged
    in, so a deviation of exactly k + 0.5 could round either way. Here a
    double estimate is corrected with integer arithmetic: the result is the
    largest r with ``(2r - 1)^2 * n(n-1) <= 4 * (n*q - s*s)``. Intermediate
    values are separate columns, each computed once per group.
    """
    n, s, q = (_big(F.col(f"{prefix}_{k}")) for k in "nsq")
    df = df.withColumn("_sd_v4", _big(F.lit(4)) * (n * q - s * s)).withColumn("_sd_pairs", n * (n - 1))
    v4, pairs = F.col("_sd_v4"), F.col("_sd_pairs")
    estimate = F.sqrt(v4.cast("double") / F.nullif(pairs, _big(F.lit(0))).cast("double")) / 2 + 0.5
    df = df.withColumn("_sd_guess", _big(F.floor(estimate)))
    guess = F.col("_sd_guess")
    low, high = _big(F.lit(2)) * guess - 1, _big(F.lit(2)) * guess + 1
    exact = (
        F.when((guess > 0) & (low * low * pairs > v4), guess - 1)
        .when(high * high * pairs <= v4, guess + 1)
        .otherwise(guess)
    )
    df = df.withColumn(out, F.when(n >= 2, exact).otherwise(_big(F.lit(0))))
    return df.drop("_sd_v4", "_sd_pairs", "_sd_guess")


def with_ceil_mean_plus_sd(df: DataFrame, prefix: str, out: str, mean_factor: int, sd_factor: int) -> DataFrame:
    """Add ``out`` = ``CEILING(mean * a + b * COALESCE(STDEV(x), 0))`` from :func:`moment_sums`, exactly.

    The smallest integer c with ``c*n - a*s >= 0`` and
    ``(c*n - a*s)^2 * (n-1) >= b^2 * n * (n*q - s*s)``; a double estimate is
    corrected by one step either way. With one value the deviation is 0.
    Intermediate values are separate columns, each computed once per group.
    """
    n, s, q = (_big(F.col(f"{prefix}_{k}")) for k in "nsq")
    tag = f"_{out}"
    df = df.withColumn(f"{tag}_spread", _big(F.lit(sd_factor * sd_factor)) * n * (n * q - s * s)).withColumn(
        f"{tag}_as", _big(F.lit(mean_factor)) * s
    )
    spread, a_s = F.col(f"{tag}_spread"), F.col(f"{tag}_as")
    variance = (n * q - s * s).cast("double") / F.nullif(n * (n - 1), _big(F.lit(0))).cast("double")
    estimate = s.cast("double") / F.nullif(n, _big(F.lit(0))).cast("double") * mean_factor
    df = df.withColumn(f"{tag}_guess", _big(F.ceil(estimate + sd_factor * F.sqrt(variance))))
    guess = F.col(f"{tag}_guess")
    df = df.withColumn(f"{tag}_below", guess * n - n - a_s).withColumn(f"{tag}_at", guess * n - a_s)
    below, at = F.col(f"{tag}_below"), F.col(f"{tag}_at")  # c*n - a*s for c = guess - 1 and c = guess

    def fits(gap: Column) -> Column:
        return (gap >= 0) & (gap * gap * (n - 1) >= spread)

    exact = F.when(fits(below), guess - 1).when(fits(at), guess).otherwise(guess + 1)
    single = _big(F.ceil(a_s / F.nullif(n, _big(F.lit(0)))))
    df = df.withColumn(out, F.when(n >= 2, exact).when(n == 1, single))
    return df.drop(f"{tag}_spread", f"{tag}_as", f"{tag}_guess", f"{tag}_below", f"{tag}_at")


def mean_of_parts(total: ColumnOrName, count: ColumnOrName, total_type: str, result_type: str) -> Column:
    """A mean rebuilt from partial sums and counts, typed like Spark's ``avg`` of a decimal.

    ``avg(decimal(p,s))`` keeps ``sum / count`` as ``decimal(p+4, s+4)``,
    rounded half up; the same value from pre-aggregated parts is
    ``sum(parts) / sum(counts)`` cast to that type (NULL for no values).
    """
    return (
        F.sum(total).cast(total_type) / F.nullif(F.sum(count), F.lit(0)).cast("decimal(20,0)")
    ).cast(result_type)


def band(cases: Iterable[tuple[Column, str]], default: str | None) -> Column:
    """Searched ``CASE``: first matching predicate wins, else ``default``."""
    expr = None
    for predicate, label in cases:
        expr = F.when(predicate, F.lit(label)) if expr is None else expr.when(predicate, F.lit(label))
    if expr is None:
        return F.lit(default)
    return expr.otherwise(F.lit(default))


def lookup(key: ColumnOrName, mapping: dict[str, str], default: str | None = None) -> Column:
    """Simple ``CASE key WHEN v THEN ...``; ``default`` when nothing matches."""
    key = _col(key)
    return band(((key == F.lit(k), v) for k, v in mapping.items()), default)


def count_if(predicate: Column) -> Column:
    """``COUNT(CASE WHEN p THEN 1 END)``."""
    return F.count(F.when(predicate, F.lit(1)))


def stockout_flag(level: ColumnOrName) -> Column:
    """1 when the stock level is exactly zero, else 0 (NULL stock counts as 0)."""
    return F.when(_col(level) == 0, F.lit(1)).otherwise(F.lit(0))


__all__ = [
    "band",
    "with_ceil_mean_plus_sd",
    "count_if",
    "exact_mean",
    "exact_ratio",
    "int_avg",
    "lookup",
    "mean_of_parts",
    "moment_sums",
    "with_rounded_sample_sd",
    "stockout_flag",
]
