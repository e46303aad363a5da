"""Fact rows restricted to a calendar range, and the calendar columns they need."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.sources.star import Star


def calendar(star: Star, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """Calendar days with ``start <= Date <= end`` (either bound optional)."""
    days = star.date
    if start is not None:
        days = days.filter(F.col("Date") >= start)
    if end is not None:
        days = days.filter(F.col("Date") <= end)
    return days


def facts_on_days(
    star: Star,
    start: Column | None = None,
    end: Column | None = None,
    date_cols: Sequence[str] = (),
) -> DataFrame:
    """Fact rows whose day lies in ``[start, end]``, with ``date_cols`` from the calendar.

    The join to the calendar decides membership, exactly as the reference's
    ``JOIN Dim_Date ... WHERE dd.Date >= ...``. Before it, the fact is also
    filtered on ``Date_SK`` between the smallest and (when ``end`` is given)
    the largest key of the chosen days, read from the calendar. The bounds are
    literals, found by one small job that is remembered per star, or, with a
    deferred star, scalar subqueries: then nothing runs while a query is built.
    Either way they reach the Parquet scan as values, so files and row groups
    outside of the window are skipped, and whole directories when the fact is
    partitioned by day. The filter never drops a matching row.

    The calendar holds one row per day; the planner broadcasts it by its size.
    """
    days = calendar(star, start, end)
    fact = star.fact
    if start is not None or end is not None:
        lo, hi = _subqueries(days) if star.lazy else _literals(star, days, start, end)
        fact = fact.filter(F.col("Date_SK") >= lo)
        if end is not None:
            fact = fact.filter(F.col("Date_SK") <= hi)
    return fact.join(days.select("Date_SK", *date_cols), "Date_SK")


def _literals(star: Star, days: DataFrame, *bounds: Column | None) -> tuple[Column, Column]:
    # Remembered under the days that the bounds stand for now: an expression such as now() moves on.
    bounds = [F.lit(None) if bound is None else bound.cast("date") for bound in bounds]
    key = ("date_sk_range", *star.spark.sql("SELECT 1").select(*bounds).first())
    if key not in star.resolved:
        star.resolved[key] = tuple(days.agg(F.min("Date_SK"), F.max("Date_SK")).first())
    lo, hi = star.resolved[key]
    return F.lit(lo), F.lit(hi)


def _subqueries(days: DataFrame) -> tuple[Column, Column]:
    # Not min() and max(): Spark would merge them into one subquery of two values, which scans cannot take.
    latest = days.select("Date_SK").orderBy(F.col("Date_SK").desc()).limit(1)
    return days.agg(F.min("Date_SK")).scalar(), latest.scalar()
