"""Inventory efficiency: turnover, days on hand, working capital, month-end value."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions import band, exact_mean, exact_ratio, int_avg
from shelfwise.operators import (
    facts_on_days,
    latest_per_key,
    with_distinct_counts,
    with_product,
    with_store,
    with_store_product,
)
from shelfwise.operators.latest import day_order
from shelfwise.plans.stock import DateLike, _value_by_region_category
from shelfwise.sources.star import Star
from shelfwise.plans.labels import MOVEMENT, TURNOVER_ADVICE


def inventory_turnover(
    star: Star,
    as_of: DateLike = None,
    window_days: int = 90,
    fast: float = 2,
    moderate: float = 0.5,
    reduce_below: float = 0.2,
) -> DataFrame:
    """Turnover = units sold / mean stock (integer mean) per product x store over the window."""
    start = F.date_sub(star.as_of(as_of), window_days)
    per_pair = (
        facts_on_days(star, start)
        .groupBy("Product_SK", "Store_SK")
        .agg(
            F.sum(F.col("Units_Sold")).alias("_units"),
            exact_mean(F.col("Inventory_Level")).alias("_mean_level"),
            int_avg(F.col("Inventory_Level")).alias("_int_level"),
        )
    )
    ratio = F.when(F.col("_int_level") > 0, exact_ratio("_units", "_int_level")).otherwise(F.lit(Decimal(0)))
    per_pair = per_pair.filter(F.col("_mean_level") > 0).withColumn("_ratio", ratio)
    r = F.col("_ratio")
    fast, moderate, reduce_below = (F.lit(Decimal(str(x))) for x in (fast, moderate, reduce_below))
    fast_moving, moderate_moving, slow_moving, not_moving = MOVEMENT
    movement = band([(r > fast, fast_moving), (r > moderate, moderate_moving), (r > 0, slow_moving)], not_moving)
    increase, reduce, maintain = TURNOVER_ADVICE
    advice = band([(r > fast, increase), ((r < reduce_below) & (r > 0), reduce)], maintain)
    return (
        with_store_product(per_pair, star)
        .orderBy(r.desc(), "Product_ID", "Store_ID")
        .select(
            "Product_ID", "Category", "Store_ID", "Region",
            F.col("_units").alias("Units_Sold_90_Days"),
            F.round("_mean_level", 0).alias("Avg_Inventory_Level"),
            F.round(r, 2).alias("Turnover_Ratio"),
            movement.alias("Movement_Category"),
            advice.alias("Recommendation"),
        )
    )


def days_on_hand(star: Star) -> DataFrame:
    """Stock-weighted days of inventory on hand by region and category, whole history.

    The number of days per product x store is ``COUNT(DISTINCT Date_SK)``. It
    is taken from bitmaps of days (``with_distinct_counts``), so the fact's rows
    are combined map-side whatever its grain, repeated grain rows included.
    """
    per_pair = with_distinct_counts(
        star.fact,
        ["Product_SK", "Store_SK"],
        {"Num_Days": "Date_SK"},
        {
            "_levels": (F.sum("Inventory_Level"), F.sum),
            "_leveled": (F.count("Inventory_Level"), F.sum),
            "Total_Sold": (F.sum("Units_Sold"), F.sum),
        },
    ).filter(F.col("Total_Sold") > 0)
    # AVG of a decimal(10,2), from its sum and count.
    mean = F.col("_levels").cast("decimal(20,2)") / F.nullif(F.col("_leveled"), F.lit(0)).cast("decimal(20,0)")
    per_pair = per_pair.withColumn("Avg_Stock", mean.cast("decimal(14,6)"))
    rows = with_store(with_product(per_pair, star, "Category"), star, "Region")
    days = F.sum(F.col("Avg_Stock") * F.col("Num_Days")) / F.nullif(F.sum("Total_Sold"), F.lit(0))
    return (
        rows.groupBy("Region", "Category")
        .agg(days.alias("Avg_Days_of_Inventory_on_Hand"))
        .orderBy("Avg_Days_of_Inventory_on_Hand", "Region", "Category")
    )


def working_capital(star: Star) -> DataFrame:
    """Capital tied up in the latest stock, by region and category (same value as ``inventory_value``)."""
    return _value_by_region_category(star, "Working_Capital_In_Inventory")


def month_end_inventory_value(star: Star) -> DataFrame:
    """Total stock value at each month's last record of every product x store."""
    dated = facts_on_days(star, date_cols=("Date", "Year", "Month"))
    month_end = latest_per_key(
        dated, ["Product_SK", "Store_SK", "Year", "Month"], day_order(), ["Inventory_Level", "Price"]
    )
    return (
        month_end.groupBy("Year", "Month")
        .agg(F.sum(F.col("Inventory_Level").cast("bigint") * F.col("Price")).alias("Total_Inventory_Value"))
        .orderBy("Year", "Month")
    )


def turnover_by_region_category(star: Star) -> DataFrame:
    """Units sold over the sum of mean stock levels, by region and category."""
    per_pair = (
        star.fact.groupBy("Store_SK", "Product_SK")
        .agg(
            F.sum(F.col("Units_Sold")).alias("Total_Units_Sold"),
            F.avg(F.col("Inventory_Level").cast("decimal(10,2)")).alias("Avg_Inventory_Level"),
        )
        .filter(F.col("Avg_Inventory_Level") > 0)
    )
    rows = with_product(with_store(per_pair, star, "Region"), star, "Category")
    ratio = F.sum("Total_Units_Sold") / F.nullif(F.sum("Avg_Inventory_Level"), F.lit(Decimal(0)))
    return (
        rows.groupBy("Region", "Category")
        .agg(F.round(ratio, 2).alias("Inventory_Turnover_Ratio"))
        .orderBy(F.col("Inventory_Turnover_Ratio").desc(), "Region", "Category")
    )
