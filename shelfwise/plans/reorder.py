"""Reorder point and maximum stock from recent sales."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions import band, exact_mean, moment_sums, with_ceil_mean_plus_sd
from shelfwise.operators import facts_on_days, with_store_product
from shelfwise.plans.stock import DateLike
from shelfwise.sources.star import Star
from shelfwise.plans.labels import VELOCITY


def reorder_point(
    star: Star,
    as_of: DateLike = None,
    window_days: int = 90,
    lead_days: int = 7,
    z: int = 2,
    max_days: int = 14,
    high: int = 10,
    medium: int = 3,
) -> DataFrame:
    """Per product x store: reorder point = mean x lead time + z x sd, max stock = mean x ``max_days``.

    Mean and sample sd of daily units over the days since ``as_of - window_days``.
    Both ceilings are computed exactly from the count, sum and sum of squares
    (a floating sd would make a result that is exactly an integer land on
    either side of it, depending on how partial results were merged). The
    displayed mean is the exact mean rounded half up to 2 places.
    """
    start = F.date_sub(star.as_of(as_of), window_days)
    units = F.col("Units_Sold")
    stats = (
        facts_on_days(star, start)
        .groupBy("Product_SK", "Store_SK")
        .agg(exact_mean(units).alias("_exact_mean"), *moment_sums(units, "_u"))
    )
    exact = F.col("_exact_mean")
    stats = with_ceil_mean_plus_sd(stats.filter(exact > 0), "_u", "_reorder", lead_days, z)
    # Sold units are positive in total here, so the ceiling is an integer division.
    total, n = F.col("_u_s") * max_days, F.col("_u_n")
    stats = stats.withColumn("_max_stock", F.call_function("div", total + n - 1, n))
    rows = with_store_product(stats, star)
    fast, steady, slow = VELOCITY
    velocity = band([(exact > high, fast), (exact > medium, steady)], slow)
    return rows.select(
        "Product_ID", "Category", "Store_ID", "Region",
        F.round(exact, 2).alias("Avg_Daily_Sales"),
        F.col("_reorder").cast("bigint").alias("Suggested_Reorder_Point"),
        F.col("_max_stock").cast("bigint").alias("Suggested_Max_Stock"),
        velocity.alias("Product_Velocity"),
    ).orderBy(F.col("Avg_Daily_Sales").desc(), "Product_ID", "Store_ID")
