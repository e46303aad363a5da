"""Supplier scorecard; the product category stands in for the supplier."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions import band, mean_of_parts, stockout_flag
from shelfwise.operators import facts_on_days, with_product
from shelfwise.plans.stock import DateLike
from shelfwise.sources.star import Star
from shelfwise.plans.labels import SUPPLIER_ACTION, SUPPLIER_RATING


def supplier_scorecard(star: Star, as_of: DateLike = None, window_days: int = 90) -> DataFrame:
    """Products, units, revenue, mean price and stockout rate per category over the window.

    The window's rows are combined per product before the product join.
    """
    start = F.date_sub(star.as_of(as_of), window_days)
    per_product = (
        facts_on_days(star, start)
        .groupBy("Product_SK")
        .agg(
            F.sum("Units_Sold").alias("_units"),
            F.sum(F.col("Units_Sold") * F.col("Price")).alias("_sales"),
            F.sum("Price").alias("_prices"),
            F.count("Price").alias("_priced"),
            F.sum(stockout_flag("Inventory_Level")).alias("_stockouts"),
            F.count(F.lit(1)).alias("_rows"),
        )
    )
    rows = with_product(per_product, star, "Product_ID", "Category")
    metrics = rows.groupBy("Category").agg(
        F.count_distinct("Product_ID").alias("Products_Supplied"),
        F.sum("_units").alias("Total_Units_Sold"),
        F.sum("_sales").cast("decimal(31,2)").alias("_revenue"),
        mean_of_parts("_prices", "_priced", "decimal(20,2)", "decimal(14,6)").alias("_mean_price"),
        F.round(F.sum("_stockouts") * F.lit(Decimal("100.0")) / F.sum("_rows"), 2).alias(
            "Stockout_Rate_Percent"
        ),
    )
    rate = F.col("Stockout_Rate_Percent")
    excellent, good, needs_improvement, poor = SUPPLIER_RATING
    rating = band([(rate < 2, excellent), (rate < 5, good), (rate < 10, needs_improvement)], poor)
    find_other, negotiate, keep = SUPPLIER_ACTION
    action = band([(rate > 10, find_other), (rate > 5, negotiate)], keep)
    return metrics.select(
        F.col("Category").alias("Supplier_Category"),
        "Products_Supplied",
        "Total_Units_Sold",
        F.round("_revenue", 2).alias("Revenue_Generated"),
        F.round("_mean_price", 2).alias("Avg_Price_Point"),
        "Stockout_Rate_Percent",
        rating.alias("Supplier_Rating"),
        action.alias("Action_Recommendation"),
    ).orderBy(F.col("Revenue_Generated").desc(), "Supplier_Category")
