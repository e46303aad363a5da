"""Sales performance: velocity per product and revenue by region and category."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions import mean_of_parts
from shelfwise.operators import with_product, with_store, with_store_product
from shelfwise.sources.star import Star


def sales_velocity(star: Star, week: int = 7, month: int = 30, aggregate_first: bool = True) -> DataFrame:
    """Mean daily units per product (all rows, zero sales included), scaled to a week and a month.

    ``aggregate_first`` (the default, whatever the sizes) sums
    the fact per product key before joining the product names.
    """
    units = F.col("Units_Sold")
    if aggregate_first:
        per_key = star.fact.groupBy("Product_SK").agg(F.sum(units).alias("_s"), F.count(units).alias("_n"))
        mean_expr = mean_of_parts("_s", "_n", "decimal(20,2)", "decimal(14,6)")
        grouped = with_product(per_key, star, "Product_ID", "Category").groupBy("Product_ID", "Category")
    else:
        mean_expr = F.avg(units.cast("decimal(10,2)"))
        grouped = with_product(star.fact, star, "Product_ID", "Category").groupBy("Product_ID", "Category")
    mean = F.col("Avg_Daily_Sales")
    return (
        grouped.agg(mean_expr.alias("Avg_Daily_Sales"))
        .select(
            "Product_ID", "Category", "Avg_Daily_Sales",
            (mean * week).alias("Estimated_Weekly_Sales"),
            (mean * month).alias("Estimated_Monthly_Sales"),
        )
        .orderBy(F.col("Category"), mean.desc(), F.col("Product_ID"))
    )


def revenue_by_region_category(star: Star, aggregate_first: bool = True) -> DataFrame:
    """Units sold and revenue (units x price) by region and category.

    ``aggregate_first`` (the default, whatever the sizes) sums
    per region and product key before joining the product categories.
    """
    units, revenue = F.col("Units_Sold"), F.col("Units_Sold") * F.col("Price")
    if aggregate_first:
        per_key = (
            with_store(star.fact, star, "Region")
            .groupBy("Region", "Product_SK")
            .agg(F.sum(units).alias("_u"), F.sum(revenue).alias("_r"))
        )
        rows = with_product(per_key, star, "Category")
        units_total, revenue_total = F.sum("_u"), F.sum("_r").cast("decimal(31,2)")
    else:
        rows = with_store_product(star.fact, star, ("Region",), ("Category",))
        units_total, revenue_total = F.sum(units), F.sum(revenue)
    return (
        rows.groupBy("Region", "Category")
        .agg(units_total.alias("Total_Units_Sold"), revenue_total.alias("Total_Revenue"))
        .orderBy(F.col("Region"), F.col("Total_Revenue").desc(), F.col("Category"))
    )
