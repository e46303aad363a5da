"""Stock levels: current status, regional rollup, latest stock, days of supply, value, obsolete stock."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions import band
from shelfwise.operators import facts_on_days, latest_per_key, with_product, with_store, with_store_product
from shelfwise.operators.latest import day_order
from shelfwise.sources.star import Star
from shelfwise.plans.labels import STOCK_STATUS

DateLike = dt.date | str | Column | None


def stock_status_current(star: Star, as_of: DateLike = None, critical: int = 10, low: int = 50) -> DataFrame:
    """Stock per store and product on the reference day, banded into four statuses."""
    day = star.as_of(as_of)
    rows = with_store_product(facts_on_days(star, day, day), star)
    level = F.col("Inventory_Level")
    out, critical_low, low_stock, adequate = STOCK_STATUS
    status = band([(level == 0, out), (level <= critical, critical_low), (level <= low, low_stock)], adequate)
    return rows.select(
        "Store_ID", "Region", "Product_ID", "Category",
        level.alias("Current_Stock"), status.alias("Stock_Status"),
    ).orderBy("Region", "Category", "Current_Stock", "Store_ID", "Product_ID")


def stock_by_region_category(star: Star, as_of: DateLike = None) -> DataFrame:
    """SKU count and total / mean / min / max stock by region and category on the reference day.

    Rows are combined per region and product before the product join.
    """
    day = star.as_of(as_of)
    level = F.col("Inventory_Level")
    per_product = (
        with_store(facts_on_days(star, day, day), star, "Region")
        .groupBy("Region", "Product_SK")
        .agg(
            F.count(F.lit(1)).alias("_rows"),
            F.sum(level).alias("_stock"),
            F.count(level).alias("_levels"),
            F.min(level).alias("_min"),
            F.max(level).alias("_max"),
        )
    )
    stock = F.sum("_stock")
    return (
        with_product(per_product, star, "Category")
        .groupBy("Region", "Category")
        .agg(
            F.sum("_rows").alias("Total_SKUs"),
            stock.alias("Total_Stock_Units"),
            F.call_function("div", stock, F.nullif(F.sum("_levels"), F.lit(0))).alias("Avg_Stock_Per_SKU"),
            F.min("_min").alias("Min_Stock"),
            F.max("_max").alias("Max_Stock"),
        )
        .orderBy(F.col("Region"), F.col("Total_Stock_Units").desc(), F.col("Category"))
    )


def latest_stock(star: Star, values=("Inventory_Level",), keys=("Store_SK", "Product_SK")) -> DataFrame:
    """Most recent fact values per key, ordered by calendar date (any date)."""
    dated = facts_on_days(star, date_cols=("Date",))
    return latest_per_key(dated, list(keys), day_order(), list(values))


def latest_stock_by_location(star: Star) -> DataFrame:
    """Most recent stock level of every product at every store."""
    rows = with_store_product(latest_stock(star), star)
    return rows.select(
        "Region", "Category", "Store_ID", "Product_ID",
        F.col("Inventory_Level").alias("Current_Stock_Level"),
    ).orderBy(F.col("Region"), F.col("Category"), F.col("Current_Stock_Level").desc(), "Store_ID", "Product_ID")


def low_days_of_supply(star: Star, threshold: int = 7, no_sales: int = 9999) -> DataFrame:
    """Store x product rows whose latest stock covers fewer than ``threshold`` days of mean sales.

    Mean daily sales are per product over all stores and days with sales.
    One pass over the fact: per store x product the latest stock and the
    selling rows' sum and count, then the product's mean from a window over
    those rows (one row per store x product, not per fact row). The calendar is
    left-joined because the mean, as in the original, counts every fact row,
    while the latest stock only considers days known to the calendar.
    """
    units = F.col("Units_Sold")
    selling = F.when(units > 0, units)
    dated = star.fact.join(star.date.select("Date_SK", "Date"), "Date_SK", "left")
    per_pair = dated.groupBy("Store_SK", "Product_SK").agg(
        F.max_by("Inventory_Level", day_order()).alias("Inventory_Level"),
        F.sum(selling).alias("_sold"),
        F.count(selling).alias("_selling_rows"),
    )
    product = Window.partitionBy("Product_SK")
    mean = F.sum("_sold").over(product).cast("decimal(20,2)") / F.nullif(
        F.sum("_selling_rows").over(product), F.lit(0)
    )
    current = per_pair.withColumn("Avg_Daily_Sales", mean.cast("decimal(14,6)")).filter(
        F.col("Avg_Daily_Sales").isNotNull()  # products that never sold drop out, as with the inner join
    )
    avg_sales = F.col("Avg_Daily_Sales")
    supply = F.col("Inventory_Level") / avg_sales
    rows = with_store_product(current, star, ("Region",), ("Product_ID", "Category"))
    return (
        rows.filter((F.col("Inventory_Level") > 0) & (supply < threshold))
        .select(
            "Region", "Category", "Product_ID", "Inventory_Level", "Avg_Daily_Sales",
            F.when(avg_sales > 0, supply).otherwise(F.lit(no_sales)).alias("Days_of_Supply"),
        )
        .orderBy("Days_of_Supply", "Product_ID", "Region")
    )


def _latest_value(star: Star) -> DataFrame:
    current = latest_stock(star, values=("Inventory_Level", "Price"))
    value = F.col("Inventory_Level") * F.col("Price")
    return current.select("Store_SK", "Product_SK", value.alias("Inventory_Value"))


def _value_by_region_category(star: Star, name: str) -> DataFrame:
    value = _latest_value(star).filter(F.col("Inventory_Value") > 0)
    rows = with_product(with_store(value, star, "Region"), star, "Category")
    return (
        rows.groupBy("Region", "Category")
        .agg(F.sum("Inventory_Value").alias(name))
        .orderBy(F.col(name).desc(), "Region", "Category")
    )


def inventory_value(star: Star) -> DataFrame:
    """Value (stock x price) of the latest record per store and product, by region and category."""
    return _value_by_region_category(star, "Total_Inventory_Value")


def obsolete_stock(star: Star, as_of: DateLike = None, days: int = 180) -> DataFrame:
    """Products holding stock value whose last sale is more than ``days`` ago, or who never sold.

    The reference measures the gap to the clock (``GETDATE()``); ``as_of``
    defaults to today accordingly.
    """
    today = F.current_date() if as_of is None else star.as_of(as_of)
    # One pass: per product x store the latest stock value and the last day with sales.
    order = day_order()
    per_pair = (
        facts_on_days(star, date_cols=("Date",))
        .groupBy("Product_SK", "Store_SK")
        .agg(
            F.max_by("Inventory_Level", order).alias("_level"),
            F.max_by("Price", order).alias("_price"),
            F.max(F.when(F.col("Units_Sold") > 0, F.col("Date"))).alias("_last_sale"),
        )
    )
    per_product = per_pair.groupBy("Product_SK").agg(
        F.sum(F.col("_level") * F.col("_price")).alias("Obsolete_Value"),
        F.max("_last_sale").alias("Last_Sale_Date"),
    )
    rows = star.product.select("Product_SK", "Product_ID", "Category").join(per_product, "Product_SK")
    gap = F.datediff(today, F.coalesce(F.col("Last_Sale_Date"), F.lit(dt.date(1900, 1, 1))))
    return (
        rows.filter((F.col("Obsolete_Value") > 0) & (gap > days))
        .select(
            "Product_ID", "Category", "Last_Sale_Date", "Obsolete_Value",
            F.datediff(today, F.col("Last_Sale_Date")).alias("Days_Since_Last_Sale"),
        )
        .orderBy(F.col("Obsolete_Value").desc(), "Product_ID")
    )
