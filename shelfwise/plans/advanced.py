"""Advanced analytics: ABC classification, product affinity, regional efficiency."""

from __future__ import annotations

import zlib
from decimal import Decimal

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions import band, count_if, int_avg, lookup
from shelfwise.operators import co_occurrence, cumulative_share, facts_on_days, with_distinct_counts
from shelfwise.operators.basket import BLOCK_ITEMS
from shelfwise.plans.stock import DateLike
from shelfwise.sources.star import Star
from shelfwise.plans.labels import ABC_CLASSES, ABC_STRATEGY, AFFINITY, BUNDLE, PERFORMANCE



def abc_classification(
    star: Star,
    as_of: DateLike = None,
    window_days: int = 90,
    a: int = 80,
    b: int = 95,
) -> DataFrame:
    """Pareto A/B/C classes by revenue over the window (rows with sales).

    A product's class is set by the cumulative revenue share *including* the
    product, in descending revenue order; equal revenues share one running
    total. Columns: Product_SK, Total_Revenue, Total_Units_Sold,
    Avg_Inventory_Level, Revenue_Rank, Total_Products, Grand_Total_Revenue,
    Running_Revenue_Total, Revenue_Cumulative_Percent, ABC_Class.
    """
    start = F.date_sub(star.as_of(as_of), window_days)
    revenue = (
        facts_on_days(star, start)
        .filter(F.col("Units_Sold") > 0)
        .groupBy("Product_SK")
        .agg(
            F.sum(F.col("Units_Sold") * F.col("Price")).alias("Total_Revenue"),
            F.sum(F.col("Units_Sold")).alias("Total_Units_Sold"),
            int_avg(F.col("Inventory_Level")).alias("Avg_Inventory_Level"),
        )
    )
    ranked = cumulative_share(
        revenue,
        "Total_Revenue",
        "Product_SK",
        rank_col="Revenue_Rank",
        count_col="Total_Products",
        total_col="Grand_Total_Revenue",
        running_col="Running_Revenue_Total",
    )
    share = F.col("Running_Revenue_Total") / F.col("Grand_Total_Revenue") * 100
    pct = F.col("Revenue_Cumulative_Percent")
    return ranked.withColumn("Revenue_Cumulative_Percent", share).withColumn(
        "ABC_Class", band([(pct <= a, ABC_CLASSES[0]), (pct <= b, ABC_CLASSES[1])], ABC_CLASSES[2])
    )


def abc_product_report(abc: DataFrame, star: Star) -> DataFrame:
    """Per-product ABC report with its management strategy, by revenue."""
    rows = abc.join(star.product.select("Product_SK", "Product_ID", "Category"), "Product_SK")
    return rows.orderBy(F.col("Total_Revenue").desc(), F.col("Product_SK")).select(
        "Product_ID", "Category", "ABC_Class",
        F.round("Total_Revenue", 2).alias("Revenue_90_Days"),
        "Total_Units_Sold",
        F.round("Avg_Inventory_Level", 0).alias("Avg_Inventory"),
        F.round("Revenue_Cumulative_Percent", 2).alias("Cumulative_Revenue_Percent"),
        lookup("ABC_Class", ABC_STRATEGY).alias("Management_Strategy"),
    )


def abc_summary(abc: DataFrame) -> DataFrame:
    """Number and revenue of products per ABC class, with their shares."""
    n = F.count(F.lit(1))
    revenue = F.sum("Total_Revenue")
    return (
        abc.groupBy("ABC_Class")
        .agg(
            n.alias("Number_of_Products"),
            F.round(n * F.lit(Decimal("100.0")) / F.max("Total_Products"), 2).alias("Percent_of_Products"),
            F.round(revenue, 2).alias("Total_Revenue"),
            F.round(revenue * F.lit(Decimal("100.0")) / F.max("Grand_Total_Revenue"), 2).alias("Percent_of_Revenue"),
        )
        .orderBy("ABC_Class")
    )


def abc_table(star: Star, replace: bool = False, **kwargs) -> DataFrame:
    """The classification as a staged table, written once per star and arguments.

    It takes the place of the original's temp table: both reports read it, and
    a lost executor reads the files again. ``replace`` writes it anew in place of
    the one before, as a second run of the original does (``DROP TABLE`` if it
    exists, then ``SELECT INTO``); it belongs to the star and goes with
    ``star.close()``.
    """
    # The reference day is part of the name as the day it stands for now: now() moves on.
    day = star.last_day
    if kwargs.get("as_of") is not None:
        day = star.spark.sql("SELECT 1").select(star.as_of(kwargs["as_of"]).cast("date")).first()[0]
    given = sorted((name, value) for name, value in kwargs.items() if name != "as_of")
    key = f"abc_{str(day).replace('-', '')}_{zlib.crc32(repr(given).encode()):08x}"
    if replace or key not in star.staged:
        return star.staged.replace(key, abc_classification(star, **{**kwargs, "as_of": day}))
    return star.staged.table(key)


def abc_reports(star: Star, **kwargs) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The classification, kept once, and both reports over it. The caller may ``unpersist`` the first."""
    abc = abc_table(star, **kwargs).persist(StorageLevel.MEMORY_AND_DISK)
    return abc, abc_product_report(abc, star), abc_summary(abc)


def product_affinity(
    star: Star,
    min_support: int = 5,
    strong: int = 20,
    moderate: int = 10,
    top: int = 50,
    block_items: int = BLOCK_ITEMS,
) -> DataFrame:
    """Top product pairs sold at the same store on the same day (each store-day is a basket).

    ``block_items``: pairs are formed between blocks of about so many items of
    a store-day, spread over tasks (see ``co_occurrence``).
    """
    sold = star.fact.filter(F.col("Units_Sold") > 0).select("Date_SK", "Store_SK", "Product_SK")
    # The reference joins both products to Dim_Product (inner): unknown keys never form a pair.
    pairs = co_occurrence(
        sold, ["Date_SK", "Store_SK"], "Product_SK", min_support,
        distinct_key="Date_SK", items=star.product.select("Product_SK"), block_items=block_items,
    )
    best = pairs.orderBy(F.col("together").desc(), "item_a", "item_b").limit(top)
    def role(side: str):  # the product dimension in the role of product A or B
        return star.product.select(
            F.col("Product_SK").alias(f"item_{side.lower()}"),
            F.col("Product_ID").alias(f"Product_{side}"),
            F.col("Category").alias(f"Category_{side}"),
        )

    product_a, product_b = role("A"), role("B")
    together = F.col("together")
    strong_label, moderate_label, weak_label = AFFINITY
    strength = band([(together >= strong, strong_label), (together >= moderate, moderate_label)], weak_label)
    cross, same = BUNDLE
    bundle = F.when(F.col("Category_A") != F.col("Category_B"), F.lit(cross)).otherwise(F.lit(same))
    return (
        best.join(product_a, "item_a")
        .join(product_b, "item_b")
        .orderBy(together.desc(), "item_a", "item_b")
        .select(
            "Product_A", "Category_A", "Product_B", "Category_B",
            together.alias("Times_Sold_Together"),
            F.col("distinct_together").alias("Days_Sold_Together"),
            strength.alias("Affinity_Strength"),
            bundle.alias("Bundle_Type"),
        )
    )


def regional_efficiency(star: Star, as_of: DateLike = None, window_days: int = 30) -> DataFrame:
    """Regional KPIs over the window: turnover, stockout rate, revenue per store, rating and ranks.

    The window's rows are combined per store and product first; both distinct
    counts then come from bitmaps (``with_distinct_counts``), in one pass over
    the pairs. Stores are counted by id, as in the original: a store id that
    several keys share is numbered by the smallest of them.
    """
    start = F.date_sub(star.as_of(as_of), window_days)
    per_pair = (
        facts_on_days(star, start)
        .groupBy("Store_SK", "Product_SK")
        .agg(
            F.sum("Inventory_Level").alias("_stock"),
            F.sum("Units_Sold").alias("_units"),
            F.sum(F.col("Units_Sold") * F.col("Price")).cast("decimal(31,2)").alias("_sales"),
            count_if(F.col("Inventory_Level") == 0).alias("_empty"),
            F.count(F.lit(1)).alias("_rows"),
        )
    )
    numbers = star.store.groupBy("Store_ID").agg(F.min("Store_SK").alias("_store"))
    stores = star.store.select("Store_SK", "Store_ID", "Region").join(numbers, "Store_ID", "left")
    rows = per_pair.join(stores.select("Store_SK", "Region", "_store"), "Store_SK")
    total = lambda name: (F.sum(name), F.sum)
    metrics = with_distinct_counts(
        rows,
        ["Region"],
        {"Number_of_Stores": "_store", "Unique_Products": "Product_SK"},
        {
            "Total_Inventory_Units": total("_stock"),
            "Total_Units_Sold": total("_units"),
            "_revenue": (F.sum("_sales").cast("decimal(31,2)"), F.sum),
            "_stockouts": total("_empty"),
            "_records": total("_rows"),
        },
    )
    stores = F.col("Number_of_Stores")
    inventory = F.col("Total_Inventory_Units")
    turnover = F.round(
        F.col("Total_Units_Sold") * F.lit(Decimal("1.0")) / F.nullif(inventory, F.lit(0)), 3
    )
    stockout = F.round(F.col("_stockouts") * F.lit(Decimal("100.0")) / F.col("_records"), 2)
    compared = metrics.select(
        "Region", "Number_of_Stores", "Unique_Products", "Total_Inventory_Units", "Total_Units_Sold",
        F.round("_revenue", 2).alias("Total_Revenue"),
        turnover.alias("Inventory_Turnover_Rate"),
        stockout.alias("Stockout_Rate_Percent"),
        F.round(F.col("_revenue") / stores, 2).alias("Revenue_Per_Store"),
        F.call_function("div", inventory, stores).alias("Avg_Inventory_Per_Store"),
    )
    rate = F.col("Inventory_Turnover_Rate")
    out = F.col("Stockout_Rate_Percent")
    d = lambda x: F.lit(Decimal(x))  # noqa: E731  (exact decimal thresholds)
    excellent, good, average, needs_improvement = PERFORMANCE
    rating = band(
        [
            ((rate > d("0.5")) & (out < 5), excellent),
            ((rate > d("0.3")) & (out < 10), good),
            ((rate > d("0.2")) | (out < 15), average),
        ],
        needs_improvement,
    )
    # One row per region: the ranking windows see a handful of rows.
    return compared.select(
        "*",
        rating.alias("Performance_Rating"),
        F.rank().over(Window.orderBy(rate.desc())).alias("Turnover_Rank"),
        F.rank().over(Window.orderBy(out.asc())).alias("Stockout_Rank"),
    ).orderBy(rate.desc(), "Region")
