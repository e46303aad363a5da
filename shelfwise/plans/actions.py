"""Action plan: a stock action per product x store, counted by category and region."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions import band, exact_mean, int_avg, lookup
from shelfwise.operators import facts_on_days, with_store_product
from shelfwise.plans.stock import DateLike
from shelfwise.sources.star import Star
from shelfwise.plans.labels import ACTIONS, ADVICE, DEFAULT_ADVICE



def action_plan(
    star: Star,
    as_of: DateLike = None,
    window_days: int = 30,
    cover_low: int = 3,
    cover_high: int = 10,
    slow_sales: int = 5,
    high_stock: int = 20,
) -> DataFrame:
    """First matching action per product x store over the window, then counted per action, category, region.

    With L the integer mean stock, S the units sold and m the mean daily
    units: L = 0 and S > 0 -> URGENT_RESTOCK; L < 3m -> INCREASE_STOCK;
    L > 10m and S < 5 -> REDUCE_STOCK; S = 0 and L > 20 -> CONSIDER_DISCONTINUE;
    else MAINTAIN. ``L < 3m`` is tested as ``L * count < 3 * S`` so that no
    rounding of m can flip it.
    """
    start = F.date_sub(star.as_of(as_of), window_days)
    per_pair = (
        facts_on_days(star, start)
        .groupBy("Product_SK", "Store_SK")
        .agg(
            exact_mean(F.col("Inventory_Level")).alias("Current_Avg_Inventory"),
            F.sum(F.col("Units_Sold")).alias("Recent_Sales"),
            int_avg(F.col("Inventory_Level")).alias("_level"),
            F.count(F.col("Units_Sold")).alias("_days"),
        )
    )
    level, sales, days = F.col("_level"), F.col("Recent_Sales"), F.col("_days")
    urgent, increase, reduce, discontinue, maintain = ACTIONS
    action = band(
        [
            ((level == 0) & (sales > 0), urgent),
            (level * days < cover_low * sales, increase),
            ((level * days > cover_high * sales) & (sales < slow_sales), reduce),
            ((sales == 0) & (level > high_stock), discontinue),
        ],
        maintain,
    )
    rows = with_store_product(per_pair.withColumn("Action_Required", action), star, ("Region",), ("Category",))
    priority = band([(F.col("Action_Required") == a, str(i)) for i, a in enumerate(ACTIONS[:-1], 1)], "5")
    return (
        rows.groupBy("Action_Required", "Category", "Region")
        .agg(
            F.count(F.lit(1)).alias("Number_of_Items"),
            F.sum("Current_Avg_Inventory").alias("Total_Current_Inventory"),
            F.sum("Recent_Sales").alias("Total_Recent_Sales"),
        )
        .withColumn("Recommendation", lookup("Action_Required", ADVICE, DEFAULT_ADVICE))
        .orderBy(priority.cast("int"), F.col("Number_of_Items").desc(), "Category", "Region")
    )
