"""Joins from fact-shaped rows to the store and product dimensions.

No broadcast hint is given here: the planner broadcasts a dimension only when
its measured size is under ``spark.sql.autoBroadcastJoinThreshold`` (and AQE
re-checks it at run time), otherwise it falls back to a sort-merge join. A
product dimension with many millions of rows is therefore still handled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from shelfwise.sources.star import Star


def with_store(df: DataFrame, star: Star, *cols: str) -> DataFrame:
    return df.join(star.store.select("Store_SK", *cols), "Store_SK")


def with_product(df: DataFrame, star: Star, *cols: str) -> DataFrame:
    return df.join(star.product.select("Product_SK", *cols), "Product_SK")


def with_store_product(
    df: DataFrame, star: Star, store_cols=("Store_ID", "Region"), product_cols=("Product_ID", "Category")
) -> DataFrame:
    return with_product(with_store(df, star, *store_cols), star, *product_cols)
