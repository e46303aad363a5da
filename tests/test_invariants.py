"""Cross-analysis invariants on the sf0.01 star, and single-rule semantics checks."""

from __future__ import annotations

import datetime as dt
from dataclasses import replace
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from shelfwise import load_star, plans
from shelfwise.sources import validate
from tests.conftest import TESTDATA


@pytest.fixture(scope="module")
def star(spark):
    return load_star(spark, f"{TESTDATA}/sf0.01")


def test_inventory_value_equals_working_capital(star):
    value = {(r.Region, r.Category): r.Total_Inventory_Value for r in plans.inventory_value(star).collect()}
    capital = {(r.Region, r.Category): r.Working_Capital_In_Inventory for r in plans.working_capital(star).collect()}
    assert value == capital and value


def test_abc_shares_add_up(star):
    abc = plans.abc_classification(star)
    summary = plans.abc_summary(abc).collect()
    assert sum(r.Number_of_Products for r in summary) == abc.count()
    assert abs(sum(r.Percent_of_Products for r in summary) - 100) <= Decimal("0.02")
    assert abs(sum(r.Percent_of_Revenue for r in summary) - 100) <= Decimal("0.02")
    ranks = sorted(r.Revenue_Rank for r in abc.select("Revenue_Rank").collect())
    assert ranks == list(range(1, len(ranks) + 1))


def test_affinity_pairs_are_ordered_and_supported(star):
    rows = plans.product_affinity(star).collect()
    assert len(rows) == 50
    assert all(r.Times_Sold_Together >= 5 and r.Days_Sold_Together <= r.Times_Sold_Together for r in rows)
    assert all(r.Product_A != r.Product_B for r in rows)
    counts = [r.Times_Sold_Together for r in rows]
    assert counts == sorted(counts, reverse=True)


def test_last_month_end_value_is_at_most_latest_value(star):
    months = plans.month_end_inventory_value(star).collect()
    latest = sum(r.Total_Inventory_Value for r in plans.inventory_value(star).collect())
    assert months[-1].Total_Inventory_Value <= latest


def test_add_months_clamps_to_month_end(spark):
    (row,) = spark.range(1).select(F.add_months(F.lit(dt.date(2024, 5, 31)), -3).alias("d")).collect()
    assert row.d == dt.date(2024, 2, 29)


def test_regional_stock_per_store_is_integer_division(spark):
    from tests.conftest import StarBuilder

    b = StarBuilder(dt.date(2024, 6, 1), dt.date(2024, 6, 30))
    b.stores.append((3, "S3", "WEST"))
    b.product(1)
    b.fact(dt.date(2024, 6, 29), 2, 1, level=5, units=1)
    b.fact(dt.date(2024, 6, 29), 3, 1, level=2, units=1)
    rows = {r.Region: r for r in plans.regional_efficiency(b.build(spark)).collect()}
    assert rows["WEST"].Avg_Inventory_Per_Store == 3  # 7 div 2
    assert rows["WEST"].Number_of_Stores == 2


def test_days_on_hand_counts_a_repeated_day_once(star):
    """Against COUNT(DISTINCT) on a fact whose rows all occur twice, with one more stock level a day."""
    fact = star.fact
    more = fact.withColumn("Inventory_Level", F.col("Inventory_Level") + 1).withColumn("Units_Sold", F.lit(0))
    twice = replace(star, fact=fact.unionAll(fact).unionAll(more))
    per_pair = twice.fact.groupBy("Product_SK", "Store_SK").agg(
        F.avg(F.col("Inventory_Level").cast("decimal(10,2)")).alias("stock"),
        F.sum("Units_Sold").alias("sold"),
        F.count_distinct("Date_SK").alias("days"),
    ).filter("sold > 0")
    want = (
        per_pair.join(star.product, "Product_SK").join(star.store, "Store_SK").groupBy("Region", "Category")
        .agg((F.sum(F.col("stock") * F.col("days")) / F.sum("sold")).alias("d"))
    )
    assert sorted(map(tuple, plans.days_on_hand(twice).collect())) == sorted(map(tuple, want.collect()))


def test_repeated_grain_rows_are_found_and_days_counted_once(star):
    twice = replace(star, fact=star.fact.unionAll(star.fact))
    report = {r.check: r.violations for r in validate(twice).collect()}
    assert report["fact_grain_duplicates"] == twice.fact.count()
    assert all(n == 0 for check, n in report.items() if check != "fact_grain_duplicates")
