"""Forecasting and external factors: demand trend, promotions, MAPE, forecast variance, discounts."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions import band, exact_mean, int_avg, mean_of_parts, moment_sums, with_rounded_sample_sd
from shelfwise.operators import facts_on_days, with_product, with_store, with_store_product
from shelfwise.plans.stock import DateLike
from shelfwise.sources.star import Star
from shelfwise.plans.labels import DAY_TYPE, TREND


def demand_trend_forecast(
    star: Star,
    as_of: DateLike = None,
    months: int = 12,
    recent_months: int = 3,
    previous_from: int = 6,
    previous_to: int = 4,
    up: str = "1.1",
    down: str = "0.9",
    buffer: str = "1.2",
) -> DataFrame:
    """Monthly sales per product x store: mean, volatility, recent vs previous months, trend, forecast.

    Rows from ``add_months(as_of, -months)``; "recent" months start on or after
    ``add_months(as_of, -recent_months)``, "previous" months start between
    ``add_months(as_of, -previous_from)`` and ``add_months(as_of, -previous_to)``.
    Both month means are integer means. Months without rows are absent, not zero.
    """
    as_of_day = star.as_of(as_of)
    start = F.add_months(as_of_day, -months)
    month_start = F.make_date("Year", "Month", F.lit(1))
    monthly = (
        facts_on_days(star, start, date_cols=("Year", "Month"))
        .groupBy("Product_SK", "Store_SK", "Year", "Month")
        .agg(F.sum(F.col("Units_Sold")).alias("_units"))
        .withColumn("_recent", month_start >= F.add_months(as_of_day, -recent_months))
        .withColumn(
            "_previous",
            month_start.between(F.add_months(as_of_day, -previous_from), F.add_months(as_of_day, -previous_to)),
        )
    )
    m = F.col("_units")
    trend = monthly.groupBy("Product_SK", "Store_SK").agg(
        exact_mean(m).alias("_mean"),
        *moment_sums(m, "_m"),
        int_avg(F.when(F.col("_recent"), m)).alias("_recent_mean"),
        int_avg(F.when(F.col("_previous"), m)).alias("_previous_mean"),
    )
    trend = with_rounded_sample_sd(trend, "_m", "_sd_round")
    recent = F.coalesce(F.col("_recent_mean"), F.lit(0))
    previous = F.coalesce(F.col("_previous_mean"), F.lit(0))
    growing, declining, stable = TREND
    direction = band(
        [(recent > previous * F.lit(Decimal(up)), growing), (recent < previous * F.lit(Decimal(down)), declining)],
        stable,
    )
    basis = F.coalesce(F.col("_recent_mean").cast("decimal(38,18)"), F.col("_mean"), F.lit(Decimal(0)))
    return (
        with_store_product(trend.filter(F.col("_mean") > 0), star)
        .orderBy(F.col("_mean").desc(), "Product_ID", "Store_ID")
        .select(
            "Product_ID", "Category", "Store_ID", "Region",
            F.round("_mean", 0).alias("Avg_Monthly_Sales"),
            F.col("_sd_round").cast("double").alias("Sales_Volatility"),
            F.round(recent, 0).alias("Recent_3_Month_Avg"),
            F.round(previous, 0).alias("Previous_3_Month_Avg"),
            direction.alias("Trend_Direction"),
            F.round(basis * F.lit(Decimal(buffer)), 0).alias("Forecast_Next_Month"),
        )
    )


def _int_avg_of_parts(total: str, count: str) -> F.Column:
    """T-SQL ``AVG(int)`` rebuilt from partial sums and counts: ``sum div count``."""
    return F.call_function("div", F.sum(total), F.nullif(F.sum(count), F.lit(0)))


def holiday_promotion_impact(star: Star, aggregate_first: bool = True) -> DataFrame:
    """Sales, revenue and price on promotion rows vs regular rows, by category (rows with sales).

    ``aggregate_first`` (the default, whatever the sizes) sums
    per product key and flag before joining the product categories.
    """
    units, price = F.col("Units_Sold"), F.col("Price")
    sold = star.fact.filter(units > 0)
    if aggregate_first:
        per_key = sold.groupBy("Product_SK", "Holiday_Promotion").agg(
            F.count(F.lit(1)).alias("_rows"), F.sum(units).alias("_u"), F.count(units).alias("_un"),
            F.sum(units * price).alias("_r"), F.sum(price).alias("_p"), F.count(price).alias("_pn"),
        )
        rows = with_product(per_key, star, "Category")
        aggs = [
            F.sum("_rows"), F.sum("_u"), _int_avg_of_parts("_u", "_un"), F.sum("_r").cast("decimal(31,2)"),
            mean_of_parts("_p", "_pn", "decimal(20,2)", "decimal(14,6)"),
        ]
    else:
        rows = with_product(sold, star, "Category")
        aggs = [F.count(F.lit(1)), F.sum(units), int_avg(units), F.sum(units * price), F.avg(price)]
    names = ["Number_of_Days", "Total_Units_Sold", "Avg_Daily_Sales", "Total_Revenue", "Avg_Price"]
    flag = F.col("Holiday_Promotion")
    return (
        rows.groupBy("Holiday_Promotion", "Category")
        .agg(*[a.alias(n) for a, n in zip(aggs, names)])
        .select(
            F.when(flag == 1, F.lit(DAY_TYPE[0])).otherwise(F.lit(DAY_TYPE[1])).alias("Day_Type"),
            "Category", *names,
        )
        .orderBy(F.col("Day_Type"), F.col("Total_Revenue").desc(), F.col("Category"))
    )


def forecast_mape(star: Star, aggregate_first: bool = True) -> DataFrame:
    """Mean absolute percentage error of the demand forecast per product (rows with sales).

    ``aggregate_first`` (the default, whatever the sizes) sums
    the per-row errors per product key before joining the product names.
    """
    units = F.col("Units_Sold")
    sold = star.fact.filter(units > 0)
    ape = F.abs(units - F.col("Demand_Forecast")) / F.nullif(units, F.lit(0))
    if aggregate_first:
        per_key = sold.groupBy("Product_SK").agg(F.sum(ape).alias("_e"), F.count(ape).alias("_en"))
        rows = with_product(per_key, star, "Product_ID", "Category")
        mean = mean_of_parts("_e", "_en", "decimal(34,13)", "decimal(28,17)")
    else:
        rows = with_product(sold, star, "Product_ID", "Category")
        mean = F.avg(ape)
    return (
        rows.groupBy("Product_ID", "Category")
        .agg((mean * 100).alias("MAPE"))
        .filter(F.col("MAPE").isNotNull())
        .orderBy(F.col("MAPE").desc(), F.col("Product_ID"))
    )


def forecast_unit_variance(star: Star, aggregate_first: bool = True) -> DataFrame:
    """Forecast minus actual units by category and region; positive means over-forecast.

    ``aggregate_first`` (the default, whatever the sizes) sums
    per region and product key before joining the product categories.
    """
    units, forecast = F.col("Units_Sold"), F.col("Demand_Forecast")
    if aggregate_first:
        per_key = (
            with_store(star.fact, star, "Region")
            .groupBy("Region", "Product_SK")
            .agg(F.sum(forecast).alias("_f"), F.sum(units).alias("_u"))
        )
        rows = with_product(per_key, star, "Category")
        totals = [F.sum("_f").cast("decimal(20,2)"), F.sum("_u")]
    else:
        rows = with_store_product(star.fact, star, ("Region",), ("Category",))
        totals = [F.sum(forecast), F.sum(units)]
    variance = F.col("Total_Forecasted_Units") - F.col("Total_Sold_Units")
    return (
        rows.groupBy("Category", "Region")
        .agg(totals[0].alias("Total_Forecasted_Units"), totals[1].alias("Total_Sold_Units"))
        .select("Category", "Region", "Total_Forecasted_Units", "Total_Sold_Units", variance.alias("Unit_Variance"))
        .orderBy(F.abs(F.col("Unit_Variance")).desc(), "Category", "Region")
    )


def discount_impact(star: Star, aggregate_first: bool = True) -> DataFrame:
    """Mean units with and without discount (integer means) and mean discount, by category.

    ``aggregate_first`` (the default, whatever the sizes) sums
    per product key before joining the product categories.
    """
    discount, units = F.col("Discount"), F.col("Units_Sold")
    with_disc, without_disc = F.when(discount > 0, units), F.when(discount == 0, units)
    disc = F.when(discount > 0, discount)
    if aggregate_first:
        per_key = star.fact.groupBy("Product_SK").agg(
            F.sum(with_disc).alias("_ws"), F.count(with_disc).alias("_wn"),
            F.sum(without_disc).alias("_os"), F.count(without_disc).alias("_on"),
            F.sum(disc).alias("_ds"), F.count(disc).alias("_dn"),
        )
        rows = with_product(per_key, star, "Category")
        aggs = [
            _int_avg_of_parts("_ws", "_wn"), _int_avg_of_parts("_os", "_on"),
            mean_of_parts("_ds", "_dn", "decimal(14,2)", "decimal(8,6)"),
        ]
    else:
        rows = with_product(star.fact, star, "Category")
        aggs = [int_avg(with_disc), int_avg(without_disc), F.avg(disc)]
    names = ["Avg_Sales_With_Discount", "Avg_Sales_Without_Discount", "Avg_Discount_Percent"]
    return rows.groupBy("Category").agg(*[a.alias(n) for a, n in zip(aggs, names)]).orderBy("Category")
