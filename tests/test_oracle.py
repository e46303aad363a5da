"""Every registered query against its independent DuckDB SQL, value for value."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_mod
from shelfwise import ANALYSES
from tests.conftest import TESTDATA

SF_DIR = os.environ.get("ORACLE_SF_DIR", f"{TESTDATA}/sf0.01")
RAW = ["region", "nation", "part", "supplier", "lineitem"]


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if hasattr(v, "isoformat"):
        return v.isoformat()[:10]
    return repr(v)


def _rows(cols, records):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in records)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in RAW:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_DIR}/{t}.parquet')")
    yield con
    con.close()


# The optional training-data queries have tests of their own.
KEYS = sorted([*ANALYSES, "star_integrity"])


def test_every_query_has_an_oracle():
    assert set(KEYS) <= set(entry_mod.queries())
    assert set(KEYS) <= set(entry_mod.oracle_sql())


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, duck, key):
    df = entry_mod.queries()[key](spark, SF_DIR)
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    res = duck.execute(entry_mod.oracle_sql()[key])
    cols = [d[0] for d in res.description]
    expected = _rows(cols, res.fetchall())
    assert sorted(df.columns) == sorted(cols)
    assert len(got) == len(expected)
    assert got == expected


def test_entry_smoke(spark):
    df = entry_mod.entry(spark)
    first = df.schema
    assert df.count() >= 0
    assert entry_mod.entry(spark).schema == first


# The order that each analysis returns its rows in, over its output columns. Where the analysis sorts by an
# unrounded value that it does not return, the order is that of the rounded one and ends there.
PRIORITY = """CASE Action_Required WHEN 'URGENT_RESTOCK' THEN 1 WHEN 'INCREASE_STOCK' THEN 2
              WHEN 'REDUCE_STOCK' THEN 3 WHEN 'CONSIDER_DISCONTINUE' THEN 4 ELSE 5 END"""
ORDERS = {
    "q01_stock_status_current": ["Region", "Category", "Current_Stock", "Store_ID", "Product_ID"],
    "q02_stock_by_region_category": ["Region", "Total_Stock_Units DESC", "Category"],
    "q03_latest_stock_by_location": ["Region", "Category", "Current_Stock_Level DESC", "Store_ID", "Product_ID"],
    "q04_low_days_of_supply": ["Days_of_Supply", "Product_ID", "Region"],
    "q06_obsolete_stock": ["Obsolete_Value DESC", "Product_ID"],
    "q07_reorder_point": ["Avg_Daily_Sales DESC", "Product_ID", "Store_ID"],
    "q09_days_on_hand": ["Avg_Days_of_Inventory_on_Hand"],
    "q11_month_end_inventory_value": ["Year", "Month"],
    "q12_turnover_by_region_category": ["Inventory_Turnover_Ratio DESC"],
    "q14_revenue_by_region_category": ["Region", "Total_Revenue DESC", "Category"],
    "q16_holiday_promotion_impact": ["Day_Type", "Total_Revenue DESC", "Category"],
    "q17_forecast_mape": ["MAPE DESC"],
    "q18_forecast_unit_variance": ["abs(Unit_Variance) DESC", "Category", "Region"],
    "q19_discount_impact": ["Category"],
    "q21_abc_product_report": ["Revenue_90_Days DESC"],
    "q22_abc_summary": ["ABC_Class"],
    "q23_product_affinity": ["Times_Sold_Together DESC"],
    "q24_regional_efficiency": ["Inventory_Turnover_Rate DESC", "Region"],
    "q25_action_plan": [PRIORITY, "Number_of_Items DESC", "Category", "Region"],
    "q26_supplier_scorecard": ["Revenue_Generated DESC", "Supplier_Category"],
}


@pytest.mark.parametrize("key", sorted(ORDERS))
def test_rows_come_in_the_order_of_the_oracle(spark, duck, key):
    import pandas as pd

    frame = entry_mod.queries()[key](spark, SF_DIR)
    got = pd.DataFrame([tuple(r) for r in frame.collect()], columns=frame.columns)
    duck.register("got", got.assign(_pos=range(len(got))))
    terms = [t.removesuffix(" DESC") for t in ORDERS[key]]
    order = ", ".join(t + (" NULLS LAST" if t.endswith(" DESC") else " NULLS FIRST") for t in ORDERS[key])
    ours = duck.execute(f"SELECT {', '.join(terms)} FROM got ORDER BY _pos").fetchall()
    want = duck.execute(f"SELECT {', '.join(terms)} FROM ({entry_mod.oracle_sql()[key]}) ORDER BY {order}").fetchall()
    duck.unregister("got")
    assert ours == want
