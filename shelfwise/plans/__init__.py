"""The 26 analyses, one function each, keyed by a stable name."""

from shelfwise.plans.actions import action_plan
from shelfwise.plans.advanced import (
    abc_classification,
    abc_product_report,
    abc_reports,
    abc_summary,
    abc_table,
    product_affinity,
    regional_efficiency,
)
from shelfwise.plans.efficiency import (
    days_on_hand,
    inventory_turnover,
    month_end_inventory_value,
    turnover_by_region_category,
    working_capital,
)
from shelfwise.plans.forecast import (
    demand_trend_forecast,
    discount_impact,
    forecast_mape,
    forecast_unit_variance,
    holiday_promotion_impact,
)
from shelfwise.plans.reorder import reorder_point
from shelfwise.plans.sales import revenue_by_region_category, sales_velocity
from shelfwise.plans.stock import (
    inventory_value,
    latest_stock_by_location,
    low_days_of_supply,
    obsolete_stock,
    stock_by_region_category,
    stock_status_current,
)
from shelfwise.plans.supplier import supplier_scorecard

# Analyses that take only a Star (Q20-Q22 share one written classification; see abc_table).
ANALYSES = {
    "q01_stock_status_current": stock_status_current,
    "q02_stock_by_region_category": stock_by_region_category,
    "q03_latest_stock_by_location": latest_stock_by_location,
    "q04_low_days_of_supply": low_days_of_supply,
    "q05_inventory_value": inventory_value,
    "q06_obsolete_stock": obsolete_stock,
    "q07_reorder_point": reorder_point,
    "q08_inventory_turnover": inventory_turnover,
    "q09_days_on_hand": days_on_hand,
    "q10_working_capital": working_capital,
    "q11_month_end_inventory_value": month_end_inventory_value,
    "q12_turnover_by_region_category": turnover_by_region_category,
    "q13_sales_velocity": sales_velocity,
    "q14_revenue_by_region_category": revenue_by_region_category,
    "q15_demand_trend_forecast": demand_trend_forecast,
    "q16_holiday_promotion_impact": holiday_promotion_impact,
    "q17_forecast_mape": forecast_mape,
    "q18_forecast_unit_variance": forecast_unit_variance,
    "q19_discount_impact": discount_impact,
    "q20_abc_classification": abc_table,
    "q21_abc_product_report": lambda star, **kw: abc_product_report(abc_table(star, **kw), star),
    "q22_abc_summary": lambda star, **kw: abc_summary(abc_table(star, **kw)),
    "q23_product_affinity": product_affinity,
    "q24_regional_efficiency": regional_efficiency,
    "q25_action_plan": action_plan,
    "q26_supplier_scorecard": supplier_scorecard,
}

__all__ = [
    "ANALYSES",
    "abc_classification",
    "abc_product_report",
    "abc_reports",
    "abc_summary",
    "abc_table",
    "action_plan",
    "days_on_hand",
    "demand_trend_forecast",
    "discount_impact",
    "forecast_mape",
    "forecast_unit_variance",
    "holiday_promotion_impact",
    "inventory_turnover",
    "inventory_value",
    "latest_stock_by_location",
    "low_days_of_supply",
    "month_end_inventory_value",
    "obsolete_stock",
    "product_affinity",
    "regional_efficiency",
    "reorder_point",
    "revenue_by_region_category",
    "sales_velocity",
    "stock_by_region_category",
    "stock_status_current",
    "supplier_scorecard",
    "turnover_by_region_category",
    "working_capital",
]
