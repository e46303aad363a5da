"""Reusable DataFrame operators shared by the analyses."""

from shelfwise.operators.basket import co_occurrence
from shelfwise.operators.distinct import with_distinct_counts
from shelfwise.operators.dims import with_product, with_store, with_store_product
from shelfwise.operators.latest import day_order, latest_per_key, latest_per_key_ranked
from shelfwise.operators.ranking import cumulative_share, cumulative_share_single
from shelfwise.operators.window import calendar, facts_on_days

__all__ = [
    "calendar",
    "co_occurrence",
    "day_order",
    "cumulative_share",
    "cumulative_share_single",
    "facts_on_days",
    "latest_per_key",
    "latest_per_key_ranked",
    "with_distinct_counts",
    "with_product",
    "with_store",
    "with_store_product",
]
