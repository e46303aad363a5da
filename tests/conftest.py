from __future__ import annotations

import datetime as dt
import os
import sys
from decimal import Decimal

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

from shelfwise.session import build_session  # noqa: E402
from shelfwise.sources import schema  # noqa: E402
from shelfwise.sources.star import Star  # noqa: E402

TESTDATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    session = build_session(master="local[4]", shuffle_partitions=8)
    yield session
    session.stop()


def date_sk(day: dt.date) -> int:
    return day.year * 10000 + day.month * 100 + day.day


class StarBuilder:
    """Hand-made stars for boundary tests: a calendar, two stores, named products."""

    def __init__(self, first: dt.date, last: dt.date):
        self.days = []
        d = first
        while d <= last:
            self.days.append(d)
            d += dt.timedelta(days=1)
        self.stores = [(1, "S1", "EAST"), (2, "S2", "WEST")]
        self.products: list[tuple] = []
        self.facts: list[tuple] = []

    def product(self, sk: int, category: str = "CatA", pid: str | None = None) -> int:
        self.products.append((sk, pid or f"P{sk}", category))
        return sk

    def fact(self, day, store, product, level=10, units=0, price="10.00", forecast="0.00", discount="0.00", promo=0):
        dec = lambda v: None if v is None else Decimal(v)
        self.facts.append(
            (date_sk(day), store, product, level, units, dec(price), dec(forecast), dec(discount), promo)
        )

    def build(self, spark) -> Star:
        dates = [(date_sk(d), d, d.year, d.month) for d in self.days]
        return Star(
            fact=spark.createDataFrame(self.facts, schema.FACT),
            store=spark.createDataFrame(self.stores, schema.STORE),
            product=spark.createDataFrame(self.products, schema.PRODUCT),
            date=spark.createDataFrame(dates, schema.DATE),
        )
