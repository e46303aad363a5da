"""Row order where an analysis sorts by a value that it returns rounded or not at all, and the clock as reference day."""

from __future__ import annotations

import datetime as dt
from fractions import Fraction

import duckdb
import pytest

import __spark_entry__ as entry_mod
from shelfwise import load_star, plans
from tests.conftest import TESTDATA, StarBuilder

SF_DIR = f"{TESTDATA}/sf0.01"


@pytest.fixture(scope="module")
def star(spark):
    return load_star(spark, SF_DIR)


@pytest.fixture(scope="module")
def duck(star):
    con = duckdb.connect()
    for name, frame in star.tables().items():
        files = [f.removeprefix("file://") for f in frame.inputFiles()]
        con.execute(f"CREATE TABLE {name}_ AS SELECT * FROM read_parquet({files})")
    con.execute("""
        CREATE VIEW rows AS SELECT f.*, Region, Store_ID, Product_ID, Category, d.Date, Year, Month
        FROM fact_ f JOIN store_ USING (Store_SK) JOIN product_ USING (Product_SK) JOIN date_ d USING (Date_SK)
    """)
    yield con
    con.close()


@pytest.mark.parametrize("plan", [plans.inventory_value, plans.working_capital])
def test_values_fall(star, duck, plan):
    want = duck.execute("""
        WITH latest AS (
          SELECT Store_SK, Product_SK, Region, Category, arg_max(Inventory_Level * Price, Date) AS v FROM rows GROUP BY ALL
        )
        SELECT Region, Category FROM latest WHERE v > 0 GROUP BY Region, Category ORDER BY sum(v) DESC, Region, Category
    """).fetchall()
    assert [(r.Region, r.Category) for r in plan(star).collect()] == want and len(want) > 10


def test_velocity_falls_within_categories(star, duck):
    found = duck.execute("""
        SELECT Category, Product_ID, CAST(sum(Units_Sold) AS BIGINT), count(Units_Sold) FROM rows GROUP BY ALL
    """).fetchall()
    # The mean is a decimal of six places, rounded half up.
    mean = lambda s, n: (Fraction(s, n) * 10**6 + Fraction(1, 2)).__floor__()
    want = [(c, p) for _, _, c, p in sorted((c, -mean(s, n), c, p) for c, p, s, n in found)]
    assert [(r.Category, r.Product_ID) for r in plans.sales_velocity(star).collect()] == want


def test_turnover_falls_before_rounding(star, duck):
    start = star.last_day - dt.timedelta(days=90)
    found = duck.execute("""
        SELECT Product_ID, Store_ID, CAST(sum(Units_Sold) AS BIGINT), CAST(sum(Inventory_Level) AS BIGINT), count(Inventory_Level)
        FROM rows WHERE Date >= ? GROUP BY ALL HAVING sum(Inventory_Level) > 0
    """, [start]).fetchall()  # fmt: skip
    ratio = lambda u, s, n: Fraction(u, s // n) if s // n > 0 else Fraction(0)
    want = [(p, s) for _, p, s in sorted((-ratio(u, level, n), p, s) for p, s, u, level, n in found)]
    assert [(r.Product_ID, r.Store_ID) for r in plans.inventory_turnover(star).collect()] == want and len(want) > 100


def test_monthly_means_fall_before_rounding(star, duck):
    found = duck.execute("""
        WITH months AS (
          SELECT Product_ID, Store_ID, Year, Month, CAST(sum(Units_Sold) AS BIGINT) AS u
          FROM rows WHERE Date >= CAST(CAST(? AS DATE) - INTERVAL 12 MONTH AS DATE) GROUP BY ALL
        )
        SELECT Product_ID, Store_ID, CAST(sum(u) AS BIGINT), count(*) FROM months GROUP BY ALL HAVING sum(u) > 0
    """, [star.last_day]).fetchall()  # fmt: skip
    want = [(p, s) for _, p, s in sorted((-Fraction(u, n), p, s) for p, s, u, n in found)]
    assert [(r.Product_ID, r.Store_ID) for r in plans.demand_trend_forecast(star).collect()] == want and len(want) > 100


def test_classification_holds_the_order_of_revenue(star, duck):
    want = duck.execute("""
        SELECT Product_SK FROM rows WHERE Units_Sold > 0 AND Date >= ?
        GROUP BY Product_SK ORDER BY sum(Units_Sold * Price) DESC, Product_SK
    """, [star.last_day - dt.timedelta(days=90)]).fetchall()  # fmt: skip
    ranked = plans.abc_classification(star).orderBy("Revenue_Rank").collect()
    assert [(r.Product_SK,) for r in ranked] == want and [r.Revenue_Rank for r in ranked] == list(range(1, len(want) + 1))


def _today_twice(work):
    """What ``work`` gives for a day during which it ran wholly."""
    while True:
        day = dt.date.today()
        found = work(day)
        if dt.date.today() == day:
            return found


def test_obsolete_stock_measures_to_today(spark, star):
    def both(day):
        return plans.obsolete_stock(star).collect(), plans.obsolete_stock(star, as_of=day).collect()

    by_clock, by_day = _today_twice(both)
    assert by_clock == by_day and by_clock
    sql = entry_mod.oracle_sql()["q06_obsolete_stock"]
    assert sql.count("2002-05-01") >= 1
    con = duckdb.connect()
    for t in ("region", "nation", "part", "supplier", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_DIR}/{t}.parquet')")
    want = _today_twice(lambda day: con.execute(sql.replace("2002-05-01", day.isoformat())).fetchall())
    con.close()
    assert sorted(r.Product_ID for r in by_clock) == sorted(w[0] for w in want)


def test_obsolete_stock_by_the_clock_counts_days_to_today(spark):
    def gaps(day):
        b = StarBuilder(day - dt.timedelta(days=400), day)
        for sk, age in ((1, 180), (2, 181), (3, 399)):
            b.product(sk)
            b.fact(day - dt.timedelta(days=age), 1, sk, level=3, units=1)
        return {r.Product_ID: r.Days_Since_Last_Sale for r in plans.obsolete_stock(b.build(spark)).collect()}

    assert _today_twice(gaps) == {"P2": 181, "P3": 399}
