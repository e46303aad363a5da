"""Staged tables by name, stars that own theirs, the bucketed layout, and collated dimensions."""

from __future__ import annotations

import contextlib
import datetime as dt
import io
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from shelfwise import ANALYSES, Stage, derive_star, load_star, plans, read_star, release_stars, stage_star, write_star
from tests.conftest import TESTDATA, StarBuilder


def _plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


def _files(stage: Stage) -> list[str]:
    return [f for _, _, files in os.walk(stage.location.removeprefix("file:")) for f in files if f.endswith(".parquet")]


def _rows(df):
    return sorted(map(str, df.collect()))


# -- tables by name ---------------------------------------------------------------


def test_replace_drop_and_close(spark):
    stage = Stage(spark)
    first = stage.replace("numbers", spark.range(10))
    assert first.count() == 10 and "numbers" in stage and stage.names() == ["numbers"]
    files = _files(stage)
    assert stage.replace("numbers", spark.range(3)).count() == 3
    assert stage.table("numbers").count() == 3
    assert not set(files) & set(_files(stage))  # the version before is gone
    assert spark.sql(f"SELECT count(*) FROM {stage.database}.numbers").first()[0] == 3
    stage.replace("others", spark.range(1))
    stage.drop("numbers")
    stage.drop("numbers")  # if it exists
    assert stage.names() == ["others"] and not spark.catalog.tableExists(f"{stage.database}.numbers")
    stage.close()
    stage.close()
    assert not os.path.exists(stage.location.removeprefix("file:"))
    assert not spark.catalog.databaseExists(stage.database)
    with pytest.raises(ValueError):
        stage.replace("numbers", spark.range(1))


def test_a_write_that_fails_leaves_the_table_as_it_was(spark):
    with Stage(spark) as stage:
        stage.replace("numbers", spark.range(10))
        broken = spark.range(10).select(F.raise_error(F.lit("no")).cast("long").alias("id"))
        with pytest.raises(Exception, match="no"):
            stage.replace("numbers", broken)
        assert stage.table("numbers").count() == 10
        with pytest.raises(ValueError):
            stage.replace("no name", spark.range(1))


def test_a_table_may_be_replaced_from_itself(spark):
    with Stage(spark) as stage:
        stage.replace("numbers", spark.range(10))
        doubled = stage.table("numbers").union(stage.table("numbers"))
        assert stage.replace("numbers", doubled).count() == 20


def test_classification_is_replaced_by_a_second_run_and_gone_at_the_end(spark):
    star = stage_star(derive_star(spark, f"{TESTDATA}/sf0.001"))
    location = star.stage.location.removeprefix("file:")
    first = plans.abc_table(star)
    want, names = _rows(first), star.stage.names()
    assert plans.abc_table(star).inputFiles() == first.inputFiles()  # the same table while it stands
    again = plans.abc_table(star, replace=True)
    assert again.inputFiles() != first.inputFiles() and star.stage.names() == names
    assert _rows(again) == want
    plans.abc_table(star, window_days=30)
    assert len(star.stage.names()) == len(names) + 1
    star.close()
    assert not os.path.exists(location)


def test_classification_follows_an_expression_for_the_day(spark):
    """The day that an expression stands for names the table: the same day reads the same table, another does not."""
    with stage_star(derive_star(spark, f"{TESTDATA}/sf0.001")) as star:
        day = star.last_day
        by_literal = plans.abc_table(star, as_of=day)
        assert plans.abc_table(star, as_of=F.date_add(F.lit(day), 0)).inputFiles() == by_literal.inputFiles()
        assert plans.abc_table(star).inputFiles() == by_literal.inputFiles()
        spark.conf.set("shelfwise.test", "x")
        earlier = plans.abc_table(star, as_of=F.date_sub(F.lit(day), 400))
        assert earlier.inputFiles() != by_literal.inputFiles() and _rows(earlier) != _rows(by_literal)


def test_loaded_stars_are_released(spark):
    star = load_star(spark, f"{TESTDATA}/sf0.001")
    assert load_star(spark, f"{TESTDATA}/sf0.001") is star
    plans.abc_table(star)
    location = star.stage.location.removeprefix("file:")
    assert os.path.exists(location)
    release_stars(spark)
    assert not os.path.exists(location)
    again = load_star(spark, f"{TESTDATA}/sf0.001")  # staged anew
    assert again is not star and again.fact.count() > 0


def test_a_star_read_from_files_stages_for_itself(spark, tmp_path):
    write_star(derive_star(spark, f"{TESTDATA}/sf0.001"), str(tmp_path))
    with read_star(spark, str(tmp_path)) as star:
        assert plans.abc_summary(plans.abc_table(star)).count() > 0
        location = star.staged.location.removeprefix("file:")
        assert os.path.exists(location)
    assert not os.path.exists(location) and os.path.exists(tmp_path / "fact")


# -- bucketed layout --------------------------------------------------------------------

BY_PAIR = [
    "q03_latest_stock_by_location", "q04_low_days_of_supply", "q05_inventory_value", "q06_obsolete_stock",
    "q09_days_on_hand", "q10_working_capital", "q11_month_end_inventory_value", "q12_turnover_by_region_category",
]


@pytest.fixture(scope="module")
def layouts(spark):
    star = derive_star(spark, f"{TESTDATA}/sf0.01")
    plain, bucketed = stage_star(star), stage_star(star, buckets=6)
    yield plain, bucketed
    plain.close()
    bucketed.close()


@pytest.mark.parametrize("key", sorted(ANALYSES))
def test_bucketed_star_gives_the_same_rows(layouts, key):
    args = {"as_of": "2002-05-01"} if key.startswith("q06") else {}
    plain, bucketed = (ANALYSES[key](star, **args) for star in layouts)
    assert _rows(plain) == _rows(bucketed) and plain.schema == bucketed.schema


@pytest.mark.parametrize("key", BY_PAIR)
def test_bucketed_star_aggregates_pairs_without_shuffling_the_fact(layouts, key):
    """No shuffle by store and product: the calendar, a row per day, is broadcast and leaves the buckets as they are."""
    for star, shuffled in zip(layouts, (True, False)):
        text = _plan(ANALYSES[key](star, **({"as_of": "2002-05-01"} if key.startswith("q06") else {})))
        hashed = [line for line in text.splitlines() if "hashpartitioning(" in line]
        pair = [line for line in hashed if "Store_SK#" in line and "Product_SK#" in line]
        assert bool(pair) == shuffled, (key, hashed)
        assert ("Bucketed: true" in text) != shuffled


def test_bucketed_star_still_pushes_the_window_down(layouts):
    for key in ("q07_reorder_point", "q25_action_plan", "q01_stock_status_current"):
        assert "GreaterThanOrEqual(Date_SK," in _plan(ANALYSES[key](layouts[1]))


def test_buckets_are_one_file_each_sorted_by_day(spark, layouts):
    fact = layouts[1].fact.select("Date_SK", "Store_SK", "Product_SK", F.input_file_name().alias("f"))
    pairs = fact.groupBy("Store_SK", "Product_SK").agg(F.count_distinct("f").alias("n"))
    assert pairs.filter("n > 1").count() == 0 and fact.select("f").distinct().count() == 6
    import pyarrow.parquet as pq

    for name in layouts[1].fact.inputFiles():
        days = pq.read_table(name.removeprefix("file://"), columns=["Date_SK"]).column("Date_SK").to_pylist()
        assert days == sorted(days)


# -- comparison without regard to case ------------------------------------------------------


def _mixed_case(spark):
    b = StarBuilder(dt.date(2024, 6, 1), dt.date(2024, 6, 30))
    b.stores = [(1, "S1", "EAST"), (2, "s1", "East"), (3, "S2", "WEST"), (4, "S3", "west")]
    for sk, pid, category in ((1, "P1", "Cata"), (2, "p1", "CATA"), (3, "P2", "catb"), (4, "P3", "Catb"), (5, "P4", None)):
        b.product(sk, category, pid)
    for n in range(8):
        day = dt.date(2024, 6, 30) - dt.timedelta(days=n)
        for store in (1, 2, 3, 4):
            for product in (1, 2, 3, 4, 5):
                b.fact(day, store, product, level=(n * store + product) % 7, units=store + product, price="2.50")
    return b.build(spark)


@pytest.fixture(scope="module")
def cased(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("cased"))
    write_star(_mixed_case(spark), path)
    con = duckdb.connect()
    for name in ("fact", "store", "product", "date"):
        con.execute(f"CREATE TABLE {name}_ AS SELECT * FROM read_parquet('{path}/{name}/*.parquet')")
    con.execute("CREATE TABLE store (Store_SK INT, Store_ID VARCHAR COLLATE NOCASE, Region VARCHAR COLLATE NOCASE)")
    con.execute("CREATE TABLE product (Product_SK BIGINT, Product_ID VARCHAR COLLATE NOCASE, Category VARCHAR COLLATE NOCASE)")
    con.execute("INSERT INTO store SELECT Store_SK, Store_ID, Region FROM store_")
    con.execute("INSERT INTO product SELECT Product_SK, Product_ID, Category FROM product_")
    return read_star(spark, path, collation="UTF8_LCASE"), read_star(spark, path), con


def _lower(rows):
    return sorted(str(tuple(v.lower() if isinstance(v, str) else v for v in r)) for r in rows)


def test_groups_ignore_case(cased):
    star, _, con = cased
    got = plans.revenue_by_region_category(star).select("Region", "Category", "Total_Units_Sold").collect()
    want = con.execute(
        "SELECT Region, Category, CAST(sum(Units_Sold) AS BIGINT) FROM fact_ JOIN store USING (Store_SK) "
        "JOIN product USING (Product_SK) GROUP BY Region, Category"
    ).fetchall()
    assert _lower(got) == _lower(want) and len(got) == 2 * 3
    got = plans.sales_velocity(star).select("Product_ID", "Category", F.col("Avg_Daily_Sales").cast("double")).collect()
    want = con.execute(
        "SELECT Product_ID, Category, avg(Units_Sold) FROM fact_ JOIN product USING (Product_SK) GROUP BY Product_ID, Category"
    ).fetchall()
    assert _lower(got) == _lower(want) and len(got) == 4


def test_distinct_counts_ignore_case(cased):
    star, binary, con = cased
    got = plans.regional_efficiency(star).select("Region", "Number_of_Stores", "Unique_Products").collect()
    want = con.execute(
        "SELECT Region, count(DISTINCT lower(Store_ID)), count(DISTINCT Product_SK) FROM fact_ JOIN store USING (Store_SK) GROUP BY Region"
    ).fetchall()
    assert _lower(got) == _lower(want) == ["('east', 1, 5)", "('west', 2, 5)"]
    assert plans.regional_efficiency(binary).count() == 4
    got = plans.supplier_scorecard(star).select("Supplier_Category", "Products_Supplied").collect()
    want = con.execute(
        "SELECT Category, count(DISTINCT lower(Product_ID)) FROM fact_ JOIN product USING (Product_SK) GROUP BY Category"
    ).fetchall()
    assert _lower(got) == _lower(want)


def test_bundle_type_ignores_case(cased):
    star, binary, con = cased
    pair = ["Product_A", "Product_B", "Times_Sold_Together", "Bundle_Type"]
    want = con.execute(
        """
        WITH pairs AS (
          SELECT a.Product_SK AS x, b.Product_SK AS y, count(*) AS n
          FROM fact_ a JOIN fact_ b ON a.Date_SK = b.Date_SK AND a.Store_SK = b.Store_SK AND a.Product_SK < b.Product_SK
          GROUP BY ALL
        )
        SELECT a.Product_ID, b.Product_ID, n,
          CASE WHEN a.Category != b.Category THEN 'Cross-Category Opportunity' ELSE 'Same Category Bundle' END
        FROM pairs JOIN product a ON x = a.Product_SK JOIN product b ON y = b.Product_SK
        """
    ).fetchall()
    got = plans.product_affinity(star).select(*pair).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    kinds = {(r.Product_A, r.Product_B): r.Bundle_Type for r in got}
    assert kinds["P1", "p1"] == kinds["P2", "P3"] == "Same Category Bundle"
    exact = {(r.Product_A, r.Product_B): r.Bundle_Type for r in plans.product_affinity(binary).collect()}
    assert exact["P1", "p1"] == exact["P2", "P3"] == "Cross-Category Opportunity"


@pytest.mark.parametrize("key", sorted(ANALYSES))
def test_every_analysis_runs_collated_and_agrees_where_case_does_not_matter(spark, key):
    star = load_star(spark, f"{TESTDATA}/sf0.001")
    args = {"as_of": "2002-05-01"} if key.startswith("q06") else {}
    assert _rows(ANALYSES[key](star.collated(), **args)) == _rows(ANALYSES[key](star, **args))
