"""Shared operators: equivalence with their straightforward forms, and T-SQL arithmetic rules."""

from __future__ import annotations

import itertools
import random
from collections import Counter, defaultdict
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from shelfwise.functions import exact_mean, exact_ratio, int_avg
from shelfwise.operators import (
    co_occurrence,
    cumulative_share,
    cumulative_share_single,
    latest_per_key,
    latest_per_key_ranked,
    with_distinct_counts,
)
from shelfwise.operators.latest import day_order
from shelfwise.sources.tpch import derive_star
from tests.conftest import TESTDATA


def _sorted(df):
    return sorted(tuple(r) for r in df.collect())


def test_latest_per_key_matches_row_number(spark):
    star = derive_star(spark, f"{TESTDATA}/sf0.01")
    dated = star.fact.join(star.date.select("Date_SK", "Date"), "Date_SK")
    args = (["Store_SK", "Product_SK"], day_order(), ["Inventory_Level", "Price"])
    assert _sorted(latest_per_key(dated, *args)) == _sorted(latest_per_key_ranked(dated, *args))


def test_cumulative_share_matches_single_window_with_ties(spark):
    rng = random.Random(7)
    rows = [(i, Decimal(rng.choice([5, 5, 5, 3, 10, 20, 20, 1]) * rng.randint(1, 3))) for i in range(600)]
    df = spark.createDataFrame(rows, "sk long, value decimal(12,2)")
    dist = cumulative_share(df, "value", "sk", partitions=7)
    single = cumulative_share_single(df, "value", "sk")
    sized = cumulative_share(df, "value", "sk")  # as many partitions as adaptive execution makes
    cols = ["sk", "value", "rank", "total_count", "grand_total", "running_total"]
    expected = _sorted(single.select(*cols))
    assert _sorted(dist.select(*cols)) == expected
    assert _sorted(sized.select(*cols)) == expected


@pytest.mark.parametrize("block", [4096, 3, 1])
def test_co_occurrence_matches_brute_force(spark, block):
    rng = random.Random(11)
    rows = sorted({(d, s, rng.randint(1, 9)) for d in range(30) for s in range(3) for _ in range(rng.randint(0, 5))})
    rows += rows[:10]  # repeated basket lines count once
    df = spark.createDataFrame(rows, "day int, store int, item int")
    got = {(r.item_a, r.item_b): (r.together, r.distinct_together)
           for r in co_occurrence(df, ["day", "store"], "item", 4, distinct_key="day", block_items=block).collect()}
    baskets = defaultdict(set)
    for d, s, i in rows:
        baskets[(d, s)].add(i)
    together, days = Counter(), defaultdict(set)
    for (d, _s), items in baskets.items():
        for a, b in itertools.combinations(sorted(items), 2):
            together[(a, b)] += 1
            days[(a, b)].add(d)
    expected = {p: (n, len(days[p])) for p, n in together.items() if n >= 4}
    assert got == expected and expected


def test_integer_average_truncates_toward_zero(spark):
    df = spark.createDataFrame([(1, -7), (1, 0), (2, 7), (2, 0), (3, None)], "k int, v int")
    got = {r.k: r.a for r in df.groupBy("k").agg(int_avg("v").alias("a")).collect()}
    assert got == {1: -3, 2: 3, 3: None}


def test_exact_mean_and_ratio(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (1, 2)], "k int, v int")
    (row,) = df.groupBy("k").agg(exact_mean("v").alias("m"), exact_ratio(F.sum("v"), F.lit(0)).alias("z")).collect()
    assert row.m == Decimal("1.666666666666666667") and row.z is None


def test_decimal_rounding_is_half_up_on_exact_values(spark):
    (row,) = spark.range(1).select(
        F.round(F.lit(Decimal("1.025")), 2).alias("a"), F.round(F.lit(Decimal("-2.5")), 0).alias("b")
    ).collect()
    assert row.a == Decimal("1.03") and row.b == Decimal("-3")


def test_affinity_block_path_gives_the_same_top_pairs(spark):
    from shelfwise import load_star, plans

    star = load_star(spark, f"{TESTDATA}/sf0.01")
    default = plans.product_affinity(star).collect()
    blocks = plans.product_affinity(star, block_items=1).collect()
    assert [tuple(r) for r in default] == [tuple(r) for r in blocks] and len(default) == 50


def test_abc_reports_share_one_classification(spark):
    from shelfwise import load_star, plans

    star = load_star(spark, f"{TESTDATA}/sf0.01")
    abc, report, summary = plans.abc_reports(star)
    assert abc.is_cached
    assert report.count() == abc.count()
    assert sum(r.Number_of_Products for r in summary.collect()) == abc.count()
    abc.unpersist()


def test_abc_queries_read_one_written_classification(spark):
    from shelfwise import ANALYSES, load_star

    star = load_star(spark, f"{TESTDATA}/sf0.001")
    keys = ("q20_abc_classification", "q21_abc_product_report", "q22_abc_summary")
    files = [{f for f in ANALYSES[key](star).inputFiles() if "/abc_" in f} for key in keys]
    assert files[0] and files[0] == files[1] == files[2]


def test_day_order_is_lexicographic(spark):
    import datetime as dt

    rows = [(dt.date(1969, 12, 31), -5), (dt.date(1969, 12, 31), 7), (dt.date(1970, 1, 1), -2**31),
            (dt.date(2001, 11, 4), 20011104), (dt.date(2001, 11, 4), 2**31 - 1), (dt.date(2001, 11, 5), 0)]
    df = spark.createDataFrame(rows, "Date date, Date_SK int")
    got = [(r.Date, r.Date_SK) for r in df.orderBy(day_order()).collect()]
    assert got == sorted(rows)


def test_exact_sd_rounding_and_ceiling_match_exact_arithmetic(spark):
    import math
    from fractions import Fraction

    from shelfwise.functions import moment_sums, with_ceil_mean_plus_sd, with_rounded_sample_sd

    rng = random.Random(5)
    groups = [[rng.randint(0, 30) for _ in range(rng.randint(1, 9))] for _ in range(400)]
    groups += [[0, 1, 2], [2, 2, 2], [7], [0, 3], [1, 4, 4, 1], [10, 12, 14, 10, 12, 14]]  # exact sds and ceilings
    rows = [(g, x) for g, values in enumerate(groups) for x in values]
    df = spark.createDataFrame(rows, "g int, x int").repartition(7)
    sums = df.groupBy("g").agg(*moment_sums("x", "_x"))
    sums = with_ceil_mean_plus_sd(with_rounded_sample_sd(sums, "_x", "sd"), "_x", "cap", 7, 2)
    got = {r.g: (r.sd, r.cap) for r in sums.select("g", "sd", "cap").collect()}

    def isqrt_floor(fr: Fraction) -> int:  # floor(sqrt(fr))
        return math.isqrt(fr.numerator * fr.denominator) // fr.denominator

    for g, values in enumerate(groups):
        n, s = len(values), sum(values)
        var = Fraction(n * sum(v * v for v in values) - s * s, n * (n - 1)) if n > 1 else Fraction(0)
        r = 0
        while Fraction((2 * r + 1) ** 2, 4) <= var:  # half up: largest r with (r - 1/2)^2 <= var
            r += 1
        c = math.ceil(Fraction(7 * s, n))
        while not (c - Fraction(7 * s, n) >= 0 and (c - Fraction(7 * s, n)) ** 2 >= 4 * var):
            c += 1
        while c - 1 - Fraction(7 * s, n) >= 0 and (c - 1 - Fraction(7 * s, n)) ** 2 >= 4 * var:
            c -= 1
        assert got[g] == (r, c), (values, got[g], (r, c), isqrt_floor(var))


def test_one_basket_with_most_rows_is_dealt_out_in_blocks(spark):
    items = list(range(300))
    rows = [(1, i) for i in items for _ in range(3)] + [(d, i) for d in range(2, 8) for i in items[:4]]
    df = spark.createDataFrame(rows, "day int, item int")
    got = {(r.item_a, r.item_b): r.together for r in co_occurrence(df, ["day"], "item", 1, block_items=16).collect()}
    assert len(got) == 300 * 299 // 2
    assert got[(0, 3)] == 7 and got[(0, 4)] == 1


def test_support_prunes_before_pairs_and_no_block_holds_a_basket(spark):
    """One basket of 50,000 items: only its frequent items form pairs; unpruned, its blocks stay small."""
    from shelfwise.operators.basket import basket_blocks, distinct_members

    hot = spark.range(50_000).select(F.lit(0).alias("day"), F.col("id").alias("item"))
    others = spark.range(1, 6).crossJoin(spark.range(0, 50_000, 2500).withColumnRenamed("id", "item"))
    df = hot.union(others.select(F.col("id").cast("int"), "item"))
    got = {(r.item_a, r.item_b): r.together for r in co_occurrence(df, ["day"], "item", 5).collect()}
    frequent = list(range(0, 50_000, 2500))
    assert got == {pair: 6 for pair in itertools.combinations(frequent, 2)}

    whole = basket_blocks(distinct_members(hot, ["day"], "item"), ["day"], "item", 2048)
    sizes = whole.groupBy("_i", "_j").count().collect()
    assert len(sizes) == 25 * 26 // 2 and max(r["count"] for r in sizes) < 2 * 2400


def test_co_occurrence_null_items_and_baskets_form_no_pairs(spark):
    rows = [(1, 1), (1, 2), (1, None), (None, 1), (None, 2), (2, 1), (2, 2), (2, None)]
    df = spark.createDataFrame(rows, "day int, item int")
    assert [tuple(r) for r in co_occurrence(df, ["day"], "item", 1).collect()] == [(1, 2, 2)]
    assert co_occurrence(df.filter("false"), ["day"], "item", 1).count() == 0


@pytest.mark.parametrize("spread", [1, 1000, 10**12])
def test_distinct_counts_by_bitmaps(spark, spread):
    rng = random.Random(spread)
    rows = [
        (rng.choice(["a", "b", None]), rng.choice([None, *range(-70, 200)]), rng.choice([None, *range(5)]), rng.randint(0, 9))
        for _ in range(3000)
    ]
    rows = [(g, None if x is None else x * spread, y, v) for g, x, y, v in rows] + [("none", None, None, 1)]
    df = spark.createDataFrame(rows, "g string, x long, y int, v int").repartition(7)
    sums = {"total": (F.sum("v"), F.sum), "top": (F.max("v"), F.max), "n": (F.count(F.lit(1)), F.sum)}
    plain = [F.sum("v").alias("total"), F.max("v").alias("top"), F.count(F.lit(1)).alias("n")]
    one = with_distinct_counts(df, ["g"], {"xs": "x"}, sums)
    two = with_distinct_counts(df, ["g"], {"xs": "x", "ys": "y"}, sums)
    want = df.groupBy("g").agg(F.count_distinct("x").alias("xs"), F.count_distinct("y").alias("ys"), *plain)
    by_text = lambda frame: sorted(map(str, frame.collect()))  # noqa: E731 (groups may be null)
    assert by_text(two) == by_text(want)
    assert by_text(one) == by_text(want.drop("ys"))
    assert two.schema["total"].dataType == want.schema["total"].dataType
    text = two._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in text and "SortAggregate" not in text and "ObjectHashAggregate" not in text


def test_hot_value_is_carried_across_partitions(spark):
    """One value holds half of all rows and spans most of 23 partitions; nulls come last."""
    rng = random.Random(23)
    values = [Decimal(50)] * 600 + [Decimal(rng.randint(1, 100)) for _ in range(550)] + [None] * 50
    rows = list(enumerate(values))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "sk long, value decimal(12,2)")
    shared = cumulative_share(df, "value", "sk", partitions=23)
    single = cumulative_share_single(df, "value", "sk").select(shared.columns)
    assert sorted(map(str, shared.collect())) == sorted(map(str, single.collect()))
    assert shared.schema["running_total"].dataType == single.schema["running_total"].dataType
    text = shared._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in text.splitlines() if "Join" in line]
    assert joins and all("[_part#" in line for line in joins)
    assert all("value#" not in line.split("hashpartitioning")[1] for line in text.splitlines() if "hashpartitioning" in line)


def test_cumulative_share_of_integers_ties_and_nothing(spark):
    rows = [(i, v) for i, v in enumerate([7] * 40 + [3, 3, 9] + [0] * 9 + [-2] * 5)]
    df = spark.createDataFrame(rows, "sk long, value long")
    for n in (1, 4, 11):
        shared = cumulative_share(df, "value", "sk", partitions=n)
        assert _sorted(shared) == _sorted(cumulative_share_single(df, "value", "sk").select(shared.columns))
    assert cumulative_share(df.filter("false"), "value", "sk").count() == 0
