"""Build the star schema from TPC-H-like tables (lineitem, part, supplier, nation, region).

The mapping (store = supplier nation, product = part name, one fact row per
ship date x store x product) is the fixture convention of this project; stock
level and forecast are synthetic because the source tables hold neither.
"""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.sources.star import Star, stage_star


def _read(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*cols)


def _ship_day(lineitem: DataFrame) -> F.Column:
    """Calendar day of ``l_shipdate``, the same whatever the session time zone.

    Timestamps without a zone are cut to their own date; zone-aware ones (the
    Parquet value is UTC) are cut to their UTC date.
    """
    if isinstance(lineitem.schema["l_shipdate"].dataType, T.TimestampType):
        return F.date_from_unix_date(F.floor(F.unix_seconds(F.col("l_shipdate")) / 86400).cast("int"))
    return F.col("l_shipdate").cast("date")


def _date_sk(day: F.Column) -> F.Column:
    return (F.year(day) * 10000 + F.month(day) * 100 + F.dayofmonth(day)).cast("int")


def derive_star(spark: SparkSession, sf_dir: str) -> Star:
    """Lazy star over the TPC-H-like tables in ``sf_dir`` (nothing runs here)."""
    nation = _read(spark, sf_dir, "nation", "n_nationkey", "n_name", "n_regionkey")
    region = _read(spark, sf_dir, "region", "r_regionkey", "r_name")
    part = _read(spark, sf_dir, "part", "p_partkey", "p_name", "p_retailprice")
    supplier = _read(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey")
    lineitem = _read(
        spark, sf_dir, "lineitem",
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_discount", "l_returnflag", "l_shipdate",
    )

    store = nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.col("n_nationkey").cast("int").alias("Store_SK"),
        F.col("n_name").alias("Store_ID"),
        F.col("r_name").alias("Region"),
    )

    # One product per part name; its surrogate key is the smallest part key.
    product = part.groupBy("p_name").agg(F.min("p_partkey").alias("Product_SK")).select(
        F.col("Product_SK").cast("long").alias("Product_SK"),
        F.col("p_name").alias("Product_ID"),
        F.split_part(F.col("p_name"), F.lit(" "), F.lit(2)).alias("Category"),
    )

    ship_day = _ship_day(lineitem)
    date = (
        lineitem.select(ship_day.alias("Date"))
        .distinct()
        .select(
            _date_sk(F.col("Date")).alias("Date_SK"),
            "Date",
            F.year("Date").alias("Year"),
            F.month("Date").alias("Month"),
        )
    )

    part_sk = part.join(product.select("Product_SK", F.col("Product_ID").alias("p_name")), "p_name").select(
        "p_partkey", "Product_SK", "p_retailprice"
    )
    lines = (
        lineitem.join(part_sk, lineitem.l_partkey == part_sk.p_partkey)
        .join(supplier, lineitem.l_suppkey == supplier.s_suppkey)
        .select(
            _date_sk(ship_day).alias("Date_SK"),
            F.col("s_nationkey").cast("int").alias("Store_SK"),
            "Product_SK",
            "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
            "l_discount", "l_returnflag", F.month(ship_day).alias("ship_month"), "p_retailprice",
        )
    )
    qty = F.col("l_quantity").cast("int")
    stock_hash = (
        F.col("l_orderkey") * 7 + F.col("l_partkey") * 13 + F.col("l_suppkey") * 5 + F.col("l_linenumber") * 31
    ) % 97
    fact = lines.groupBy("Date_SK", "Store_SK", "Product_SK").agg(
        F.max(F.when(stock_hash < 6, 0).otherwise(stock_hash)).cast("int").alias("Inventory_Level"),
        F.sum(F.when(F.col("l_returnflag") == "R", 0).otherwise(qty)).cast("int").alias("Units_Sold"),
        F.max("p_retailprice").cast("decimal(10,2)").alias("Price"),
        F.sum(qty + F.col("l_linenumber") - 4).cast("decimal(10,2)").alias("Demand_Forecast"),
        F.max("l_discount").cast("decimal(4,2)").alias("Discount"),
        F.max(F.when(F.col("ship_month").isin(11, 12), 1).otherwise(0)).cast("int").alias("Holiday_Promotion"),
    )
    # The fact is a group-by on the grain, so the grain is unique by construction.
    return Star(fact=fact, store=store, product=product, date=date)


_CACHE: dict[tuple[str, str], Star] = {}
_LOCK = threading.Lock()


def load_star(spark: SparkSession, sf_dir: str, materialize: bool = True) -> Star:
    """Star for ``sf_dir``; by default staged once per session in the shared scratch folder.

    Staging cuts the lineage (a lost executor re-reads Parquet instead of
    re-running the fact build) and gives the planner file sizes, so the
    broadcast decision for each dimension is a real size check. The tables go
    with ``star.close()`` or :func:`release_stars`; a closed star is staged anew.
    """
    if not materialize:
        return derive_star(spark, sf_dir)
    key = (spark.sparkContext.applicationId, sf_dir)
    with _LOCK:
        star = _CACHE.get(key)
        if star is None or star.stage.closed:
            star = stage_star(derive_star(spark, sf_dir))
            _CACHE[key] = star
    return star


def release_stars(spark: SparkSession) -> None:
    """Close all stars that :func:`load_star` staged in this session, with what analyses staged for them."""
    with _LOCK:
        for key in [k for k in _CACHE if k[0] == spark.sparkContext.applicationId]:
            _CACHE.pop(key).close()
