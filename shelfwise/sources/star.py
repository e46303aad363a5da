"""The star schema: one periodic-snapshot fact and three dimensions."""

from __future__ import annotations

import datetime as dt
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.sources import schema
from shelfwise.sources.staging import Stage

GRAIN = ("Date_SK", "Store_SK", "Product_SK")
PAIR = ("Store_SK", "Product_SK")


@dataclass(frozen=True)
class Star:
    """``Fact_Inventory_Sales`` with ``Dim_Store``, ``Dim_Product`` and ``Dim_Date``."""

    fact: DataFrame
    store: DataFrame
    product: DataFrame
    date: DataFrame
    # The owner of the star's tables, if it was staged, and of what analyses stage for it.
    stage: Stage | None = None
    # Whether values from the calendar stay scalar subqueries (see ``deferred``).
    lazy: bool = False

    @property
    def spark(self) -> SparkSession:
        return self.fact.sparkSession

    @cached_property
    def last_day(self) -> dt.date | None:
        """``MAX(Date)`` of the calendar, resolved once per star (one small job on the date dimension)."""
        return self.date.agg(F.max("Date")).first()[0]

    @cached_property
    def resolved(self) -> dict:
        """Scalars derived from the calendar (e.g. a window's first date key), kept per star."""
        return {}

    def deferred(self) -> Star:
        """The star with its calendar's scalars left in the plans, so that building an analysis runs no job.

        The reference day and the bounds of a window are then scalar subqueries,
        which Spark computes when the query runs and hands to the scan. By
        default they are resolved once per star by small jobs on the calendar
        and are literals in every plan: each query then starts without them.
        """
        return replace(self, lazy=True)

    @cached_property
    def staged(self) -> Stage:
        """Where analyses stage their tables: the star's own stage, or one made on first use."""
        return self.stage or Stage(self.spark)

    def close(self) -> None:
        """Drop the tables that belong to the star: its own, if it was staged, and what analyses staged for it."""
        if self.stage or "staged" in self.__dict__:
            self.staged.close()

    def __enter__(self) -> Star:
        return self

    def __exit__(self, *exc) -> None:
        self.close()

    def as_of(self, as_of: dt.date | str | Column | None = None) -> Column:
        """The reference date of an analysis: given, or the last calendar day.

        The default is a literal, resolved once per star, or with a deferred
        star the scalar subquery ``(SELECT MAX(Date) FROM Dim_Date)``.
        """
        if as_of is None:
            return self.date.agg(F.max("Date")).scalar() if self.lazy else F.lit(self.last_day)
        if isinstance(as_of, Column):
            return as_of
        return F.lit(as_of).cast("date")

    def collated(self, collation: str = "UTF8_LCASE") -> Star:
        """The star with its dimensions' text compared by ``collation``, e.g. without regard to case.

        Comparisons, grouping, distinct counts and joins on ids, regions and
        categories then follow it in every analysis, as under the original's
        default collation. Of spellings that are equal, a group shows one.
        """

        def text(df: DataFrame) -> DataFrame:
            kinds = {f.name: isinstance(f.dataType, T.StringType) for f in df.schema}
            return df.select(*[F.collate(c, collation).alias(c) if is_text else c for c, is_text in kinds.items()])

        return replace(self, store=text(self.store), product=text(self.product))

    def tables(self) -> dict[str, DataFrame]:
        return {"fact": self.fact, "store": self.store, "product": self.product, "date": self.date}


def read_star(spark: SparkSession, path: str, collation: str | None = None) -> Star:
    """Read a star written by :func:`write_star` (explicit schemas, no inference).

    ``collation`` (e.g. ``UTF8_LCASE``) says how ids, regions and categories
    compare; without it they compare byte for byte.
    """
    frames = {  # a partition column is read back last; keep the declared order
        name: spark.read.schema(struct).parquet(f"{path}/{name}").select(*struct.fieldNames())
        for name, struct in schema.TABLES.items()
    }
    star = Star(**frames)
    return star.collated(collation) if collation else star


def write_star(
    star: Star,
    path: str,
    fact_files: int | None = None,
    partition_by: str | None = None,
    max_rows_per_file: int = 8_000_000,
) -> Star:
    """Write the four tables as Parquet under ``path`` and return them re-read.

    The fact is range-partitioned on the grain (Date_SK, Store_SK, Product_SK)
    and sorted inside each file, so every file covers a contiguous run of days:
    the trailing-window analyses then skip files and row groups through Parquet
    min/max statistics. The grain is unique, so even a single very large day
    (or day and store) is split evenly over several files.
    ``partition_by="Date_SK"`` additionally writes one directory per day, which
    lets Spark prune whole directories at scale. ``fact_files`` is the number of
    range partitions (default: what adaptive execution makes of the fact's size,
    at most the shuffle partitions); each of them is cut
    into files of at most ``max_rows_per_file`` rows, so file sizes stay
    bounded however large the fact is.
    """
    spark = star.spark
    fact = star.fact.select(*schema.FACT.fieldNames())
    dealt = fact.repartitionByRange(fact_files, *GRAIN) if fact_files else fact.repartitionByRange(*GRAIN)
    fact = dealt.sortWithinPartitions(*GRAIN)
    writer = fact.write.mode("overwrite").option("maxRecordsPerFile", max_rows_per_file)
    if partition_by:
        writer = writer.partitionBy(partition_by)

    def write_dimension(name: str) -> None:
        frame = getattr(star, name).select(*schema.TABLES[name].fieldNames())
        frame.write.mode("overwrite").parquet(f"{path}/{name}")

    # The four writes are independent jobs; submitted together they share the cluster.
    with ThreadPoolExecutor(max_workers=4) as pool:
        jobs = [pool.submit(writer.parquet, f"{path}/fact")]
        jobs += [pool.submit(write_dimension, name) for name in ("store", "product", "date")]
        for job in jobs:
            job.result()
    return read_star(spark, path)


def stage_star(
    star: Star, stage: Stage | None = None, buckets: int = 0, max_rows_per_file: int = 8_000_000
) -> Star:
    """The star as tables of ``stage`` (a new one if not given), which the returned star owns.

    Without ``buckets`` the fact is range-partitioned and sorted on the grain,
    as :func:`write_star` does: best where analyses read a window of days.
    With ``buckets`` it is bucketed by store and product and sorted by day in
    every bucket: analyses over the whole history that group by store and
    product (q03-q06, q09-q12) then aggregate without shuffling the fact, and a
    window of days still skips row groups. A bucket should hold about what a
    task can aggregate: the fact's size over a few hundred MB.
    """
    stage = stage or Stage(star.spark)
    fact = star.fact.select(*schema.FACT.fieldNames())

    def write(name: str) -> DataFrame:
        if name != "fact":
            return stage.replace(name, getattr(star, name).select(*schema.TABLES[name].fieldNames()))
        if buckets:
            dealt = fact.repartition(buckets, *PAIR)
            return stage.replace(
                name, dealt, bucket_by=PAIR, buckets=buckets, sort_by=GRAIN, max_rows_per_file=max_rows_per_file
            )
        dealt = fact.repartitionByRange(*GRAIN).sortWithinPartitions(*GRAIN)
        return stage.replace(name, dealt, max_rows_per_file=max_rows_per_file)

    # The four writes are independent jobs; submitted together they share the cluster.
    with ThreadPoolExecutor(max_workers=4) as pool:
        tables = dict(zip(schema.TABLES, pool.map(write, schema.TABLES)))
    return Star(**tables, stage=stage)


def validate(star: Star) -> DataFrame:
    """Integrity report: one row per check with the number of violations.

    Checks: duplicate grain rows in the fact, duplicate surrogate keys in each
    dimension, and fact keys without a dimension row (orphans). All counts come
    from one count per grain key, so the fact is read once; nothing is collected.
    """
    per_key = star.fact.groupBy(*GRAIN).count()
    tests = {"fact_grain_duplicates": F.col("count") > 1}
    checks = []
    for name, key in (("store", "Store_SK"), ("product", "Product_SK"), ("date", "Date_SK")):
        dim = getattr(star, name)
        dups = dim.groupBy(key).count().filter(F.col("count") > 1)
        checks.append(dups.select(F.lit(f"{name}_key_duplicates").alias("check"), F.col("count")))
        known = dim.select(key).distinct().withColumn(f"_has_{name}", F.lit(True))
        per_key = per_key.join(known, key, "left")
        tests[f"fact_orphan_{key}"] = F.col(f"_has_{name}").isNull()
    sums = per_key.agg(*[F.sum(F.when(test, F.col("count"))).alias(check) for check, test in tests.items()])
    checks.append(sums.unpivot([], list(tests), "check", "count"))

    found = checks[0]
    for extra in checks[1:]:
        found = found.unionByName(extra)
    found = found.groupBy("check").agg(F.sum("count").alias("violations"))
    names = [c for c in ("fact_grain_duplicates", "store_key_duplicates", "fact_orphan_Store_SK",
                         "product_key_duplicates", "fact_orphan_Product_SK",
                         "date_key_duplicates", "fact_orphan_Date_SK")]
    all_checks = star.spark.createDataFrame([(n,) for n in names], "check string")
    return (
        all_checks.join(found, "check", "left")
        .select("check", F.coalesce("violations", F.lit(0)).cast("long").alias("violations"))
        .orderBy("check")
    )
