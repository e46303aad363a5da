"""Item pairs bought in the same basket (simplified market-basket analysis)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.operators.distinct import with_distinct_counts

# Items that a block of a basket holds, about (see co_occurrence).
BLOCK_ITEMS = 256


def distinct_members(baskets: DataFrame, basket_keys: Sequence[str], item: str) -> DataFrame:
    """Distinct ``(basket, item)`` rows, shuffled once by both. Rows with a null are in no pair and are left out."""
    columns = [*basket_keys, item]
    # Each null is named, so that every use of the rows has the same plan and they are shuffled once for all.
    known = reduce(and_, [F.col(c).isNotNull() for c in columns])
    return baskets.select(*columns).filter(known).distinct()


def frequent_members(members: DataFrame, item: str, min_support: int, items: DataFrame | None = None) -> DataFrame:
    """The members whose items lie in at least ``min_support`` baskets.

    A pair is in no more baskets than either of its items, so items below the
    support are in no pair that reaches it (a-priori). The supports, a row per
    item, are joined back by an inner join: Spark would push a semi join below
    the distinct and read the rows a second time.
    """
    support = members.groupBy(item).agg(F.count(F.lit(1)).alias("_baskets")).filter(F.col("_baskets") >= min_support)
    if items is not None:
        support = support.join(items.select(item), item, "left_semi")
    return members.join(support.select(item), item)


def basket_blocks(
    members: DataFrame, basket_keys: Sequence[str], item: str, block_items: int, sized_by: DataFrame | None = None
) -> DataFrame:
    """Each basket's items in pairs of blocks ``_i <= _j``: ``basket keys, item, _block, _i, _j``.

    A basket of ``k`` items has ``ceil(k / block_items)`` blocks and an item's
    hash says in which it is, so a block holds about ``block_items`` items and
    a pair of blocks twice as many; no pair of blocks, and no task, has to hold a
    whole basket. Every item is sent to each pair of blocks with its own. Only
    baskets of more than one block are listed with their sizes, which are those
    of ``sized_by`` if given: sizes before pruning are known a step earlier.
    """
    keys = list(basket_keys)
    counted = members if sized_by is None else sized_by
    sizes = counted.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size")).filter(F.col("_size") > block_items)
    sizes = sizes.select(*keys, F.ceil(F.col("_size") / block_items).cast("int").alias("_blocks"))
    blocks = F.coalesce("_blocks", F.lit(1))
    placed = members.join(sizes, keys, "left").select(
        *keys, item, F.pmod(F.xxhash64(item), blocks).cast("int").alias("_block"), blocks.alias("_blocks")
    )
    met = placed.select("*", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_other"))
    return met.select(
        *keys, item, "_block", F.least("_block", "_other").alias("_i"), F.greatest("_block", "_other").alias("_j")
    )


def _pairs(blocks: DataFrame, keys: list[str], item: str) -> DataFrame:
    """Pairs ``item_a < item_b`` of each basket, each from the one pair of blocks that holds both."""
    place = [*keys, "_i", "_j"]
    # As many partitions as the session has: pairs are many more than the few bytes that their items take, by
    # which adaptive execution would put them into few tasks.
    n = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first = blocks.filter("_block = _i").select(*place, F.col(item).alias("_x")).repartition(n, *place)
    second = blocks.filter("_block = _j").select(*place, F.col(item).alias("_y")).repartition(n, *place)
    met = first.join(second, place).filter((F.col("_i") < F.col("_j")) | (F.col("_x") < F.col("_y")))
    return met.select(*keys, F.least("_x", "_y").alias("item_a"), F.greatest("_x", "_y").alias("item_b"))


def co_occurrence(
    baskets: DataFrame,
    basket_keys: Sequence[str],
    item: str,
    min_support: int,
    distinct_key: str | None = None,
    items: DataFrame | None = None,
    block_items: int = BLOCK_ITEMS,
) -> DataFrame:
    """Pairs ``(item_a < item_b)`` found together in at least ``min_support`` baskets.

    Returns ``item_a, item_b, together`` (baskets holding both) and, when
    ``distinct_key`` is given, ``distinct_together`` (distinct values of that
    basket key among them, e.g. distinct days).

    * ``items`` (optional, one column named ``item``) restricts the items, like
      an inner join to an item dimension would. Null items and baskets with a
      null key form no pairs, as in a join.
    * Items below the support go first (``frequent_members``).
    * The rest of each basket is cut into blocks by the items' hashes, and pairs
      are formed by a join on basket and pair of blocks (``basket_blocks``): a
      hot basket is spread over tasks. The plan is the same for all baskets, and
      every pair of a basket is formed once.
    * Pairs are counted per task first: with ``distinct_key`` (an integer) per
      pair and 64 key values, by bitmaps, else per pair.
    """
    keys = list(basket_keys)
    members = distinct_members(baskets, keys, item)
    frequent = frequent_members(members, item, min_support, items)
    pairs = _pairs(basket_blocks(frequent, keys, item, block_items, sized_by=members), keys, item)
    count = F.count(F.lit(1))
    if distinct_key is None:
        counted = pairs.groupBy("item_a", "item_b").agg(count.alias("together"))
    else:
        counted = with_distinct_counts(
            pairs, ["item_a", "item_b"], {"distinct_together": distinct_key}, {"together": (count, F.sum)}
        ).select("item_a", "item_b", "together", "distinct_together")
    return counted.filter(F.col("together") >= min_support)
