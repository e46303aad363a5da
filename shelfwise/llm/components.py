"""Connected components of a link table, by alternating star contractions.

Links are a table; each round replaces them by fewer, shorter ones (every node
points its neighbours at the smallest id it knows), in joins and grouped minima
only: no node's neighbours are ever gathered. A round is written to the shared
scratch folder, so the lineage stays short and lost executors cost one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import keep


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(links: DataFrame, scratch: str | None = None) -> DataFrame:
    """``node, component`` for every node of ``links (u, v)``; a component is named by its smallest node.

    Self links, repeated links and either direction are fine; nodes without a
    link to another node are not returned.
    """
    turned = links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    stars = keep(turned.distinct(), "links", scratch)
    state = _state(stars)
    while state[0]:
        # Every node sends its larger neighbours to the smallest node it sees, itself included.
        both = stars.union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Every node links itself and its smaller neighbours to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = keep(moved.union(least.select("u", F.col("m").alias("v"))).distinct(), "links", scratch)
        before, state = state, _state(stars)
        if state == before:
            break
    roots = stars.select(F.col("v").alias("node")).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        roots.select("node", F.col("node").alias("component"))
    )
