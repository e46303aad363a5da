"""Operator 1: exact top-k search by distributed histogram selection.

Scores are integer inner products, so the k-th best score of a query is a whole
number that can be found by narrowing an interval:

1. every query starts with the interval that the norms allow;
2. all candidates are scored, and each block of candidates reports, per query,
   how many of its scores fall above the interval and into each of ``bins``
   equal parts of it. Summed over blocks this is a global histogram, and the
   part that holds the k-th best score is the next interval;
3. after as many rounds as the interval needs to shrink to one value, every
   query knows its exact threshold. A last pass keeps the scores above it, and
   of those equal to it the ones with the smallest ids.

A block's own k-th best score bounds the global one from below, so a block
needs to report only its best parts up to k scores; the histograms stay at k
rows per query and block, and the last pass at k rows per query and block,
also when a third of all vectors are copies that tie.

Work is dealt out as pairs of a block of queries and a block of candidates:
both sides are packed into blocks of bounded size and meet on an equi-join of
block numbers. Scores are never stored; each round computes them again.

Defined results: vectors that are null, hold a null or a non-finite component,
or have another length than most take no part; nor do those with a null id, which
results could not name; repeated rows and rows that share an id count as
one vector, the smallest; ties go to the smaller id; with fewer than k
candidates all are returned; empty tables give no rows; other columns are not
read. Components must scale to below 2**25, so that products add up exactly in
doubles for up to 8 thousand dimensions; larger ones raise an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm.common import keep

BLOCK = 2048  # vectors per block
BINS = 512
LARGEST = float(1 << 25)


def integer_vectors(embeddings: DataFrame, scale: int = 256, id_column: str = "vec_id") -> DataFrame:
    """``id, vector``: one usable vector per id, components ``floor(scale * x)`` as doubles."""
    parts = F.transform(F.col("embedding"), lambda x: F.floor(x.cast("double") * scale).cast("double"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    usable = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & finite
    rows = embeddings.filter(usable).select(F.col(id_column).cast("long").alias("id"), parts.alias("vector"))
    return rows.filter("id is not null").groupBy("id").agg(F.min("vector").alias("vector"))


def _pack(vectors: DataFrame, blocks: int, prefix: str) -> DataFrame:
    """Blocks of vectors as rows: ``<prefix>_block, <prefix>_ids, <prefix>_data`` (packed numbers)."""

    def pack(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("id")
        data = np.stack(block["vector"].to_numpy()).astype("<f8")
        return pd.DataFrame({
            f"{prefix}_block": [block["block"].iloc[0]],
            f"{prefix}_ids": [block["id"].to_numpy().astype("<i8").tobytes()],
            f"{prefix}_data": [data.tobytes()],
        })

    dealt = vectors.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    return dealt.groupBy("block").applyInPandas(
        pack, f"{prefix}_block int, {prefix}_ids binary, {prefix}_data binary"
    )


def _block_pairs(queries: DataFrame, q_blocks: int, candidates: DataFrame, c_blocks: int) -> DataFrame:
    """Each block of queries beside each block of candidates (a stated query set, in blocks)."""
    q = queries.withColumn("c_block", F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1))))
    c = candidates.withColumn("q_block", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
    return q.join(c.hint("merge"), ["q_block", "c_block"])


def _scores(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of queries and candidates, and scores by (query, candidate); a query's own id scores -inf."""
    q_ids, c_ids = np.frombuffer(row.q_ids, "<i8"), np.frombuffer(row.c_ids, "<i8")
    q = np.frombuffer(row.q_data, "<f8").reshape(len(q_ids), -1)
    c = np.frombuffer(row.c_data, "<f8").reshape(len(c_ids), -1)
    scores = q @ c.T
    at = np.searchsorted(c_ids, q_ids)
    own = np.flatnonzero((at < len(c_ids)) & (c_ids[np.minimum(at, len(c_ids) - 1)] == q_ids))
    scores[own, at[own]] = -np.inf
    return q_ids, c_ids, scores


def _histograms(k: int, bins: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Rows ``query_id, bin, n``: counts of scores by part of the query's interval, ``bins`` for those above."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                q_ids, _, scores = _scores(row)
                low, width = (np.frombuffer(x, "<f8")[:, None] for x in (row.low, row.width))
                best = -np.partition(-scores, min(k, scores.shape[1]) - 1, axis=1)[:, :k]
                part = np.minimum(np.floor((best - low) / width), bins)
                kept = np.isfinite(best) & (part >= 0)
                pairs = pd.DataFrame({
                    "query_id": np.repeat(q_ids, kept.sum(axis=1)), "bin": part[kept].astype(np.int64),
                })
                yield pairs.groupby(["query_id", "bin"]).size().reset_index(name="n")

    return run


def _selected(k: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Rows ``query_id, vec_id, score``: scores that reach the query's threshold, at most k per query and block."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                q_ids, c_ids, scores = _scores(row)
                low = np.frombuffer(row.low, "<f8")[:, None]
                at_q, at_c = np.nonzero(np.isfinite(scores) & (scores >= low))
                found = pd.DataFrame({
                    "query_id": q_ids[at_q], "vec_id": c_ids[at_c], "score": scores[at_q, at_c].astype(np.int64),
                })
                # Candidates are sorted by id, so of equal scores the first k have the smallest ids.
                found = found.sort_values(["query_id", "score"], ascending=[True, False], kind="stable")
                yield found.groupby("query_id").head(k)

    return run


def _pack_intervals(intervals: DataFrame, queries: DataFrame) -> DataFrame:
    """The packed queries with the low ends and widths of their intervals, in the order of their ids."""

    def pack(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("query_id")
        return pd.DataFrame({
            "q_block": [block["q_block"].iloc[0]],
            "low": [block["low"].to_numpy("<f8").tobytes()],
            "width": [block["width"].to_numpy("<f8").tobytes()],
        })

    packed = intervals.groupBy("q_block").applyInPandas(pack, "q_block int, low binary, width binary")
    return queries.join(packed, "q_block")


def top_k(
    embeddings: DataFrame,
    is_query: Column,
    k: int = 5,
    scale: int = 256,
    bins: int = BINS,
    block: int = BLOCK,
    scratch: str | None = None,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best other vectors of every query.

    ``embeddings (vec_id, embedding)`` holds queries and candidates; ``is_query``
    is a condition on ``id``.
    """
    spark = embeddings.sparkSession
    vectors = keep(integer_vectors(embeddings, scale), "vectors", scratch)
    # Only vectors of one length can be multiplied; the most frequent length is the table's.
    lengths = vectors.groupBy(F.size("vector").alias("d")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(is_query).alias("queries"),
        F.max(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)).alias("norm2"),
        F.max(F.array_max(F.transform("vector", F.abs))).alias("largest"),
    )
    common = lengths.orderBy(F.desc("n"), "d").limit(1).collect()
    if not common or not common[0]["queries"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dimension, n, n_queries = common[0]["d"], common[0]["n"], common[0]["queries"]
    if common[0]["largest"] >= LARGEST:
        raise ValueError("scaled components of 2**25 or more: their products do not add up exactly in doubles")
    vectors = vectors.filter(F.size("vector") == dimension)
    c_blocks, q_blocks = -(-n // block), -(-n_queries // block)
    candidates = keep(_pack(vectors, c_blocks, "c"), "candidates", scratch)
    queries = keep(_pack(vectors.filter(is_query), q_blocks, "q"), "queries", scratch)

    # By Cauchy-Schwarz no score is outside [-bound, bound].
    bound = float(np.ceil(common[0]["norm2"])) + 1
    intervals = vectors.filter(is_query).select(
        F.col("id").alias("query_id"),
        F.pmod(F.xxhash64("id"), F.lit(q_blocks)).cast("int").alias("q_block"),
        F.lit(-bound).alias("low"),
        F.lit(float(np.ceil((2 * bound + 1) / bins))).alias("width"),
    )
    width = float(np.ceil((2 * bound + 1) / bins))
    while True:
        pairs = _block_pairs(_pack_intervals(intervals, queries), q_blocks, candidates, c_blocks)
        histogram = pairs.mapInPandas(_histograms(k, bins), "query_id long, bin long, n long")
        counts = histogram.groupBy("query_id", "bin").agg(F.sum("n").alias("n"))
        # The part that holds the k-th best score: walk down from the best part until k scores are counted.
        parts = counts.groupBy("query_id").agg(
            F.reverse(F.sort_array(F.collect_list(F.struct("bin", "n")))).alias("parts")  # at most bins + 1
        )
        walk = F.aggregate(
            "parts",
            F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("bin")),
            lambda s, p: F.when(s["n"] >= k, s).otherwise(
                F.struct((s["n"] + p["n"]).alias("n"), p["bin"].alias("bin"))
            ),
            lambda s: F.when(s["n"] >= k, s["bin"]).otherwise(F.lit(0)),  # fewer than k candidates: all of them
        )
        narrower = max(1.0, float(np.ceil(width / bins)))
        found = parts.select("query_id", walk.alias("bin"))
        intervals = keep(
            intervals.join(found, "query_id", "left").select(
                "query_id",
                "q_block",
                (F.col("low") + F.coalesce(F.col("bin"), F.lit(0)) * F.col("width")).alias("low"),
                F.lit(narrower).alias("width"),
            ),
            "intervals",
            scratch,
        )
        if width == 1.0:
            break
        width = narrower
    pairs = _block_pairs(_pack_intervals(intervals, queries), q_blocks, candidates, c_blocks)
    selected = pairs.mapInPandas(_selected(k), "query_id long, vec_id long, score long")
    # At most k rows per query and block; Spark limits each task's rows per query before the shuffle, too.
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return selected.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
