"""Operator 9: near-duplicate embeddings by an epsilon grid order join.

For unit vectors, cosine >= c is distance <= eps = sqrt(2 - 2c). A projection
on principal directions never lengthens a distance, so vectors whose
projections are more than eps apart cannot be linked.

1. Projections on the leading principal directions are cut into grid cells of
   width eps; vectors are sorted by their cells (the epsilon grid order) over
   the whole cluster and cut into blocks with bounding boxes.
2. The sorted sequence is joined with itself interval by interval: starting
   with (everything, everything), each pair of intervals is split into pairs of
   sub-intervals, and those whose bounding boxes are more than eps apart are
   dropped, down to pairs of blocks. Intervals and their boxes are tables; each
   level of the recursion is a join.
3. A task recurses further inside its pair of blocks, and compares what is left
   in single precision with a margin, then in double precision.

Equal vectors are one weighted point, and a pair of blocks reports only the
number of links of each vector and a spanning forest of its links, so large
groups of copies or near copies are never written out as pairs. Components come
from the forests.

The principal directions are fitted on a sample of ``SAMPLE`` vectors (those
with the smallest hashes). They decide how much is skipped, never what is found.

Defined results: a vector that is null, zero, or holds a null or non-finite
component links with nothing, and so does one whose length is not the most
frequent one; a row with a null id links with nothing and has a null component;
repeated rows are vectors of their own that share an id and link with each
other; ties do not matter; an empty table gives no rows; other columns are not
read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm.common import keep
from shelfwise.llm.components import connected_components

SAMPLE = 4096
DIRECTIONS = 8
BLOCK = 4096
LEAF = 512  # rows compared in one go
FAN = 8  # sub-intervals of an interval
MARGIN = 1e-5  # of single-precision products of unit vectors, far above their error
SLACK = 1e-9  # on distances of boxes


def principal_directions(vectors: DataFrame, count: int = DIRECTIONS, sample: int = SAMPLE) -> np.ndarray:
    """Leading principal directions, one per row, of a bounded sample of unit vectors."""
    rows = vectors.select("vector").orderBy(F.xxhash64("id"), "id").limit(sample).collect()
    x = np.array([r["vector"] for r in rows], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return np.linalg.svd(x - x.mean(axis=0), full_matrices=False)[2][:count]


def _project(directions: np.ndarray, eps: float):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                x = np.stack(f["vector"].to_numpy()).astype(np.float64)
                y = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ directions.T
                cells = np.floor(y / eps).astype(np.int32)
                yield f.assign(cells=list(cells), place=list(y))

    return run


def _make_blocks(size: int, kind: str):
    """Sorted rows become blocks; a block is named by its partition and its place in it, which sort like the rows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        partition = TaskContext.get().partitionId()
        rest, number = None, 0

        def block(f: pd.DataFrame) -> dict:
            place = np.stack(f["place"].to_numpy())
            return {
                "part": partition, "number": number, "ids": f["id"].to_numpy("<i8").tobytes(),
                "weights": f["weight"].to_numpy("<i8").tobytes(),
                "data": np.stack(f["vector"].to_numpy()).astype(kind).tobytes(),
                "low": place.min(axis=0), "high": place.max(axis=0),
            }

        for frame in frames:
            rest = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            while len(rest) >= size:
                yield pd.DataFrame([block(rest.iloc[:size])])
                rest, number = rest.iloc[size:], number + 1
        if rest is not None and len(rest):
            yield pd.DataFrame([block(rest)])

    return run


def _box_distance(low_a, high_a, low_b, high_b) -> float:
    gap = np.maximum(0, np.maximum(low_b - high_a, low_a - high_b))
    return float(np.sqrt((gap * gap).sum()))


def _join_blocks(cosine: float, kind: str, directions: np.ndarray):
    eps = math.sqrt(max(0.0, 2 - 2 * cosine))

    def unpack(ids, weights, data):
        ids = np.frombuffer(ids, "<i8")
        x = np.frombuffer(data, kind).reshape(len(ids), -1).astype(np.float64)
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        return ids, np.frombuffer(weights, "<i8"), x, unit.astype(np.float32), unit @ directions.T

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for row in f.itertuples(index=False):
                a = unpack(row.ids, row.weights, row.data)
                same = row.a == row.b
                b = a if same else unpack(row.ids_2, row.weights_2, row.data_2)
                yield _links_of(a, b, same, cosine, eps)

    return run


def _links_of(a, b, same: bool, cosine: float, eps: float) -> pd.DataFrame:
    """Weighted link counts and a spanning forest of the links between two blocks.

    Rows ``u, v, n``: ``n`` links of u (v is u), or a forest edge (n 0).
    """
    ids_a, w_a, x_a, unit_a, place_a = a
    ids_b, w_b, x_b, unit_b, place_b = b
    found: list[tuple[np.ndarray, np.ndarray]] = []
    stack = [(0, len(ids_a), 0, len(ids_b))]
    while stack:
        a0, a1, b0, b1 = stack.pop()
        if same and b1 <= a0:
            continue
        pa, pb = place_a[a0:a1], place_b[b0:b1]
        if _box_distance(pa.min(axis=0), pa.max(axis=0), pb.min(axis=0), pb.max(axis=0)) > eps + SLACK:
            continue
        if a1 - a0 > LEAF or b1 - b0 > LEAF:
            am, bm = (a0 + a1) // 2, (b0 + b1) // 2
            halves_a = [(a0, am), (am, a1)] if a1 - a0 > LEAF else [(a0, a1)]
            halves_b = [(b0, bm), (bm, b1)] if b1 - b0 > LEAF else [(b0, b1)]
            stack += [(*x, *y) for x in halves_a for y in halves_b]
            continue
        i, j = np.nonzero(unit_a[a0:a1] @ unit_b[b0:b1].T >= cosine - MARGIN)
        i, j = i + a0, j + b0
        if same:
            i, j = i[i < j], j[i < j]
        if len(i):
            # Double precision decides, a bounded number of pairs at a time.
            for s in range(0, len(i), 1 << 16):
                p, q = i[s : s + (1 << 16)], j[s : s + (1 << 16)]
                dot = np.einsum("ij,ij->i", x_a[p], x_b[q])
                norms = np.linalg.norm(x_a[p], axis=1) * np.linalg.norm(x_b[q], axis=1)
                ok = dot / norms >= cosine
                found.append((p[ok], q[ok]))
    if not any(len(p) for p, _ in found):
        return pd.DataFrame({"u": [], "v": [], "n": []}, dtype="int64")
    i, j = (np.concatenate(side) for side in zip(*found))
    ids = ids_a if same else np.concatenate([ids_a, ids_b])
    shift = 0 if same else len(ids_a)
    n = np.bincount(i, weights=w_b[j], minlength=len(ids)) + np.bincount(j + shift, weights=w_a[i], minlength=len(ids))
    linked = np.flatnonzero(n)
    root = _local_components(i, j + shift, len(ids))
    edges = linked[root[linked] != linked]
    return pd.DataFrame({
        "u": np.concatenate([ids[linked], ids[edges]]),
        "v": np.concatenate([ids[linked], ids[root[edges]]]),
        "n": np.concatenate([n[linked].astype(np.int64), np.zeros(len(edges), np.int64)]),
    })


def _local_components(i: np.ndarray, j: np.ndarray, size: int) -> np.ndarray:
    """Smallest member of each node's component, by repeated minima over the links."""
    root = np.arange(size)
    while len(i):
        low = np.minimum(root[i], root[j])
        np.minimum.at(root, root[i], low)
        np.minimum.at(root, root[j], low)
        while True:
            jumped = root[root]
            if np.array_equal(jumped, root):
                break
            root = jumped
        apart = root[i] != root[j]
        i, j = i[apart], j[apart]
    return root


def _interval_pairs(blocks: DataFrame, n_blocks: int, eps: float) -> DataFrame:
    """Pairs ``a <= b`` of numbered blocks whose boxes are within eps, by recursion over intervals."""
    levels = max(1, math.ceil(math.log(max(n_blocks, 2), FAN)))
    spark = blocks.sparkSession
    pairs = spark.createDataFrame([(0, 0)], "a long, b long")
    for level in range(levels - 1, -1, -1):
        width = FAN**level
        boxes = blocks.groupBy(F.floor(F.col("seq") / width).cast("long").alias("node")).agg(
            *[F.min(F.get("low", F.lit(d))).alias(f"l{d}") for d in range(DIRECTIONS)],
            *[F.max(F.get("high", F.lit(d))).alias(f"h{d}") for d in range(DIRECTIONS)],
        )
        box = F.struct(*[c for c in boxes.columns if c != "node"])
        boxes = boxes.select("node", box.alias("box"))
        children = lambda x: F.explode(F.sequence(F.col(x) * FAN, F.col(x) * FAN + FAN - 1)).alias(x)
        split = pairs.select(children("a"), "b").select("a", children("b")).filter("a <= b")
        both = split.join(boxes.select(F.col("node").alias("a"), F.col("box").alias("x")), "a").join(
            boxes.select(F.col("node").alias("b"), F.col("box").alias("y")), "b"
        )
        gaps = [
            F.greatest(F.lit(0.0), F.col(f"y.l{d}") - F.col(f"x.h{d}"), F.col(f"x.l{d}") - F.col(f"y.h{d}"))
            for d in range(DIRECTIONS)
        ]
        distance = sum((g * g for g in gaps), F.lit(0.0))
        pairs = both.filter(F.coalesce(F.sqrt(distance), F.lit(0.0)) <= eps + SLACK).select("a", "b")
    return pairs


def _usable():
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    nonzero = F.exists("embedding", lambda x: x != 0)
    return F.col("embedding").isNotNull() & F.coalesce(finite & nonzero, F.lit(False)) & F.col("id").isNotNull()


def near_duplicates(
    embeddings: DataFrame, cosine: float = 0.95, block: int = BLOCK, scratch: str | None = None
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``embeddings (vec_id, embedding)``."""
    spark = embeddings.sparkSession
    double = "double" in embeddings.schema["embedding"].dataType.simpleString()
    kind = "<f8" if double else "<f4"
    rows = embeddings.select(F.col("vec_id").cast("long").alias("id"), "embedding")
    usable = rows.filter(_usable())
    classes = keep(
        usable.groupBy(F.col("embedding").alias("vector")).agg(
            F.min("id").alias("id"), F.count(F.lit(1)).alias("weight")
        ),
        "classes",
        scratch,
    )
    sizes = classes.groupBy(F.size("vector").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    common = sizes.orderBy(F.desc("n"), "d").limit(1).collect()
    if not common:
        alone = F.col("id").isNotNull()
        return rows.select(
            F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"),
            alone.alias("kept"),
        )
    points = classes.filter(F.size("vector") == common[0]["d"])
    eps = math.sqrt(max(0.0, 2 - 2 * cosine))
    directions = principal_directions(points)
    directions = np.vstack([directions, np.zeros((DIRECTIONS - len(directions), directions.shape[1]))])

    element = "double" if double else "float"
    projected = points.mapInPandas(
        _project(directions, eps),
        f"vector array<{element}>, id long, weight long, cells array<int>, place array<double>",
    )
    parts = max(1, common[0]["n"] // (4 * block))
    blocks = keep(
        projected.repartitionByRange(parts, "cells", "id")
        .sortWithinPartitions("cells", "id")
        .mapInPandas(
            _make_blocks(block, kind),
            "part int, number int, ids binary, weights binary, data binary, low array<double>, high array<double>",
        ),
        "blocks",
        scratch,
    )
    # One row per block is numbered here, thousands of vectors each.
    numbered = keep(
        blocks.select(
            "part", "number", "low", "high",
            (F.row_number().over(Window.orderBy("part", "number")) - 1).cast("long").alias("seq"),
        ),
        "intervals",
        scratch,
    )
    pairs = _interval_pairs(numbered, numbered.count(), eps)
    data = blocks.join(numbered.select("part", "number", "seq"), ["part", "number"]).select("seq", "ids", "weights", "data")
    other = data.select(F.col("seq").alias("b"), *[F.col(c).alias(f"{c}_2") for c in ("ids", "weights", "data")])
    joined = pairs.join(data.withColumnRenamed("seq", "a"), "a").join(other, "b")
    # A pair of blocks is a large piece of work: deal the pairs out one by one.
    dealt = joined.repartition("a", "b")
    found = keep(dealt.mapInPandas(_join_blocks(cosine, kind, directions), "u long, v long, n long"), "links", scratch)
    component = connected_components(found.filter("n = 0").select("u", "v"), scratch)
    counts = found.filter("n > 0").groupBy("u").agg(F.sum("n").alias("others"))
    described = (
        classes.join(counts, classes["id"] == counts["u"], "left")
        .join(component, F.col("id") == F.col("node"), "left")
        .select(
            "vector",
            (F.coalesce("others", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
            F.coalesce("component", "id").alias("component"),
        )
    )
    marked = rows.withColumn("vector", F.when(_usable(), F.col("embedding")))
    result = marked.join(described, "vector", "left").select(
        F.col("id").alias("vec_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "id").alias("component_id"),
    )
    return result.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
