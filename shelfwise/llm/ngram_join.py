"""Operator 2: n-gram Jaccard join on a forest of count-vector R-trees.

A document is the set of its distinct word n-grams. The n-grams are hashed into
groups, and the numbers per group are a point, the document's count vector. Two
sets share at most the sum of the smaller coordinates of their points, so a
pair whose points are too far apart cannot reach the threshold; the bounding
boxes of blocks of points bound all pairs of two blocks at once. Pairs that
survive are verified on the n-grams themselves.

One tree over everything would compare every document with all others of its
size. The roots of the forest split the points without losing a link: two sets
that reach the threshold differ in at most ``r`` n-grams, where r follows from
the size. The hash space is cut into more than r cells, so at least one cell
holds the same n-grams of both. A root is such a cell with its exact content.
Of two linked documents at most r cells differ, so with the roots in one order
for all documents, each document's first r + 1 have at least one that both have:
a document is entered under those, and its own size and the largest partner's
give r. The order is by the number of n-grams in the cell, largest first, as
unrelated documents meet in cells that hold little but a common passage. (Cells
that are empty prove nothing. The number of cells is chosen so that more than r
are filled; a document for which chance left fewer also enters its empty ones.)

Joining a tree:

1. under each root, the document that shares most with the others is the
   centre, and all others are compared with it. A large group of near copies is
   mostly connected by this, at one comparison per document and root;
2. the points under a root are packed into leaves, in the order of their size
   and coordinates, and leaves are joined with leaves: bounding boxes first,
   then points, on few groups first. Pairs that step 1 already connected need no
   comparison. A group of similar documents meets under many roots; a pair is
   taken under the most crowded root that both are under, as far as the most
   crowded ones of both, which the points carry, show it.

All exact copies of a set are one point, so groups of copies cost nothing. No
pair that could reach the threshold is left out, unless both are in one
component already. The result is the components, not the pairs; ``links``
returns verified links that connect them.

Defined results: words are runs of characters other than ASCII space and
controls 9-13, with A-Z in lower case; a text of fewer words than n is one
n-gram; a null or empty text has the empty set and links with nothing; a null
``doc_id`` links with nothing and keeps a null component; repeated rows and
rows that share an id are one node; an empty table gives no rows; other columns
are not read. Texts are read whole, whatever their length.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import keep, sliced
from shelfwise.llm.components import connected_components

GROWTH = 1.5  # largest size of a level over that of the level below
COARSE = 256  # groups of the points in the trees; pairs that pass are bounded once more on their fine points
BOX = 64  # groups of the boxes of leaves, and of the first bound of a pair
LEAF = 64  # points per leaf
LEAF_PAIRS = 64  # pairs of leaves opened at a time
LOWS = 8  # smallest keys that a point carries, to see whether a pair meets under a smaller key too
CROWD = 1 << 22  # crowds of roots are told apart up to this size
CHUNK = 128  # documents verified beside one centre in one go

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _ODD[1]
    h = (h ^ (h >> np.uint64(29))) * _ODD[0]
    return h ^ (h >> np.uint64(32))


def ngram_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word n-grams."""
    import xxhash

    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII space only
    if not tokens:
        return np.empty(0, dtype=np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), dtype=np.uint64, count=len(tokens))
    size = min(words, len(tokens))
    last = len(tokens) - size + 1
    grams = np.full(last, size, dtype=np.uint64)
    for i in range(size):
        grams = _mix(grams * _ODD[2] + hashes[i : i + last])
    return np.unique(grams)


# -- which roots a document is entered under ----------------------------------


def largest_difference(a: int, b: int, threshold: tuple[int, int]) -> int:
    """Most n-grams that only one of two sets of sizes a and b has, if their Jaccard index reaches the threshold."""
    t, whole = threshold
    return (whole - t) * (a + b) // (whole + t)


@lru_cache(maxsize=None)
def _level(number: int, threshold: tuple[int, int]) -> tuple[int, int, int, int]:
    """Smallest and largest size entered at a level, the differences to survive there, and its cells."""
    below, top = 0, 8
    for _ in range(number):
        below, top = top, max(top + 1, int(top * GROWTH))
    t, whole = threshold
    low = max(1, -(-t * (below + 1) // whole))
    while low < top and largest_difference(low, low * whole // t, threshold) == 0:
        low += 1
    r = largest_difference(top, top, threshold)
    cells = r + 1
    while True:  # cells that a set of the smallest size fills, less four deviations
        load = low / cells
        empty = math.exp(-load)
        filled = cells * (1 - empty) - 4 * math.sqrt(cells * empty * max(0.0, 1 - (1 + load) * empty))
        if filled >= r + 1 or cells >= 4 * top:
            return low, top, r, cells
        cells += max(1, cells // 16)


def _levels(size: int, threshold: tuple[int, int]) -> Iterator[int]:
    """The levels where a set of this size can meet a partner: its own and those of possible larger ones."""
    number = 0
    while True:
        low, top, _, _ = _level(number, threshold)
        if low > size:
            return
        if size <= top:
            yield number
        number += 1


def root_keys(grams: np.ndarray, threshold: tuple[int, int]) -> np.ndarray:
    """Keys (64 bits: chance meetings, which grow with the square of the corpus, stay out) of the roots of a set."""
    out = []
    t, whole = threshold
    size = len(grams)
    if largest_difference(size, size * whole // t, threshold) == 0:
        return np.empty(0, dtype=np.int64)  # too small for any difference
    for number in _levels(size, threshold):
        _, top, r, cells = _level(number, threshold)
        most = largest_difference(size, min(top, size * whole // t), threshold)
        if r == 0 or most == 0:  # only equal sets can be linked here
            continue
        cell = ((grams >> np.uint64(20)) % np.uint64(cells)).astype(np.int64)
        order = np.argsort(cell, kind="stable")
        filled, starts, held = np.unique(cell[order], return_index=True, return_counts=True)
        content = np.add.reduceat(_mix(grams[order]), starts)
        enough = len(filled) > most
        if not enough:
            missing = np.setdiff1d(np.arange(cells), filled)
            filled = np.concatenate([filled, missing])
            content = np.concatenate([content, np.zeros(len(missing), dtype=np.uint64)])
        place = np.array([number + 1], dtype=np.uint64) * _ODD[2] + filled.astype(np.uint64) * _ODD[0]
        keys = _mix(content + place)
        if enough:
            keys = keys[np.lexsort((keys, -held))[: most + 1]]
        out.append(keys.view(np.int64))
    return np.concatenate(out) if out else np.empty(0, dtype=np.int64)


def lowest(keys: np.ndarray) -> bytes:
    """The smallest of a document's keys in the trees, filled up with the largest number there is."""
    out = np.full(LOWS, np.iinfo(np.int64).max, dtype="<i8")
    low = np.sort(keys)[:LOWS]
    out[: len(low)] = low
    return out.tobytes()


# -- points --------------------------------------------------------------------


def count_vector(grams: np.ndarray, groups: int) -> bytes:
    """Numbers of n-grams per group, after a byte with the width of a number; ``groups`` is a power of two."""
    counts = np.bincount((grams & np.uint64(groups - 1)).astype(np.int64), minlength=groups)
    width = _width(counts)
    return bytes([width]) + counts.astype(f"<u{width}").tobytes()


def _width(counts: np.ndarray) -> int:
    """Bytes that hold the largest of ``counts``."""
    most = int(counts.max())
    return 1 if most < 1 << 8 else 2 if most < 1 << 16 else 4


def fine_groups(size: int) -> int:
    """Groups of the fine point of a set: a power of two, about as many as n-grams."""
    return max(BOX, 1 << max(0, size.bit_length() - 1))


def _open_point(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


def _fold(points: np.ndarray, groups: int) -> np.ndarray:
    """Points on fewer groups; powers of two nest."""
    while points.shape[-1] > groups:
        half = points.shape[-1] // 2
        points = points[..., :half] + points[..., half:]
    return points


def shared_at_most(a: bytes, n_a: int, b: bytes, n_b: int) -> int:
    """Bound on the common n-grams of two sets of sizes n_a and n_b from their points."""
    x, y = _open_point(a), _open_point(b)
    groups = min(len(x), len(y))
    return min(n_a, n_b, int(np.minimum(_fold(x, groups), _fold(y, groups)).sum()))


def reaches(shared: np.ndarray | int, a: np.ndarray | int, b: np.ndarray | int, threshold: tuple[int, int]):
    """Whether ``shared`` common n-grams of sets of sizes a and b reach the threshold."""
    t, whole = threshold
    return shared * (whole + t) >= t * (a + b)


def _describe(words: int, threshold: tuple[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            sets = [ngram_set(t, words) for t in batch.column("text").to_pylist()]
            keys = [root_keys(s, threshold) for s in sets]
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(digests, pa.binary()),
                    pa.array([count_vector(s, COARSE) for s in sets], pa.binary()),
                    pa.array([count_vector(s, fine_groups(len(s))) for s in sets], pa.binary()),
                    pa.array(keys, pa.list_(pa.int64())),
                ],
                ["doc_id", "n", "digest", "point", "fine", "keys"],
            )

    return run


# -- roots with more than one document -----------------------------------------


def _shared_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key, those whose key is not alone; one pass, whatever the length of a run."""
    held_key, held_doc, open_key = None, None, None
    names = ["key", "doc"]
    for batch in batches:
        keys = batch.column("key").to_numpy(zero_copy_only=False)
        docs = batch.column("doc").to_numpy(zero_copy_only=False)
        if held_key is not None:
            keys, docs = np.concatenate([[held_key], keys]), np.concatenate([[held_doc], docs])
            held_key = None
        if not len(keys):
            continue
        same = keys[1:] == keys[:-1]
        shared = np.concatenate([same, [False]]) | np.concatenate([[open_key is not None and keys[0] == open_key], same])
        if not shared[-1]:
            held_key, held_doc = keys[-1], docs[-1]
        open_key = int(keys[-1]) if shared[-1] else None
        yield pa.RecordBatch.from_arrays([pa.array(keys[shared], pa.int64()), pa.array(docs[shared], pa.int64())], names)


def _bounded(threshold: tuple[int, int]):
    """Of pairs with their points, those whose summed minima allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = zip(*(batch.column(c).to_pylist() for c in ("n_a", "point_a", "n_b", "point_b")))
            ok = [reaches(shared_at_most(x, a, y, b), a, b, threshold) for a, x, b, y in rows]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


# -- leaves ----------------------------------------------------------------------


TREE = (
    "a long, b long, key long, leaf long, docs binary, components binary, sizes binary, points binary, "
    "lows binary, n_min long, n_max long"
)


def _first_meeting(key: int, lows: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Of pairs that meet under ``key``, with their lowest keys row by row: those not seen to meet under a smaller one.

    A pair that is not connected yet is compared under each key that both have, so the smallest one is enough.
    """
    out = np.empty(len(lows), dtype=bool)
    for i in range(0, len(lows), 4096):
        a, b = lows[i : i + 4096], others[i : i + 4096]
        out[i : i + 4096] = ~((a[:, :, None] == b[:, None, :]) & (a[:, :, None] < key)).any(axis=(1, 2))
    return out


def _pairs_within(key, docs, components, sizes, points, lows, threshold) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of one leaf that are not connected yet, that the summed minima allow and that no smaller key has."""
    i, j = np.triu_indices(len(docs), 1)
    apart = components[i] != components[j]
    i, j = i[apart], j[apart]
    few = _fold(points, BOX)
    ok = reaches(np.minimum(few[i], few[j]).sum(axis=1), sizes[i], sizes[j], threshold)
    i, j = i[ok], j[ok]
    ok = _first_meeting(key, lows[i], lows[j])
    i, j = i[ok], j[ok]
    ok = reaches(np.minimum(points[i], points[j]).sum(axis=1), sizes[i], sizes[j], threshold)
    return docs[i[ok]], docs[j[ok]]


def _trees(threshold: tuple[int, int], size: int):
    """Rows sorted by key, n and point become trees.

    A root with at most ``size`` points is a single leaf and is joined at once:
    rows with ``a, b``. A larger root, or one that may go on in another
    partition, becomes leaves of up to ``size`` points: the other columns.
    """
    columns = [c.split()[0] for c in TREE.split(", ")]
    numbers = {c.split()[0] for c in TREE.split(", ") if c.endswith(" long")}

    def leaf(key, docs, components, sizes, points, lows) -> tuple:
        packed = (x.astype("<i8").tobytes() for x in (docs, components, sizes))
        counts = points.astype(f"<u{_width(points)}").tobytes()
        return (None, None, key, int(docs[0]), *packed, counts, lows.tobytes(), int(sizes.min()), int(sizes.max()))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest, first, cut_key = None, True, None
        for frame in _with_last(frames):
            if frame is not None:
                rest = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            if rest is None or not len(rest):
                continue
            keys = rest["key"].to_numpy()
            docs, components, sizes = (rest[c].to_numpy() for c in ("doc", "component", "n"))
            points = np.stack([_open_point(p) for p in rest["point"]])
            lows = np.frombuffer(b"".join(rest["lows"]), "<i8").reshape(-1, LOWS)
            starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            rows: list[tuple] = []
            found: list[tuple[np.ndarray, np.ndarray]] = []
            done = 0
            for s, e in zip(starts, [*starts[1:], len(keys)]):
                last = e == len(keys)
                if last and frame is not None and e - s <= size:
                    break  # it may go on in the next frame
                part = (docs[s:e], components[s:e], sizes[s:e], points[s:e], lows[s:e])
                if first or last or e - s > size or keys[s] == cut_key:
                    stop = s + (e - s) // size * size if last and frame is not None else e
                    for i in range(s, stop, size):
                        rows.append(leaf(int(keys[s]), *(x[i : min(i + size, stop)] for x in (docs, components, sizes, points, lows))))
                    done, cut_key = stop, keys[s]
                else:
                    found.append(_pairs_within(keys[s], *part, threshold))
                    done = e
                first = False
            rest = rest.iloc[done:]
            if found:
                a, b = (np.concatenate(side) for side in zip(*found))
                rows += [(int(x), int(y), *[None] * (len(columns) - 2)) for x, y in zip(a, b)]
            if rows:
                # Typed one by one: beside nulls, pandas would take whole numbers for doubles and round them.
                out = {c: list(values) for c, values in zip(columns, zip(*rows))}
                yield pd.DataFrame({c: pd.array(v, dtype="Int64") if c in numbers else v for c, v in out.items()})

    return run


def _with_last(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame | None]:
    """The frames, and None after them."""
    yield from frames
    yield None


def _join_leaves(threshold: tuple[int, int]):
    """Pairs of points of two leaves that are not connected yet and that the summed minima allow."""

    def open_leaf(docs, components, sizes, points, lows):
        docs, components, sizes, lows = (np.frombuffer(x, "<i8") for x in (docs, components, sizes, lows))
        width = len(points) // (len(docs) * COARSE)
        points = np.frombuffer(points, f"<u{width}").reshape(len(docs), COARSE).astype(np.int64)
        return docs, components, sizes, points, lows.reshape(len(docs), LOWS)

    def pairs(row: dict) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        one, other = (
            open_leaf(*(row[f"{c}{side}"] for c in ("docs", "components", "sizes", "points", "lows")))
            for side in ("", "_2")
        )
        if row["leaf"] == row["leaf_2"]:
            yield _pairs_within(row["key"], *one, threshold)
            return
        docs_a, of_a, n_a, a, low_a = one
        docs_b, of_b, n_b, b, low_b = other
        few_a, few_b = _fold(a, BOX), _fold(b, BOX)
        box = np.minimum(few_a.max(axis=0), few_b.max(axis=0)).sum()
        if not reaches(int(box), int(n_a.min()), int(n_b.min()), threshold):
            return
        for i in range(len(docs_a)):
            todo = np.flatnonzero(of_b != of_a[i])
            shared = np.minimum(few_b[todo], few_a[i]).sum(axis=1)
            todo = todo[reaches(shared, n_a[i], n_b[todo], threshold)]
            todo = todo[_first_meeting(row["key"], np.broadcast_to(low_a[i], (len(todo), LOWS)), low_b[todo])]
            shared = np.minimum(b[todo], a[i]).sum(axis=1)
            todo = todo[reaches(shared, n_a[i], n_b[todo], threshold)]
            yield np.full(len(todo), docs_a[i]), docs_b[todo]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, LEAF_PAIRS):
            found = [sides for row in batch.to_pylist() for sides in pairs(row)]
            if found:
                a, b = (np.concatenate(side) for side in zip(*found))
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


# -- verification ----------------------------------------------------------------


def _verify(words: int, threshold: tuple[int, int]):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        sets = [ngram_set(t, words) for t in group["text"]]
        centre = np.flatnonzero(group["doc"].to_numpy() == group["a"].to_numpy())
        found = []
        for i, (a, doc) in enumerate(zip(group["a"], group["doc"])):
            for c in centre:
                if doc != a:
                    shared = len(np.intersect1d(sets[i], sets[c], assume_unique=True))
                    if reaches(shared, len(sets[i]), len(sets[c]), threshold):
                        found.append((a, doc))
                        break
        return pd.DataFrame(found, columns=["u", "v"]).astype("int64")

    return run


def verified(
    docs: DataFrame, pairs: DataFrame, words: int, threshold: tuple[int, int], scratch: str | None = None
) -> DataFrame:
    """Links ``u, v`` among ``pairs (a, b)``, decided on the n-grams of ``docs (doc_id, text)``.

    The partners of one document are verified in chunks, so that its text is
    sent once per chunk and no chunk holds more than a bounded number of texts.
    """
    chunks = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("chunks"))
    dealt = pairs.join(chunks, "a").select(
        "a", F.pmod(F.xxhash64("b"), F.col("chunks")).cast("int").alias("chunk"), F.col("b").alias("doc")
    )
    # Written, so that Spark knows its size: only texts that are wanted travel if the list is small enough to be
    # broadcast, and else both sides are shuffled.
    wanted = keep(dealt.union(dealt.select("a", "chunk", F.col("a").alias("doc")).distinct()), "wanted", scratch)
    texts = docs.select(F.col("doc_id").alias("doc"), "text")
    return texts.join(wanted, "doc").groupBy("a", "chunk").applyInPandas(_verify(words, threshold), "u long, v long")


# -- the operator ------------------------------------------------------------------


def _allowed(pairs: DataFrame, points: DataFrame, column: str, threshold: tuple[int, int]) -> DataFrame:
    """Those of ``pairs (a, b)`` that the points ``doc, n, <column>`` allow."""

    def of(x: str) -> DataFrame:
        return points.select(F.col("doc").alias(x), F.col("n").alias(f"n_{x}"), F.col(column).alias(f"point_{x}"))

    with_points = pairs.join(of("b"), "b").join(of("a"), "a")
    return with_points.mapInArrow(_bounded(threshold), "a long, b long").distinct()


def _by_crowd(key: str, crowd: str) -> Column:
    """Keys that sort roots by their crowd, largest first. (Should two roots get one key, they are joined as one.)"""
    return F.pmod(F.col(key), F.lit(1 << 40)) - F.least(F.col(crowd), F.lit(CROWD)) * F.lit(1 << 40)


def _lows(keys: str) -> Column:
    def run(keys: pd.Series) -> pd.Series:
        return keys.map(lowest)

    return F.pandas_udf(run, "binary")(keys)


def links(
    docs: DataFrame, sets: DataFrame, holders: DataFrame, words: int, threshold: tuple[int, int],
    scratch: str | None = None,
) -> DataFrame:
    """Links between different sets that connect all documents the threshold connects.

    ``sets``: from ``_describe`` (a written table); ``holders (doc_id, digest)``:
    the row that stands for each distinct set.
    """
    distinct_sets = sets.join(holders.hint("shuffle_hash"), ["doc_id", "digest"], "left_semi")
    entered = distinct_sets.select(F.explode("keys").alias("key"), F.col("doc_id").alias("doc"))
    # A document has many keys, so even a key that a third of the documents carry is a small part of these
    # rows; its run streams through the task.
    runs = entered.repartition("key").sortWithinPartitions("key")
    shared = keep(runs.mapInArrow(_shared_only, "key long, doc long").distinct(), "roots", scratch)
    points = keep(distinct_sets.select(F.col("doc_id").alias("doc"), "n", "point"), "points", scratch)
    fine = sets.select(F.col("doc_id").alias("doc"), "n", "fine")

    # The centre of a root is the document with the largest sum of neighbours over its roots.
    crowd = shared.groupBy("key").agg(F.count(F.lit(1)).alias("crowd"))
    degree = shared.join(crowd, "key").groupBy("doc").agg(F.sum("crowd").alias("degree"))
    centre = (
        shared.join(degree, "doc")
        .groupBy("key")
        .agg(F.max(F.struct("degree", (-F.col("doc")).alias("doc"))).alias("top"))
        .select("key", (-F.col("top.doc")).alias("a"))
    )
    to_centre = shared.join(centre, "key").filter("a <> doc").select("a", F.col("doc").alias("b")).distinct()
    near = keep(_allowed(to_centre, points, "point", threshold), "centre-pairs", scratch)
    near = keep(_allowed(near, fine, "fine", threshold), "centre-pairs", scratch)
    first = keep(verified(docs, near, words, threshold, scratch), "links", scratch)

    component = connected_components(first, scratch).withColumnRenamed("node", "doc")
    known = shared.join(component, "doc", "left").select("key", "doc", F.coalesce("component", "doc").alias("component"))
    # Roots whose documents are all connected are done.
    open_roots = (
        known.groupBy("key")
        .agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count(F.lit(1)).alias("crowd"))
        .filter("x <> y")
    )
    members = keep(
        known.join(open_roots, "key").select(_by_crowd("key", "crowd").alias("key"), "doc", "component"), "members", scratch
    )
    lows = members.groupBy("doc").agg(F.collect_list("key").alias("keys")).select("doc", _lows("keys").alias("lows"))
    order = ["key", "n", "point", "doc"]
    trees = keep(
        members.join(points, "doc").join(lows, "doc")
        .select("key", "doc", "component", "n", "point", "lows")
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .mapInPandas(_trees(threshold, LEAF), TREE),
        "trees",
        scratch,
    )
    leaves = trees.filter("leaf is not null").drop("a", "b")
    others = leaves.select("key", *[F.col(c).alias(f"{c}_2") for c in leaves.columns if c != "key"])
    t, whole = threshold
    # Each pair of leaves once, and only if their sizes allow a link.
    once = (F.col("n_min") < F.col("n_min_2")) | (
        (F.col("n_min") == F.col("n_min_2")) & (F.col("leaf") <= F.col("leaf_2"))
    )
    sizes = (F.col("n_max") * whole >= F.col("n_min_2") * t) & (F.col("n_max_2") * whole >= F.col("n_min") * t)
    between = leaves.join(others, "key").filter(once & sizes).mapInArrow(_join_leaves(threshold), "a long, b long")
    candidates = trees.filter("a is not null").select("a", "b").union(between)
    rest = keep(
        candidates.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs", scratch
    )
    rest = keep(_allowed(rest, fine, "fine", threshold), "pairs", scratch)
    if rest.isEmpty():
        return first
    second = keep(verified(docs, rest, words, threshold, scratch), "links", scratch)
    return first.union(second)


def near_duplicates(
    docs: DataFrame, words: int = 5, threshold: tuple[int, int] = (80, 100), scratch: str | None = None
) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs (doc_id, text)``.

    Two documents link when ``threshold[1] * |intersection| >= threshold[0] *
    |union|``; ``component_id`` is the smallest ``doc_id`` that links reach.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, n long, digest binary, point binary, fine binary, keys array<long>"
    described = keep(docs.mapInArrow(_describe(words, threshold), schema), "sets", scratch)
    nodes = described.filter("n > 0 and doc_id is not null")
    copies = keep(nodes.groupBy("digest").agg(F.min("doc_id").alias("holder")), "copies", scratch)
    holders = copies.select(F.col("holder").alias("doc_id"), "digest")
    between = links(docs, nodes, holders, words, threshold, scratch)
    # A document's copies hang on the holder of its set; a document id with several texts joins their sets.
    by_copy = nodes.join(copies, "digest").select("doc_id", "holder").filter("doc_id <> holder")
    everything = between.union(by_copy.select(F.col("doc_id").alias("u"), F.col("holder").alias("v")))
    component = connected_components(everything, scratch)
    return (
        described.select("doc_id", F.col("n").alias("n_shingles"))
        .join(component.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    )


def drop_near_duplicates(
    docs: DataFrame, words: int = 5, threshold: tuple[int, int] = (80, 100), scratch: str | None = None
) -> DataFrame:
    """``docs`` with one document of each group, the one with the smallest id, and all its columns.

    Of repeated rows one stays; rows with a null ``doc_id`` stay.
    """
    found = near_duplicates(docs, words, threshold, scratch)
    kept = keep(
        found.filter("doc_id = component_id").select(F.col("doc_id").alias("__kept_id")).distinct(), "kept", scratch
    )
    named = docs.join(kept, F.col("doc_id").cast("long") == F.col("__kept_id"), "left_semi").dropDuplicates(["doc_id"])
    return named.union(docs.filter("doc_id is null"))
