"""Operator 3: best-fit packing of token sequences by exact-complement hashing.

Every document is encoded, ended with a separator id and, if longer than the
capacity, cut into pieces. Which lengths share a sequence is decided on the
histogram of piece lengths, which has at most ``capacity`` entries however
large the corpus is:

1. from the longest length down, the gap it leaves is looked up among the
   sums of one, two and three available lengths (availability counts say how
   many pieces of each length are left), and as many sequences as the counts
   allow are filled exactly;
2. what is left is packed best-fit decreasing, again by length: pieces of one
   length go to the open sequences with the smallest gap that holds them.

The plan is a list of patterns (a combination of lengths and how often it is
used). Pieces are numbered within their length by a distributed count (hash
blocks, counts per block, running sums over blocks), so neither a frequent
length nor a large group of copies meets in one task, and a piece's number
finds its place in the plan.

Defined results: a null or empty text is one piece that holds only the
separator; repeated rows are packed as separate documents; an empty table
gives no rows; a null ``doc_id`` is packed and stays null; other columns are
not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm.common import keep, sliced
from shelfwise.llm.tokens import TEXTS, byte_bpe

ROWS_PER_BLOCK = 200_000  # pieces numbered together


@dataclass(frozen=True)
class Pattern:
    """``count`` sequences, each holding ``items``: (length, how many of it)."""

    items: tuple[tuple[int, int], ...]
    count: int


def plan_patterns(histogram: dict[int, int], capacity: int) -> list[Pattern]:
    """Patterns that place every piece of ``histogram`` (length -> count) exactly once."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, count in histogram.items():
        if not 1 <= length <= capacity:
            raise ValueError(f"length {length} is outside 1..{capacity}")
        left[length] += count
    patterns: list[Pattern] = []
    if left[capacity]:
        patterns.append(Pattern(((capacity, 1),), int(left[capacity])))
        left[capacity] = 0
    for base in range(capacity - 1, 0, -1):
        while left[base]:
            left[base] -= 1  # one piece is the base, so that a combination cannot claim it as well
            filling = _exact_filling(left, capacity - base)
            left[base] += 1
            if filling is None:
                break
            need: dict[int, int] = {base: 1}
            for length in filling:
                need[length] = need.get(length, 0) + 1
            count = min(int(left[length]) // k for length, k in need.items())
            for length, k in need.items():
                left[length] -= k * count
            patterns.append(Pattern(tuple(sorted(need.items(), reverse=True)), count))
    return patterns + _best_fit_decreasing(left, capacity)


def _exact_filling(left: np.ndarray, gap: int) -> tuple[int, ...] | None:
    """One, two or three available lengths that add up to ``gap``, the longest first."""
    if left[gap]:
        return (gap,)
    pair = _exact_pair(left, gap)
    if pair:
        return pair
    # Sums of two lengths that are there: index of pair sums by one convolution.
    there = (left[: gap + 1] > 0).astype(np.float32)
    sums = np.convolve(there, there)[: gap + 1] > 0.5
    longest = np.arange(gap - 2, 0, -1)
    for first in longest[(left[longest] > 0) & sums[gap - longest]]:
        left[first] -= 1
        pair = _exact_pair(left, gap - int(first))
        left[first] += 1
        if pair:
            return (int(first), *pair)
    return None


def _exact_pair(left: np.ndarray, total: int) -> tuple[int, int] | None:
    small = np.arange(1, total // 2 + 1)
    found = small[(left[small] > 0) & (left[total - small] > (small * 2 == total))]
    return (total - int(found[0]), int(found[0])) if len(found) else None


def _best_fit_decreasing(left: np.ndarray, capacity: int) -> list[Pattern]:
    open_by_gap: dict[int, list[tuple[dict[int, int], int]]] = {}
    full: list[Pattern] = []

    def put(items: dict[int, int], gap: int, count: int) -> None:
        if gap:
            open_by_gap.setdefault(gap, []).append((items, count))
        else:
            full.append(Pattern(tuple(sorted(items.items(), reverse=True)), count))

    for length in range(capacity, 0, -1):
        todo = int(left[length])
        while todo:
            gap = min((g for g in open_by_gap if g >= length), default=None)
            if gap is None:
                each = capacity // length
                whole, rest = divmod(todo, each)
                if whole:
                    put({length: each}, capacity - each * length, whole)
                if rest:
                    put({length: rest}, capacity - rest * length, 1)
                break
            items, count = open_by_gap[gap].pop()
            if not open_by_gap[gap]:
                del open_by_gap[gap]
            # Best fit fills such a sequence with this length again and again while it still fits.
            each = min(gap // length, todo)
            used = min(count, todo // each)
            if used < count:
                put(items, gap, count - used)
            put(items | {length: items.get(length, 0) + each}, gap - each * length, used)
            todo -= used * each
    return full + [
        Pattern(tuple(sorted(items.items(), reverse=True)), count)
        for groups in open_by_gap.values()
        for items, count in groups
    ]


@dataclass(frozen=True)
class Places:
    """For each length: where the runs of its numbered pieces go."""

    starts: dict[int, np.ndarray]  # number of a run's first piece
    rows: dict[int, np.ndarray]  # sequences in the pattern, first sequence, first offset


def places(patterns: list[Pattern]) -> Places:
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for pattern in patterns:
        offset = 0
        for length, each in pattern.items:
            number = taken.get(length, 0)
            runs.setdefault(length, []).append((number, pattern.count, sequence, offset))
            taken[length] = number + each * pattern.count
            offset += each * length
        sequence += pattern.count
    table = {length: np.array(r, dtype=np.int64) for length, r in runs.items()}
    return Places({k: v[:, 0] for k, v in table.items()}, {k: v[:, 1:] for k, v in table.items()})


def _place_batches(where: Places):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            number = batch.column("number").to_numpy(zero_copy_only=False)
            sequence = np.empty(len(length), dtype=np.int64)
            offset = np.empty(len(length), dtype=np.int64)
            for n in np.unique(length):
                rows = np.flatnonzero(length == n)
                run_of = np.searchsorted(where.starts[n], number[rows], side="right") - 1
                count, first, at = where.rows[n][run_of].T
                copy, within = np.divmod(number[rows] - where.starts[n][run_of], count)
                sequence[rows] = first + within
                offset[rows] = at + copy * n
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(sequence), pa.array(offset)],
                [*batch.schema.names, "sequence_id", "offset"],
            )

    return run


def cut(n_ids: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; the first takes what is over."""
    first = (n_ids - 1) % capacity + 1
    return [(0, first), *((s, capacity) for s in range(first, n_ids, capacity))]


def _piece_batches(path: str, capacity: int, separator: int, with_ids: bool):
    end = np.array([separator], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, TEXTS):
            ids_of = byte_bpe(path).encode([t or "" for t in batch.column("text").to_pylist()])
            docs: list[int] = []
            rows: list[tuple] = []
            for i, ids in enumerate(ids_of):
                ids += end
                for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    part = ids[4 * start : 4 * (start + length)]
                    docs.append(i)
                    rows.append((k, start, length, zlib.crc32(part), *([part] if with_ids else [])))
            columns = list(zip(*rows)) if rows else [[]] * (4 + with_ids)
            arrays = [batch.column("doc_id").take(pa.array(docs, pa.int64())), pa.array(columns[0], pa.int32())]
            arrays += [pa.array(c, pa.int64()) for c in columns[1:4]]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays.append(pa.array(columns[4], pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def cut_pieces(
    docs: DataFrame, tokenizer_path: str, capacity: int = 2048, separator: int = 0, with_ids: bool = False
) -> DataFrame:
    """One row per piece of ``docs (doc_id, text)``; ``with_ids`` adds its ids (packed unsigned 32-bit)."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long" + (", ids binary" * with_ids)
    return docs.select("doc_id", "text").mapInArrow(
        _piece_batches(tokenizer_path, capacity, separator, with_ids), schema
    )


def _numbered(pieces: DataFrame, blocks: int) -> DataFrame:
    """Number the pieces of each length from 0, block by block."""
    own = ["doc_id", "piece", "start", "ids_crc32"]
    block = F.pmod(F.xxhash64(*own), F.lit(blocks)).cast("int")
    rows = pieces.withColumn("block", block)
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("block", "length").agg(F.count(F.lit(1)).alias("n"))
    first = counts.select("block", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = F.row_number().over(Window.partitionBy("block", "length").orderBy(*own))
    return (
        rows.withColumn("within", within)
        .join(first, ["block", "length"])
        .select(*pieces.columns, (F.col("first") + F.col("within") - 1).cast("long").alias("number"))
    )


def pack_pieces(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces (a written table: it is read three times)."""
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    where = places(plan_patterns(counts, capacity))  # at most `capacity` lengths: small whatever the corpus
    numbered = _numbered(pieces, max(1, -(-sum(counts.values()) // ROWS_PER_BLOCK)))
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in numbered.schema.fields]
    placed = numbered.mapInArrow(_place_batches(where), ", ".join([*fields, "sequence_id long", "offset long"]))
    return placed.drop("number")


def pack(
    docs: DataFrame, tokenizer_path: str, capacity: int = 2048, separator: int = 0, scratch: str | None = None
) -> DataFrame:
    """Pack whole ``docs (doc_id, text)``: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``."""
    return pack_pieces(keep(cut_pieces(docs, tokenizer_path, capacity, separator), "pieces", scratch), capacity)


def _join_parts(parts):
    import pandas as pd

    packed = b"".join(parts.sort_values("offset")["ids"])
    ids = np.frombuffer(packed, dtype="<u4").astype(np.int64)
    return pd.DataFrame({"sequence_id": [parts["sequence_id"].iloc[0]], "ids": [ids]})


def sequences(
    docs: DataFrame, placed: DataFrame, tokenizer_path: str, capacity: int = 2048, separator: int = 0
) -> DataFrame:
    """The packed sequences themselves, ``sequence_id, ids``, for ``placed`` = ``pack(docs)``.

    Pieces are found by id, so ``docs`` needs unique, non-null ids here. A
    group is one sequence: at most ``capacity`` ids.
    """
    ids = cut_pieces(docs, tokenizer_path, capacity, separator, with_ids=True).select("doc_id", "piece", "ids")
    parts = placed.join(ids, ["doc_id", "piece"]).select("sequence_id", "offset", "ids")
    return parts.groupBy("sequence_id").applyInPandas(_join_parts, "sequence_id long, ids array<long>")
