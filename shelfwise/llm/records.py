"""Operator 5: token ids as length-delimited binary records with an offset index.

A shard is a file of records, each framed as

    length     unsigned 64-bit, bytes of the payload
    checksum   masked CRC-32 of the 8 length bytes
    payload
    checksum   masked CRC-32 of the payload

(all little-endian; the mask rotates the CRC right by 15 bits and adds a
constant, so that a CRC stored in data that is checksummed again stays
harmless). A payload is ``id width in bytes (u8), has doc_id (u8), doc_id
(i64), number of ids (u32), ids``. Beside each shard lies its index, one
fixed-size entry per record (``has doc_id, doc_id, byte offset, ids``), so a
reader can fetch records in any order with one seek each.

Writing: rows are range-partitioned on ``doc_id`` (nulls first) and sorted, and
every task writes one shard under a name of its own. A task that is run again
writes another file; only files named in the manifest, the table of what the
successful tasks returned, belong to the data. Reading checks every checksum.

Files are written through ``pyarrow.fs`` to the given folder (``file:``,
``hdfs:``, ``s3:``, ``gs:``), which driver and executors must share.

Defined results: a null or empty text gives a record with the end id alone;
repeated rows give a record each; a null ``doc_id`` is kept; an empty table
gives an empty manifest; other columns are not read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm.common import keep, scratch_path, sliced
from shelfwise.llm.tokens import TEXTS, byte_bpe

MASK_DELTA = 0xA282EAD8
LENGTH = struct.Struct("<Q")
CHECK = struct.Struct("<I")
HEAD = struct.Struct("<BBqI")
ENTRY = struct.Struct("<BqQI")

MANIFEST = "path string, index_path string, first_id long, n_records long, n_ids long, n_bytes long"


class CorruptRecord(ValueError):
    """A record's checksum or length does not fit its bytes."""


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = LENGTH.pack(len(payload))
    return b"".join((length, CHECK.pack(masked_crc(length)), payload, CHECK.pack(masked_crc(payload))))


def read_frame(stream) -> bytes | None:
    """The next payload of ``stream``, None at its end."""
    head = stream.read(LENGTH.size + CHECK.size)
    if not head:
        return None
    if len(head) < LENGTH.size + CHECK.size or masked_crc(head[:8]) != CHECK.unpack(head[8:])[0]:
        raise CorruptRecord("length of a record")
    size = LENGTH.unpack(head[:8])[0]
    body = stream.read(size + CHECK.size)
    if len(body) != size + CHECK.size or masked_crc(body[:size]) != CHECK.unpack(body[size:])[0]:
        raise CorruptRecord("payload of a record")
    return body[:size]


def encode_record(doc_id: int | None, ids: np.ndarray, width: int) -> bytes:
    head = HEAD.pack(width, doc_id is not None, doc_id or 0, len(ids))
    return head + ids.astype(f"<u{width}").tobytes()


def decode_record(payload: bytes) -> tuple[int | None, np.ndarray]:
    width, has_id, doc_id, n = HEAD.unpack_from(payload)
    return doc_id if has_id else None, np.frombuffer(payload, dtype=f"<u{width}", count=n, offset=HEAD.size)


def index_entry(doc_id: int | None, offset: int, n_ids: int) -> bytes:
    return ENTRY.pack(doc_id is not None, doc_id or 0, offset, n_ids)


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def _write_shard(folder: str, tokenizer_path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in sliced(batches, TEXTS):
            if encoder is None:
                encoder = byte_bpe(tokenizer_path)
                width = 2 if max(encoder.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
                end = np.array([end_id], dtype="<u4").tobytes()
                name = f"shard-{uuid.uuid4().hex}"
                files, root = _open(folder)
                files.create_dir(root, recursive=True)
                data = files.open_output_stream(f"{root}/{name}.rec", buffer_size=1 << 20)
                index = files.open_output_stream(f"{root}/{name}.idx", buffer_size=1 << 16)
                first, records, total, at = None, 0, 0, 0
            doc_ids = batch.column("doc_id").to_pylist()
            packed = encoder.encode([t or "" for t in batch.column("text").to_pylist()])
            for doc_id, ids in zip(doc_ids, packed):
                ids = np.frombuffer(ids + end, dtype="<u4")
                record = frame(encode_record(doc_id, ids, width))
                data.write(record)
                index.write(index_entry(doc_id, at, len(ids)))
                first = doc_id if records == 0 else first
                records, total, at = records + 1, total + len(ids), at + len(record)
        if encoder is not None:
            data.close()
            index.close()
            row = [f"{folder}/{name}.rec", f"{folder}/{name}.idx", first, records, total, at]
            types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            names = [c.split()[0] for c in MANIFEST.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names)

    return run


def write_records(
    docs: DataFrame, tokenizer_path: str, folder: str | None = None, end_id: int = 2, scratch: str | None = None
) -> DataFrame:
    """Write ``docs (doc_id, text)`` in ascending ``doc_id`` order; returns the manifest, one row per shard.

    ``doc_id`` is an integer. The number of shards follows the shuffle
    partitions that adaptive execution makes of the data.
    """
    folder = folder or scratch_path(docs.sparkSession, "records", scratch)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # The text's hash only orders and spreads rows that share an id.
    order = ["doc_id", F.xxhash64("text")]
    shards = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return keep(shards.mapInArrow(_write_shard(folder, tokenizer_path, end_id), MANIFEST), "manifest", scratch)


def _read_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for shard in batch.to_pylist():
            files, path = _open(shard["path"])
            start = shard["start"]
            with files.open_input_stream(path, buffer_size=1 << 20) as stream:
                columns: list[list] = [[], [], [], []]
                while (payload := read_frame(stream)) is not None:
                    doc_id, ids = decode_record(payload)
                    crc = zlib.crc32(ids.astype("<u4").tobytes())
                    for column, value in zip(columns, (doc_id, start, len(ids), crc)):
                        column.append(value)
                    start += len(ids)
                    if len(columns[0]) == 10_000:
                        yield _digests(columns)
                        columns = [[], [], [], []]
                yield _digests(columns)
            if start != shard["start"] + shard["n_ids"]:
                raise CorruptRecord(f"{shard['path']} does not hold the ids of its manifest row")


def _digests(columns: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "n_tokens", "ids_crc32"]
    )


def read_digests(manifest: DataFrame) -> DataFrame:
    """Read all shards: ``doc_id, start, n_tokens, ids_crc32`` per record, in the order of the files.

    ``start`` counts the ids before the record over all shards. The running sum
    over shards handles one row per file.
    """
    # A doc_id spread over several shards: equal first ids, any order among them is ascending.
    ordered = Window.orderBy(F.col("first_id").asc_nulls_first(), "path").rowsBetween(Window.unboundedPreceding, -1)
    shards = manifest.filter("n_records > 0").withColumn("start", F.coalesce(F.sum("n_ids").over(ordered), F.lit(0)))
    n = max(1, manifest.count())
    return shards.select("path", "start", "n_ids").repartition(n).mapInArrow(
        _read_shards, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def read_record(path: str, index_path: str, number: int) -> tuple[int | None, np.ndarray]:
    """One record of a shard through its index: the access that a shuffled reader makes."""
    files, index = _open(index_path)
    with files.open_input_file(index) as f:
        f.seek(number * ENTRY.size)
        _, _, offset, _ = ENTRY.unpack(f.read(ENTRY.size))
    with files.open_input_file(_open(path)[1]) as f:
        f.seek(offset)
        payload = read_frame(f)
    if payload is None:
        raise CorruptRecord("an index entry points beyond its shard")
    return decode_record(payload)
