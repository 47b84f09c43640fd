"""Exchanges of packed integer columns between tasks.

Sorted hash joins over hundreds of millions of small rows cost mostly per-row work. Here a task
packs the entries of one chunk for one bucket into one binary, Spark shuffles those binaries by
bucket, and a task unpacks whole buckets into numpy arrays. Every entry still goes through
Spark's shuffle, so lost executors are recovered as usual.

Entries of one key from one chunk are combined before the exchange (each operator says how),
so that a bucket gets a key at most once per chunk, however often the key occurs.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECES = "bucket int, owner int, payload binary"
_WIDTHS = (np.uint8, np.uint16, np.uint32, np.uint64)


def pack(*columns: np.ndarray) -> bytes:
    """Integer columns as one binary: differences where a column never falls, narrowest width."""
    parts = [struct.pack("<B", len(columns))]
    for column in columns:
        low, steps = 0, 0
        values = column
        if column.dtype != np.uint64 and len(column):
            values = column.astype(np.int64)
            rises = np.diff(values)
            if len(rises) and rises.min() >= 0:
                low, steps, values = int(values[0]), 1, np.concatenate([[0], rises])
            else:
                low = int(values.min())
                values = values - low
        top = int(values.max()) if len(values) else 0
        width = next(w for w in range(4) if top <= np.iinfo(_WIDTHS[w]).max)
        kind = 4 if column.dtype == np.uint64 else 0
        parts.append(struct.pack("<BBIq", width | kind, steps, len(column), low))
        parts.append(values.astype(_WIDTHS[width]).tobytes())
    return b"".join(parts)


def unpack(payload: bytes) -> list[np.ndarray]:
    """The columns of :func:`pack`, as int64 or uint64."""
    out, at = [], 1
    for _ in range(payload[0]):
        width, steps, n, low = struct.unpack_from("<BBIq", payload, at)
        at += struct.calcsize("<BBIq")
        dtype = np.dtype(_WIDTHS[width & 3])
        values = np.frombuffer(payload, dtype=dtype, count=n, offset=at)
        at += n * dtype.itemsize
        if width & 4:
            out.append(values.astype(np.uint64))
        else:
            values = values.astype(np.int64)
            out.append((np.cumsum(values) if steps else values) + low)
    return out


def split(keys: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Columns by key, each part in the given order."""
    order = np.argsort(keys.astype(np.uint16 if not len(keys) or keys.max() < 65536 else np.int64), kind="stable")
    ranked = keys[order]
    cuts = np.flatnonzero(ranked[1:] != ranked[:-1]) + 1
    for part in np.split(order, cuts) if len(order) else []:
        yield int(keys[part[0]]), [c[part] for c in columns]


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)


def owner_of(ids: np.ndarray, owners: int) -> np.ndarray:
    """Bucket of a document, by its id."""
    return bucket_of(ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), owners)


def piece_rows(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    bucket, owner, payload = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.record_batch(
        [pa.array(bucket, pa.int32()), pa.array(owner, pa.int32()), pa.array(payload, pa.binary())],
        names=["bucket", "owner", "payload"],
    )


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def concatenated(payloads: list[bytes], columns: int) -> list[np.ndarray]:
    parts = [unpack(p) for p in payloads]
    return [np.concatenate([p[i] for p in parts]) for i in range(columns)]


def by_bucket(
    pieces: DataFrame,
    key: str,
    reduce: Callable[[int, list[bytes]], Iterator[pa.RecordBatch]],
    schema: str,
    through: bool = False,
) -> DataFrame:
    """Shuffle pieces by ``key`` and reduce each bucket whole; one bucket is in memory at a time.

    With ``through``, rows that already have an owner (not -1) pass as they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []
        for batch in batches:
            if through:
                done = pa.compute.not_equal(batch.column("owner"), -1)
                passed = batch.filter(done)
                if passed.num_rows:
                    yield passed
                batch = batch.filter(pa.compute.invert(done))
            for bucket, payload in zip(batch.column(key).to_pylist(), batch.column("payload").to_pylist(), strict=True):
                if bucket != current and held:
                    yield from reduce(current, held)
                    held = []
                current = bucket
                held.append(payload)
        if held:
            yield from reduce(current, held)

    import pyarrow.compute  # noqa: F401

    dealt = pieces.repartitionById(partitions(pieces), key).sortWithinPartitions(key)
    return dealt.mapInArrow(run, schema)


def groups(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order that brings equal values together, where each group starts in it, and their sizes."""
    order = np.argsort(hashes)
    ranked = hashes[order]
    starts = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(order) else order
    return order, starts, np.diff(np.append(starts, len(order)))


def owner_pieces(doc: np.ndarray, sub: np.ndarray, at: np.ndarray, owners: int) -> Iterator[tuple[int, bytes]]:
    """Positions of documents, packed by owner."""
    for owner, columns in split(owner_of(doc, owners), doc, sub, at):
        yield owner, pack(*columns)


def marks_by_document(pieces: DataFrame) -> DataFrame:
    """(doc_id, marks): the positions that all tasks found in a document, packed as (sub, at)."""

    def reduce(_: int, payloads: list[bytes]) -> Iterator[pa.RecordBatch]:
        doc, sub, at = concatenated(payloads, 3)
        order = np.lexsort((at, sub, doc))
        doc, sub, at = doc[order], sub[order], at[order]
        cuts = np.flatnonzero(doc[1:] != doc[:-1]) + 1
        bounds = np.concatenate([[0], cuts, [len(doc)]])
        for low in range(0, len(bounds) - 1, 2000):
            ends = bounds[low : low + 2001]
            packed = [pack(sub[a:b], at[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.record_batch([pa.array(doc[ends[:-1]]), pa.array(packed, pa.binary())], names=["doc_id", "marks"])

    return by_bucket(pieces, "owner", reduce, "doc_id long, marks binary")


def identified(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, sub, text) of rows with an id, dealt by id.

    ``sub`` numbers different texts of one id in text order, from 0; rows that repeat an id and
    its text share one number and are one document. All users of this frame share one shuffle.
    """
    from pyspark.sql import Window

    # No alias where none is needed: an alias more or less would hide that exchanges are equal.
    plain = doc_id == "doc_id" and docs.schema[doc_id].dataType.simpleString() == "bigint"
    key = F.col("doc_id") if plain else F.col(doc_id).cast("long").alias("doc_id")
    dealt = docs.where(F.col(doc_id).isNotNull()).select(key, F.coalesce(F.col(text), F.lit("")).alias("text"))
    dealt = dealt.repartition(partitions(docs), "doc_id")
    return dealt.withColumn("sub", F.dense_rank().over(Window.partitionBy("doc_id").orderBy("text")) - 1)


def with_marks(docs: DataFrame, marks: DataFrame, how: str) -> DataFrame:
    """Documents with their marks; the small side is hashed, so texts are neither sorted nor moved."""
    return docs.join(marks.hint("shuffle_hash"), "doc_id", how)


def mark_positions(marks: list[bytes | None], subs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Document number in the chunk and position of each mark of a chunk's rows."""
    rows, at = [], []
    for i, payload in enumerate(marks):
        if payload is not None:
            sub, position = unpack(payload)
            position = position[sub == subs[i]]
            rows.append(np.full(len(position), i, dtype=np.int64))
            at.append(position)
    if not rows:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    return np.concatenate(rows), np.concatenate(at)
