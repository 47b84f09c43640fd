"""Removal of long byte strings that also start in a document with a smaller id.

Suffix arrays of a whole corpus do not fit a task, so text is dealt to shards such that any two
equal strings of ``length`` bytes meet in one. Within such a string the gram with the smallest
hash (an anchor) depends on its bytes alone, so equal strings hold equal anchors. Anchors that
occur in one document only are set aside after a packed exchange of hashes; of the others, each
distinct surrounding (all strings of that length around the anchor) goes to the anchor's shard.
A shard sorts the suffixes of its surroundings by induced sorting and finds equal strings as runs
of permuted common prefixes of ``length`` or more; each run is judged by its smallest id.

Occurrences whose whole surrounding also stands in a smaller id need no shard: copies are
collapsed to the smallest id before text moves, within a chunk and then within a bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridelake.llm import packed
from ridelake.llm.suffix_arrays import common_prefixes, suffix_array
from ridelake.llm.text import chunks, mixed

GRAM = 16
_SCAN_BYTES = 1 << 19
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)
#: Bytes of text per suffix array; a bucket of anchors is cut into such shards by anchor hash.
SHARD_BYTES = 800_000
#: A mark is ``start * SCALE + code``: code c says that c + 1 strings from ``start`` on go, and
#: ``SEND`` that the surrounding of the anchor at ``start`` is wanted.
SCALE = 64
SEND = SCALE - 1


class Chunk:
    """Texts of a chunk in one buffer, with room to read past its end."""

    def __init__(self, texts: list[bytes]):
        self.sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        self.buffer = np.frombuffer(b"".join(texts) + bytes(256), dtype=np.uint8)
        self.eight = np.lib.stride_tricks.as_strided(self.buffer, (len(self.buffer) - 7, 8), (1, 1))

    def load(self, at: np.ndarray) -> np.ndarray:
        """Eight bytes from each position on, as one number."""
        return self.eight[at].view(np.uint64).ravel()

    def grams(self, at: np.ndarray) -> np.ndarray:
        """Hash of the gram at each position."""
        return mixed(mixed(self.load(at) * _A) ^ (self.load(at + 8) * _B))


def _slid(values: np.ndarray, width: int, better) -> np.ndarray:
    """Best of every run of ``width`` values, by doubling."""
    span = 1
    while span * 2 <= width:
        values = better(values[:-span], values[span:])
        span *= 2
    if span < width:
        values = better(values[: len(values) - width + span], values[width - span :])
    return values


def anchors(chunk: Chunk, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document number, buffer position and hash of every anchor.

    Anchors are the grams of smallest hash among those of some string of ``length`` bytes; all
    ties are anchors, so that equal strings have equal ones.
    """
    width = length - GRAM + 1
    total = int(chunk.ends[-1]) if len(chunk.ends) else 0
    found: list[np.ndarray] = []
    hashes: list[np.ndarray] = []
    for low in range(0, total, _SCAN_BYTES):
        # Look at ``width`` grams more on either side, and keep anchors of this stretch only.
        begin, stop = max(0, low - width), min(total, low + _SCAN_BYTES) + width
        view = np.ascontiguousarray(chunk.eight[begin : stop + 8]).view(np.uint64).ravel()
        gram = mixed(mixed(view[:-8] * _A) ^ (view[8:] * _B))
        rank = (gram >> np.uint64(32)).astype(np.uint32)
        least = _slid(rank, width, np.minimum)
        edge = np.zeros(width - 1, dtype=np.uint32)
        highest = _slid(np.concatenate([edge, least, edge]), width, np.maximum)
        at = np.flatnonzero(highest == rank)
        at = at[(at + begin >= low) & (at + begin < low + _SCAN_BYTES)]
        found.append(at + begin)
        hashes.append(gram[at])
    if not found:
        none = np.empty(0, dtype=np.int64)
        return none, none, none.astype(np.uint64)
    at, gram = np.concatenate(found), np.concatenate(hashes)
    doc = np.searchsorted(chunk.ends, at, side="right")
    usable = doc < len(chunk.ends)
    at, gram, doc = at[usable], gram[usable], doc[usable]
    usable = (at + GRAM <= chunk.ends[doc]) & (chunk.sizes[doc] >= length)
    return doc[usable], at[usable], gram[usable]


def surroundings(
    chunk: Chunk, doc: np.ndarray, at: np.ndarray, length: int
) -> tuple[np.ndarray, np.ndarray]:
    """First byte, and the byte behind the last, of all strings of ``length`` that hold an anchor."""
    low = np.maximum(at - (length - GRAM), chunk.starts[doc])
    high = np.minimum(at + length, chunk.ends[doc])
    return low, high


def surrounding_hashes(chunk: Chunk, at: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """64-bit hash of each surrounding and of the anchor's place in it."""
    total = mixed((high - low).astype(np.uint64) * _A + (at - low).astype(np.uint64))
    for step in range(0, int((high - low).max()) if len(low) else 0, 8):
        left = np.clip(high - low - step, 0, 8)
        value = chunk.load(np.minimum(low + step, len(chunk.buffer) - 8))
        drop = ((8 - left) * 8).astype(np.uint64)
        value = np.where(left > 0, (value << (drop & np.uint64(63))) >> (drop & np.uint64(63)), 0)
        total = (total ^ (value * _B)) * _A
        total ^= total >> np.uint64(29)
    return mixed(total)


def _ids(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return rows["doc_id"].to_numpy(), rows["sub"].to_numpy().astype(np.int64)


def _runs(chunk: Chunk, doc: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Marks over all strings that hold the anchors at ``at``."""
    low, high = surroundings(chunk, doc, at, length)
    return (low - chunk.starts[doc]) * SCALE + (high - low - length)


def _anchor_pieces(length: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in chunks(batches):
            ids, subs = _ids(rows)
            chunk = Chunk(texts)
            doc, at, gram = anchors(chunk, length)
            if not len(at):
                continue
            low, high = surroundings(chunk, doc, at, length)
            around = surrounding_hashes(chunk, at, low, high)
            # In the chunk, all but the smallest id of a surrounding are judged here.
            order, starts, sizes = packed.groups(around ^ mixed(gram.copy()))
            smallest = np.minimum.reduceat(ids[doc[order]], starts)
            repeats = np.empty(len(at), dtype=bool)
            repeats[order] = ids[doc[order]] > np.repeat(smallest, sizes)
            asks, gone = np.flatnonzero(~repeats), np.flatnonzero(repeats)
            asks = asks[np.lexsort((at[asks], subs[doc[asks]], ids[doc[asks]]))]
            place = at - chunk.starts[doc]
            out = []
            columns = (
                gram[asks].astype(np.uint32).astype(np.int64), around[asks], ids[doc[asks]], subs[doc[asks]],
                place[asks], (low - at)[asks], (high - at)[asks],
            )
            for bucket, parts in packed.split(packed.bucket_of(gram[asks] >> np.uint64(12), buckets), *columns):
                out.append((bucket, -1, packed.pack(*parts)))
            marks = _runs(chunk, doc[gone], at[gone], length)
            for owner, payload in packed.owner_pieces(ids[doc[gone]], subs[doc[gone]], marks, buckets):
                out.append((owner % buckets, owner, payload))
            yield packed.piece_rows(out)

    return run


def _judged_anchors(length: int, buckets: int):
    def reduce(bucket: int, payloads: list[bytes]) -> Iterator[pa.RecordBatch]:
        gram, around, doc, sub, place, before, behind = packed.concatenated(payloads, 7)
        order = np.lexsort((around, gram))
        gram, around, doc = gram[order], around[order], doc[order]
        fresh_gram = np.concatenate([[True], gram[1:] != gram[:-1]])
        fresh = fresh_gram | np.concatenate([[True], around[1:] != around[:-1]])
        at_gram, at_around = np.flatnonzero(fresh_gram), np.flatnonzero(fresh)
        smallest = np.repeat(np.minimum.reduceat(doc, at_around), np.diff(np.append(at_around, len(doc))))
        sizes = np.diff(np.append(at_gram, len(doc)))
        several = np.repeat(np.maximum.reduceat(doc, at_gram) != np.minimum.reduceat(doc, at_gram), sizes)
        kinds = np.repeat(np.add.reduceat(fresh.astype(np.int64), at_gram), sizes)
        gone = doc > smallest
        sent = ~gone & several & (kinds > 1)
        first = (place + before)[order]
        marks = np.where(gone, first * SCALE + (behind - before)[order] - length, place[order] * SCALE + SEND)
        told = np.flatnonzero(gone | sent)
        if len(told):
            found = packed.owner_pieces(doc[told], sub[order][told], marks[told], buckets)
            yield packed.piece_rows([(bucket, o, p) for o, p in found])

    return reduce


def _surrounding_pieces(length: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in chunks(batches):
            ids, subs = _ids(rows)
            chunk = Chunk(texts)
            doc, marks = packed.mark_positions(rows["marks"].to_pylist(), subs)
            wanted = marks % SCALE == SEND
            done = ~wanted
            out = [
                (o % buckets, o, p)
                for o, p in packed.owner_pieces(ids[doc[done]], subs[doc[done]], marks[done], buckets)
            ]
            doc, place = doc[wanted], marks[wanted] // SCALE
            if len(doc):
                at = place + chunk.starts[doc]
                low, high = surroundings(chunk, doc, at, length)
                gram = chunk.grams(at)
                bucket = packed.bucket_of(gram >> np.uint64(12), buckets)
                shard = (gram & np.uint64(0xFF)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                whole = chunk.buffer.tobytes()
                for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
                    text = b"".join([whole[a:b] for a, b in zip(low[part], high[part], strict=True)])
                    numbers = packed.pack(
                        ids[doc[part]],
                        subs[doc[part]],
                        (low - chunk.starts[doc])[part],
                        (high - low)[part],
                        shard[part],
                    )
                    payload = len(numbers).to_bytes(4, "little") + numbers + text
                    out.append((int(bucket[part[0]]), -1, payload))
            if out:
                yield packed.piece_rows(out)

    return run


def repeated_starts(texts: bytes, sizes: np.ndarray, ids: np.ndarray, length: int) -> np.ndarray:
    """Whether each string start of concatenated texts has an equal string in a smaller id.

    Only starts with ``length`` bytes left in their text count; the array covers every byte of
    the texts, each followed by one separator.
    """
    ends = np.cumsum(sizes + 1)
    joined = np.full(int(ends[-1]) + length + 8, 0xFF, dtype=np.uint8)
    real = np.ones(int(ends[-1]), dtype=bool)
    real[ends - 1] = False
    joined[: len(real)][real] = np.frombuffer(texts, dtype=np.uint8)
    symbols = joined[: len(real) + 1].astype(np.uint16) + 1
    symbols[-1] = 0
    order = suffix_array(symbols, 257, length)
    text_of = np.repeat(np.arange(len(sizes)), sizes + 1)
    usable = np.arange(len(real)) + length < np.repeat(ends, sizes + 1)
    usable = np.append(usable, False)
    order = order[usable[order]].astype(np.int64)
    gone = np.zeros(len(real), dtype=bool)
    if len(order):
        shared = np.zeros(len(joined), dtype=np.int64)
        shared[np.sort(order)] = common_prefixes(joined, order, length)
        runs = np.flatnonzero(shared[order] < length)
        owner = ids[text_of[order]]
        smallest = np.minimum.reduceat(owner, runs)
        gone[order] = owner > np.repeat(smallest, np.diff(np.append(runs, len(order))))
    return gone


def _sorted_shards(length: int, buckets: int):
    def judged(texts: bytes, doc, sub, low, sizes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Marks of one shard, with their documents."""
        gone = repeated_starts(texts, sizes, doc, length)
        edge = np.diff(np.concatenate([[0], gone.view(np.int8), [0]]))
        begin, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        firsts = np.cumsum(sizes + 1) - sizes - 1
        text = np.searchsorted(firsts, begin, side="right") - 1
        return doc[text], sub[text], (low[text] + begin - firsts[text]) * SCALE + (stop - begin - 1)

    def reduce(bucket: int, payloads: list[bytes]) -> Iterator[pa.RecordBatch]:
        numbers, texts = [], []
        for payload in payloads:
            size = int.from_bytes(payload[:4], "little")
            numbers.append(payload[4 : 4 + size])
            texts.append(payload[4 + size :])
        doc, sub, low, sizes, shard = packed.concatenated(numbers, 5)
        whole = b"".join(texts)
        ends = np.cumsum(sizes)
        shards = max(1, min(256, len(whole) // SHARD_BYTES))
        out = []
        for _, (mine,) in packed.split(shard % shards, np.arange(len(shard))):
            bounds = zip((ends - sizes)[mine].tolist(), ends[mine].tolist(), strict=True)
            found = judged(b"".join([whole[a:b] for a, b in bounds]), doc[mine], sub[mine], low[mine], sizes[mine])
            out.append(found)
        told = packed.owner_pieces(*(np.concatenate(x) for x in zip(*out, strict=True)), buckets)
        yield packed.piece_rows([(bucket, o, p) for o, p in told])

    return reduce


def _kept_bytes(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in chunks(batches):
            _, subs = _ids(rows)
            chunk = Chunk(texts)
            doc, marks = packed.mark_positions(rows["marks"].to_pylist(), subs)
            begin = chunk.starts[doc] + marks // SCALE
            edge = np.zeros(int(chunk.sizes.sum()) + 1, dtype=np.int32)
            np.add.at(edge, begin, 1)
            np.add.at(edge, begin + marks % SCALE + length, -1)
            gone = np.cumsum(edge[:-1]) > 0
            head = np.zeros(len(gone), dtype=bool)
            head[chunk.starts[chunk.sizes > 0]] = True
            spans = gone & (head | ~np.concatenate([[False], gone[:-1]]))
            kept = chunk.buffer[: len(gone)][~gone].tobytes()
            left = np.concatenate([[0], np.cumsum(~gone)])
            opened = np.concatenate([[0], np.cumsum(spans)])
            a, b = left[chunk.starts], left[chunk.ends]
            yield from pa.table(
                {
                    "doc_id": rows["doc_id"].combine_chunks(),
                    "n_bytes": pa.array(chunk.sizes),
                    "n_removed": pa.array(chunk.sizes - (b - a)),
                    "n_spans": pa.array(opened[chunk.ends] - opened[chunk.starts]),
                    "kept_bytes": pa.array([kept[x:y] for x, y in zip(a, b, strict=True)], pa.binary()),
                }
            ).to_batches()

    return run


def drop_repeated_strings(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = 50
) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_bytes): what is left of each text's UTF-8.

    A byte goes if a string of ``length`` bytes over it also starts in a smaller id. Strings are
    judged on the input and never cross documents; overlaps count. ``length`` is 24 to 78.

    A null text is empty. Rows that repeat an id do not take from each other, whatever their
    texts, and are all returned; a row without an id is left whole and takes nothing from others.
    Other columns are ignored. Memory is bounded by a chunk of texts or the surroundings of one
    bucket; a surrounding from one chunk is exchanged for its smallest id only.
    """
    if not GRAM + 8 <= length <= GRAM + SCALE - 2:
        raise ValueError(f"length must be {GRAM + 8} to {GRAM + SCALE - 2}")
    whole = packed.identified(docs, doc_id, text)
    buckets = packed.partitions(docs)
    asked = whole.mapInArrow(_anchor_pieces(length, buckets), packed.PIECES)
    judged = packed.by_bucket(asked, "bucket", _judged_anchors(length, buckets), packed.PIECES, through=True)
    near = packed.with_marks(whole, packed.marks_by_document(judged), "inner")
    sent = near.mapInArrow(_surrounding_pieces(length, buckets), packed.PIECES)
    found = packed.by_bucket(sent, "bucket", _sorted_shards(length, buckets), packed.PIECES, through=True)
    marked = packed.with_marks(whole, packed.marks_by_document(found), "left")
    unknown = docs.where(F.col(doc_id).isNull()).select(
        F.lit(None).cast("long").alias("doc_id"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
        F.lit(0).alias("sub"),
        F.lit(None).cast("binary").alias("marks"),
    )
    every = marked.select("doc_id", "text", "sub", "marks").unionByName(unknown)
    return every.mapInArrow(
        _kept_bytes(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_bytes binary"
    )
