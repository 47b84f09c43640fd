"""Removal of repeated word runs through difference-cover anchors.

A window is ``window`` consecutive words. With a cover D modulo ``period`` (every difference is
one of two members of D), two equal windows share an aligned anchor: some offset below the period
puts both on positions whose remainder is in D. So only runs of ``window - period + 1`` words at
such positions are hashed and exchanged; those that occur again are anchors, each extended to the
windows that hold it, and only these windows are compared over the whole corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridelake.llm import packed
from ridelake.llm.text import Words, chunks, rolled, scan, word_hashes

#: Perfect difference covers, by period.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16)}


def cover_for(window: int) -> tuple[int, tuple[int, ...]]:
    """Largest known period that leaves anchors of over a third of the window."""
    period = max(p for p in COVERS if p == 1 or 3 * p <= 2 * window)
    return period, COVERS[period]


def _ids(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return rows["doc_id"].to_numpy(), rows["sub"].to_numpy().astype(np.int64)


def _places(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document number, position in the document and words of the document, of each word."""
    owner = words.owner()
    return owner, np.arange(len(owner)) - words.first[owner], words.counts[owner]


def _anchor_pieces(window: int, buckets: int):
    period, cover = cover_for(window)
    size = window - period + 1
    at_cover = np.isin(np.arange(period), cover)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in chunks(batches):
            doc, sub = _ids(rows)
            words = scan(texts)
            hashes = rolled(word_hashes(words), size)
            owner, place, count = _places(words)
            usable = at_cover[place % period] & (place + size <= count) & (count >= window)
            anchors = np.flatnonzero(usable)
            if not len(anchors):
                continue
            h = hashes[anchors]
            order, starts, sizes = packed.groups(h)
            # An anchor found twice in the chunk needs no answer; its hash still tells others.
            once = order[starts[sizes == 1]]
            once.sort()
            twice = h[order[starts[sizes > 1]]]
            local = np.sort(order[np.repeat(sizes > 1, sizes)])
            known = dict(packed.split(packed.bucket_of(twice, buckets), twice))
            asks = dict(
                packed.split(
                    packed.bucket_of(h[once], buckets),
                    h[once],
                    doc[owner[anchors[once]]],
                    sub[owner[anchors[once]]],
                    place[anchors[once]],
                )
            )
            none = [np.empty(0, dtype=np.uint64), *[np.empty(0, dtype=np.int64)] * 3]
            out = [
                (b, -1, packed.pack(known.get(b, none[:1])[0], *asks.get(b, none)))
                for b in known.keys() | asks.keys()
            ]
            at = anchors[local]
            out += [
                (o % buckets, o, p) for o, p in packed.owner_pieces(doc[owner[at]], sub[owner[at]], place[at], buckets)
            ]
            yield packed.piece_rows(out)

    return run


def _repeated_anchors(buckets: int):
    def reduce(bucket: int, payloads: list[bytes]) -> Iterator[pa.RecordBatch]:
        known, h, doc, sub, at = packed.concatenated(payloads, 5)
        order, starts, sizes = packed.groups(np.concatenate([h, known]))
        again = order[np.repeat(sizes > 1, sizes)]
        again = again[again < len(h)]
        if len(again):
            found = packed.owner_pieces(doc[again], sub[again], at[again], buckets)
            yield packed.piece_rows([(bucket, o, p) for o, p in found])

    return reduce


def _window_pieces(window: int, buckets: int):
    period, _ = cover_for(window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in chunks(batches):
            doc, sub = _ids(rows)
            words = scan(texts)
            row, at = packed.mark_positions(rows["marks"].to_pylist(), sub)
            if not len(row):
                continue
            # Extend each anchor to the windows that hold it.
            low = words.first[row] + np.maximum(at - period + 1, 0)
            high = words.first[row] + np.minimum(at, words.counts[row] - window)
            low, high = low[high >= low], high[high >= low]
            edge = np.zeros(len(words.starts) + 2, dtype=np.int32)
            np.add.at(edge, low, 1)
            np.add.at(edge, high + 1, -1)
            starts_at = np.flatnonzero(np.cumsum(edge[:-2]) > 0)
            if not len(starts_at):
                continue
            single = word_hashes(words)
            h = rolled(single, window)[starts_at]
            check = (rolled(single, window, check=True)[starts_at] >> np.uint64(32)).astype(np.int64)
            owner, place, _ = _places(words)
            owner, place = owner[starts_at], place[starts_at]
            # The first window of each text in the chunk asks; the others know that they repeat it.
            # Copies of a repeated row have the same windows, taken once.
            rank = np.lexsort((place, sub[owner], doc[owner]))
            rank = rank[_distinct(doc[owner[rank]], sub[owner[rank]], place[rank])]
            h, check, owner, place = h[rank], check[rank], owner[rank], place[rank]
            order, starts, sizes = packed.groups(h)
            first = np.minimum.reduceat(order, starts)
            later = _after(order, np.repeat(first, sizes), doc[owner], sub[owner], place)
            first.sort()
            out = [
                (b, -1, packed.pack(*columns))
                for b, columns in packed.split(
                    packed.bucket_of(h[first], buckets), h[first], check[first], doc[owner[first]],
                    sub[owner[first]], place[first],
                )
            ]
            found = packed.owner_pieces(doc[owner[later]], sub[owner[later]], place[later], buckets)
            out += [(o % buckets, o, p) for o, p in found]
            yield packed.piece_rows(out)

    return run


def _distinct(*key: np.ndarray) -> np.ndarray:
    """Whether each of the sorted rows differs from the one before."""
    fresh = np.ones(len(key[0]), dtype=bool)
    fresh[1:] = np.any([column[1:] != column[:-1] for column in key], axis=0)
    return fresh


def _after(order: np.ndarray, first: np.ndarray, *key: np.ndarray) -> np.ndarray:
    """Whether each row differs in key from the first row of its group.

    A document whose row is repeated has its windows several times; they are the same windows.
    """
    later = np.zeros(len(order), dtype=bool)
    differs = later.copy()
    for column in key:
        differs |= column[order] != column[first]
    later[order] = differs
    return later


def _later_windows(buckets: int):
    def reduce(bucket: int, payloads: list[bytes]) -> Iterator[pa.RecordBatch]:
        h, check, doc, sub, at = packed.concatenated(payloads, 5)
        rank = np.lexsort((at, sub, doc))
        rank = rank[_distinct(doc[rank], sub[rank], at[rank])]
        h, check, doc, sub, at = h[rank], check[rank], doc[rank], sub[rank], at[rank]
        order = np.lexsort((check, h))
        fresh = np.concatenate(
            [[True], (h[order][1:] != h[order][:-1]) | (check[order][1:] != check[order][:-1])]
        )
        starts = np.flatnonzero(fresh)
        first = np.repeat(np.minimum.reduceat(order, starts), np.diff(np.append(starts, len(h))))
        later = _after(order, first, doc, sub, at)
        if later.any():
            found = packed.owner_pieces(doc[later], sub[later], at[later], buckets)
            yield packed.piece_rows([(bucket, o, p) for o, p in found])

    return reduce


def _kept_texts(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in chunks(batches):
            _, sub = _ids(rows)
            words = scan(texts)
            row, at = packed.mark_positions(rows["marks"].to_pylist(), sub)
            edge = np.zeros(len(words.starts) + 1, dtype=np.int32)
            begin = words.first[row] + at
            # A mark can come from several tasks, so both edges count it alike.
            np.add.at(edge, begin, 1)
            np.add.at(edge, begin + window, -1)
            keep = np.cumsum(edge[:-1]) == 0
            joined, offsets = words.joined(keep)
            whole = joined.tobytes()
            ends = np.maximum(offsets[1:] - 1, offsets[:-1])
            kept = [whole[a:b] for a, b in zip(offsets[:-1], ends, strict=True)]
            n_kept = np.diff(np.concatenate([[0], np.cumsum(keep)])[words.first])
            yield from pa.table(
                {
                    "doc_id": rows["doc_id"].combine_chunks(),
                    "n_words": pa.array(words.counts.astype(np.int64)),
                    "n_removed": pa.array((words.counts - n_kept).astype(np.int64)),
                    "kept_text": pa.array(kept, pa.binary()).cast(pa.string()),
                }
            ).to_batches()

    return run


def drop_repeated_runs(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", window: int = 20
) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text): words left after each later repeat is cut out.

    A word goes if a window over it occurs earlier: in a smaller id, or earlier in its document;
    windows are judged on the input. Words end at blanks and are joined by one space.

    A null text has no words. Rows that repeat an id and its text are one document, judged once
    and returned as often; different texts of one id count in text order. A row without an id
    keeps all its words and takes nothing from others. Other columns are ignored. Memory is
    bounded by a chunk of texts or a bucket of anchors; a window from one chunk is exchanged
    once, however often it occurs there.
    """
    whole = packed.identified(docs, doc_id, text)
    buckets = packed.partitions(docs)
    anchors = whole.mapInArrow(_anchor_pieces(window, buckets), packed.PIECES)
    anchors = packed.by_bucket(anchors, "bucket", _repeated_anchors(buckets), packed.PIECES, through=True)
    near = packed.with_marks(whole, packed.marks_by_document(anchors), "inner")
    windows = near.mapInArrow(_window_pieces(window, buckets), packed.PIECES)
    later = packed.by_bucket(windows, "bucket", _later_windows(buckets), packed.PIECES, through=True)
    marked = packed.with_marks(whole, packed.marks_by_document(later), "left")
    unknown = docs.where(F.col(doc_id).isNull()).select(
        F.lit(None).cast("long").alias("doc_id"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
        F.lit(0).alias("sub"),
        F.lit(None).cast("binary").alias("marks"),
    )
    every = marked.select("doc_id", "text", "sub", "marks").unionByName(unknown)
    return every.mapInArrow(
        _kept_texts(window), "doc_id long, n_words long, n_removed long, kept_text string"
    )
