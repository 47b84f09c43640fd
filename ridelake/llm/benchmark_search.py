"""Search for benchmark passages in documents by Wu-Manber multi-pattern search.

Texts are reduced to lower-cased words joined by single spaces, so that a window of words occurs
where its spaced bytes occur. A shift table over blocks of bytes says how far the search may jump;
where it says nothing, the hash of the suffix block selects the patterns to test, and a direct
comparison confirms. Cursors over all parts of a chunk advance together, one vector per step.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridelake.llm.text import NOT_ALNUM, chunks, scan

WINDOW = 10
#: Bytes of item text searched for in one pass; more items make more passes over the documents.
ITEM_BYTES = 16_000_000
#: Text bytes searched at once; the positions and candidates of a chunk grow with it.
TEXT_BYTES = 1_500_000
_SEGMENT = 2048
_MOST_BITS = 22
#: Candidates that are compared at once.
_SLICE = 100_000
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
HITS = "array<struct<begin:int,stop:int,items:array<bigint>>>"


class PatternSet:
    """Shift and suffix tables of patterns with at least ``least`` bytes.

    Blocks have eight bytes, or as many as the shortest pattern has. The shift table has about
    four places per block of the patterns, so that most blocks of a text jump. Where none is left,
    the hash of the suffix block and the first bytes selects patterns, and only those are compared.
    """

    def __init__(self, patterns: list[bytes]):
        self.patterns = patterns
        self.least = min(map(len, patterns))
        self.block = min(8, self.least)
        heads = np.frombuffer(b"".join(p[: self.least] for p in patterns), dtype=np.uint8)
        heads = heads.reshape(len(patterns), self.least)
        places = self.least - self.block + 1
        self.bits = min(_MOST_BITS, max(12, int(len(patterns) * places).bit_length() + 2))
        self.mask = np.uint64((1 << (8 * self.block)) - 1)
        self.shift = np.full(1 << self.bits, min(places, 32767), dtype=np.int16)
        for end in range(self.block, self.least + 1):
            jump = min(self.least - end, 32767)
            np.minimum.at(self.shift, self._place(self._word(heads, end - self.block)), np.int16(jump))
        self.keys = self._key(self._word(heads, self.least - self.block), self._word(heads, 0))
        self.order = np.argsort(self.keys, kind="stable")
        self.keys = self.keys[self.order]

    def _word(self, heads: np.ndarray, at: int) -> np.ndarray:
        """Blocks of all patterns at one place, as numbers."""
        padded = np.zeros((len(heads), 8), dtype=np.uint8)
        padded[:, : self.block] = heads[:, at : at + self.block]
        return padded.view(np.uint64).ravel()

    def _place(self, words: np.ndarray) -> np.ndarray:
        return ((words * _SPREAD) >> np.uint64(64 - self.bits)).astype(np.int32)

    def _key(self, suffix: np.ndarray, prefix: np.ndarray) -> np.ndarray:
        """Hash of a suffix block and of the block in front, by which patterns are selected."""
        return (suffix * _SPREAD) ^ (prefix + (prefix >> np.uint64(29)))

    def occurrences(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Position and pattern number of every occurrence; ``text`` has eight bytes to spare."""
        size = len(text) - 8
        blocks = np.lib.stride_tricks.as_strided(text, (len(text) - 7, 8), (1, 1))
        # Each cursor stands on the last byte of a possible pattern head, in its own segment.
        limit = np.minimum(np.arange(0, size, _SEGMENT) + _SEGMENT, size).astype(np.int32)
        cursor = np.maximum(np.arange(0, size, _SEGMENT), self.least - 1).astype(np.int32)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while True:
            live = cursor < limit
            cursor, limit = cursor[live], limit[live]
            if not len(cursor):
                break
            suffix = blocks[cursor - (self.block - 1)].view(np.uint64).ravel() & self.mask
            jump = self.shift[self._place(suffix)]
            stopped = np.flatnonzero(jump == 0)
            if len(stopped):
                at = cursor[stopped] - (self.least - 1)
                key = self._key(suffix[stopped], blocks[at].view(np.uint64).ravel() & self.mask)
                first = np.searchsorted(self.keys, key)
                met = np.flatnonzero(self.keys[np.minimum(first, len(self.keys) - 1)] == key)
                if len(met):
                    found.append((at[met], first[met], np.searchsorted(self.keys, key[met], side="right")))
            cursor = cursor + np.maximum(jump, 1)
        if not found:
            none = np.empty(0, dtype=np.int64)
            return none, none
        return self._confirmed(text[:size].tobytes(), *(np.concatenate(x) for x in zip(*found, strict=True)))

    def _confirmed(self, text: bytes, at: np.ndarray, first: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Patterns that stand at their positions, compared in slices of candidates."""
        many = stop - first
        ends = np.cumsum(many)
        places, numbers = [], []
        for low in range(0, int(ends[-1]), _SLICE):
            # Candidates low, low+1, ...: which position each belongs to, and which of its patterns it is.
            candidate = np.arange(low, min(low + _SLICE, int(ends[-1])))
            owner = np.searchsorted(ends, candidate, side="right")
            pattern = self.order[first[owner] + candidate - (ends - many)[owner]]
            place = at[owner]
            sure = [text.startswith(self.patterns[p], a) for a, p in zip(place.tolist(), pattern.tolist(), strict=True)]
            sure = np.array(sure, dtype=bool)
            places.append(place[sure].astype(np.int64))
            numbers.append(pattern[sure])
        return np.concatenate(places), np.concatenate(numbers)


class Windows:
    """Distinct windows of a block of items, in pattern sets of similar length."""

    def __init__(self, items: Iterable[tuple[int, str | None]], window: int):
        owners: dict[bytes, set[int]] = defaultdict(set)
        rows = list(items)
        words = scan([(t or "").encode() for _, t in rows], NOT_ALNUM, lower=True)
        text, offsets = words.joined()
        text = text.tobytes()
        for i, (item, _) in enumerate(rows):
            parts = text[offsets[i] : offsets[i + 1]].split()
            if parts and item is not None:
                for k in range(max(1, len(parts) - window + 1)):
                    owners[b" " + b" ".join(parts[k : k + window]) + b" "].add(item)
        # One short pattern would shorten every jump, so patterns are searched by length class.
        classes: dict[int, list[bytes]] = defaultdict(list)
        for pattern in sorted(owners):
            classes[min(len(pattern) // 8, 4)].append(pattern)
        self.sets = [PatternSet(p) for p in classes.values()]
        self.items = [[sorted(owners[p]) for p in s.patterns] for s in self.sets]
        self.lengths = [np.array([p.count(b" ") - 1 for p in s.patterns], dtype=np.int64) for s in self.sets]


def _search(windows: Windows, texts: list[bytes]) -> tuple[np.ndarray, list[list[tuple[int, int, list[int]]]]]:
    """Words of each text, and the hits of each: first word, word behind the last, items."""
    words = scan(texts, NOT_ALNUM, lower=True)
    text, offsets = words.joined()
    # A leading space per text: every text starts behind the space of the one before.
    text = np.concatenate([[np.uint8(0x20)], text, np.zeros(8, dtype=np.uint8)])
    word_at = np.flatnonzero(text[:-9] == 0x20)
    hits: list[list[tuple[int, int, list[int]]]] = [[] for _ in texts]
    for patterns, items, lengths in zip(windows.sets, windows.items, windows.lengths, strict=True):
        at, number = patterns.occurrences(text)
        begin = np.searchsorted(word_at, at)
        stop = begin + lengths[number]
        doc = np.searchsorted(words.first, begin, side="right") - 1
        inside = stop <= words.first[doc + 1]
        for d, b, s, n in zip(*(x[inside].tolist() for x in (doc, begin, stop, number)), strict=True):
            hits[d].append((b - int(words.first[d]), s - int(words.first[d]), items[n]))
    return words.counts, hits


def _pass_over(docs: DataFrame, items: list[tuple[int, str | None]], text: str, window: int) -> DataFrame:
    """Add the hits of one block of items to ``hits``, and set ``n_words``."""
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(shared.value, window)
        for rows, texts in chunks(batches, text, TEXT_BYTES):
            counts, hits = _search(windows, texts)
            earlier = rows["hits"].to_pylist()
            merged = [
                old + [{"begin": b, "stop": s, "items": i} for b, s, i in new] if new else old
                for old, new in zip(earlier, hits, strict=True)
            ]
            rows = rows.set_column(rows.schema.get_field_index("n_words"), "n_words", pa.array(counts.astype(np.int64)))
            column = pa.array(merged, rows.schema.field("hits").type)
            rows = rows.set_column(rows.schema.get_field_index("hits"), "hits", column)
            yield from rows.combine_chunks().to_batches()

    return docs.mapInArrow(run, docs.schema)


def _blocks(benchmark: DataFrame, item_id: str, text: str, limit: int) -> Iterator[list[tuple[int, str | None]]]:
    """Items in blocks of at most ``limit`` text bytes (or one item), streamed to the driver."""
    held, size = [], 0
    for item, passage in benchmark.select(F.col(item_id).cast("long"), text).toLocalIterator():
        if held and size + len(passage or "") * 4 > limit:
            yield held
            held, size = [], 0
        held.append((item, passage))
        size += len(passage or "") * 4
    if held:
        yield held


def find_passages(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    item_bytes: int = ITEM_BYTES,
) -> DataFrame:
    """Add ``n_words`` and ``hits``: every occurrence of a window of ``window`` item words.

    A hit has the first word, the word behind the last, and the items that hold the window. An
    item with fewer words is one window; one without words or without id has none. Every item is
    searched: blocks of ``item_bytes`` are broadcast one pass at a time.

    A null text has no words. All rows and other columns pass as they are; columns named like
    the two results are replaced. Repeated items and ids are reported once per hit.
    """
    found = docs.drop("n_words", "hits").withColumns(
        {"n_words": F.lit(None).cast("long"), "hits": F.array().cast(HITS)}
    )
    passes = 0
    for block in _blocks(benchmark, item_id, item_text, item_bytes):
        found = _pass_over(found, block, text, window)
        passes += 1
    return found if passes else _pass_over(found, [], text, window)


def covered_words(hits: str = "hits"):
    """Number of distinct words under any hit, in one sweep over the hits in order."""
    step = F.aggregate(
        F.array_sort(F.col(hits), lambda a, b: a["begin"] - b["begin"]),
        F.struct(F.lit(0).alias("reach"), F.lit(0).cast("long").alias("words")),
        lambda s, h: F.struct(
            F.greatest(s["reach"], h["stop"]).alias("reach"),
            (s["words"] + F.greatest(h["stop"] - F.greatest(h["begin"], s["reach"]), F.lit(0))).alias("words"),
        ),
    )
    return step["words"]


def matched_items(hits: str = "hits"):
    """Distinct items of all hits."""
    return F.array_distinct(F.flatten(F.transform(F.col(hits), lambda h: h["items"])))
