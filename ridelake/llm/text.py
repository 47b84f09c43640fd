"""Word scanning over whole chunks of documents with numpy.

A chunk is the UTF-8 of several documents joined by one separator byte. Scanning costs a few
vector operations per chunk, whatever the number of documents in it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 6_000_000

#: ``[\x20\x09-\x0D]``: what ends a word of the word operators.
BLANK = np.zeros(256, dtype=bool)
BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: ``[\x00-\x2F\x3A-\x60\x7B-\x7F]``: what ends a word once A-Z are lower-cased.
NOT_ALNUM = np.zeros(256, dtype=bool)
NOT_ALNUM[0x00:0x30] = NOT_ALNUM[0x3A:0x61] = NOT_ALNUM[0x7B:0x80] = True

_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))
_BASE = np.uint64(0x9E3779B97F4A7C15)
_CHECK_BASE = np.uint64(0xD1B54A32D192ED03)


def chunks(
    batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES
) -> Iterator[tuple[pa.Table, list[bytes]]]:
    """Rows of a task in runs of about ``limit`` text bytes, with their texts (null: empty).

    One row never splits, so a chunk holds at least one whole text.
    """
    held: list[pa.RecordBatch] = []
    texts: list[bytes] = []
    size = 0
    for batch in batches:
        values = batch.column(text).cast(pa.binary()).to_pylist()
        start = 0
        for i, value in enumerate(values):
            size += len(value or b"") + 1
            texts.append(value or b"")
            if size >= limit:
                held.append(batch.slice(start, i + 1 - start))
                yield pa.Table.from_batches(held), texts
                held, texts, size, start = [], [], 0, i + 1
        if start < len(values):
            held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held), texts


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (Murmur finalizer)."""
    h = h ^ (h >> np.uint64(33))
    h *= _MIX[0]
    h ^= h >> np.uint64(33)
    h *= _MIX[1]
    h ^= h >> np.uint64(33)
    return h


@dataclass
class Words:
    """Words of a chunk: byte ranges in ``buffer`` and the first word of each document."""

    buffer: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        """Document number of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def joined(self, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Kept words of all documents, each followed by one space, and the offset of each document."""
        starts, ends = (self.starts, self.ends) if keep is None else (self.starts[keep], self.ends[keep])
        inside = np.zeros(len(self.buffer) + 1, dtype=np.int8)
        inside[starts] += 1
        inside[ends + 1] -= 1
        out = self.buffer.copy()
        out[ends] = 0x20
        out = out[np.cumsum(inside[:-1], dtype=np.int8).view(bool)]
        sizes = np.concatenate([[0], np.cumsum(ends + 1 - starts)])
        kept_first = self.first if keep is None else np.concatenate([[0], np.cumsum(keep)])[self.first]
        return out, sizes[kept_first]


def scan(texts: list[bytes], separators: np.ndarray = BLANK, lower: bool = False) -> Words:
    """Words of a list of texts; ``separators`` says for each byte value whether it ends a word."""
    joined = b" " + b" ".join(texts) + b" " * 9
    if lower:
        joined = joined.translate(_LOWER)
    buffer = np.frombuffer(joined, dtype=np.uint8)
    outside = separators[buffer]
    edges = np.flatnonzero(outside[1:] != outside[:-1]) + 1
    starts, ends = edges[0::2], edges[1::2]
    sizes = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    bounds = np.concatenate([[0], np.cumsum(sizes)]) + 1
    return Words(buffer, starts, ends, np.searchsorted(starts, bounds))


def word_hashes(words: Words) -> np.ndarray:
    """64-bit hash of each word, read in steps of eight bytes; independent of process and position."""
    eight = np.lib.stride_tricks.as_strided(
        words.buffer[: len(words.buffer) - 7].view(np.uint8), (len(words.buffer) - 7, 8), (1, 1)
    )
    lengths = words.ends - words.starts
    hashes = mixed(lengths.astype(np.uint64) + _BASE)
    active, at, left = np.arange(len(lengths)), words.starts.copy(), lengths.copy()
    while len(active):
        loaded = eight[at].copy().view(np.uint64).ravel()
        short = left < 8
        drop = np.where(short, (8 - left) * 8, 0).astype(np.uint64)
        loaded = (loaded << drop) >> drop
        hashes[active] = mixed(hashes[active] ^ (loaded * _BASE))
        more = left > 8
        active, at, left = active[more], at[more] + 8, left[more] - 8
    return hashes


def rolled(hashes: np.ndarray, size: int, check: bool = False) -> np.ndarray:
    """Hash of every run of ``size`` consecutive values, by doubling; ``check`` takes another base.

    Runs over document bounds are included; callers leave them out.
    """
    base = _CHECK_BASE if check else _BASE
    if len(hashes) < size:
        return np.empty(0, dtype=np.uint64)
    total: np.ndarray | None = None
    done = 0
    span, power, block = 1, base, hashes
    while True:
        if size & span:
            if total is None:
                total = block
            else:
                n = len(hashes) - done - span + 1
                total = total[:n] * power + block[done : done + n]
            done += span
        if done == size:
            return mixed(total)
        block = block[:-span] * power + block[span:]
        with np.errstate(over="ignore"):
            power = power * power
        span *= 2
