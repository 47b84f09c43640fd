"""URL filters: path rules of hosts, and exact membership of listed hosts by a Bloom filter cascade.

Level 0 of a cascade is a Bloom filter of the listed keys. Level 1 encodes the other keys of the
universe that level 0 wrongly accepts, level 2 the listed keys that level 1 wrongly accepts, and
so on until none is left. A key of the universe is listed if the first level that rejects it is
odd (or, rejected by none, if the last level is even), which is exact: rows need no join.

The universe is dealt to shards by a hash of the key, and each shard has a cascade of its own, so
no task holds more than one shard of keys. Cascades are broadcast in groups of bounded bytes.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values: (host suffix, path prefix, verdict) of the rules.
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
#: Labels of hosts whose hosts are listed by the query.
LISTED_LABELS = ["spam-farm", "cheap-pills", "casino-win", "free-bets", "ads-track", "adult-x"]
#: Keys per shard, and bytes of cascades that are broadcast at once.
SHARD_KEYS = 200_000
BROADCAST_BYTES = 64_000_000
FIRST_ERROR, NEXT_ERROR = 0.05, 0.5
_GOLDEN = 0x9E3779B97F4A7C15


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    cut = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.substring(url, cut + 3, F.length(url))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return (
        F.when(cut > 0, F.translate(host, upper, upper.lower())).otherwise(""),
        F.when(cut > 0, path).otherwise(""),
    )


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits; ties go to the first listed."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for suffix, prefix, verdict in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == suffix) | host.endswith(f".{suffix}")) & path.startswith(prefix)
        found = F.when(
            fits, F.struct(F.lit(suffix + prefix).alias("rule"), F.lit(verdict).alias("verdict"))
        ).otherwise(found)
    return found


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(33))


class Bloom:
    """Bits of one level; the probes of a key come from its hash and the level's number."""

    def __init__(self, bits: np.ndarray, probes: int, level: int):
        self.bits, self.probes, self.level = bits, probes, level

    @classmethod
    def of(cls, keys: np.ndarray, error: float, level: int) -> Bloom:
        size = max(64, math.ceil(-len(keys) * math.log(error) / math.log(2) ** 2))
        size = (size + 7) // 8 * 8
        probes = max(1, round(-math.log2(error)))
        flags = np.zeros(size, dtype=np.uint8)
        made = cls(flags, probes, level)
        for at in made._places(keys, size):
            flags[at] = 1
        made.bits = np.packbits(flags)
        return made

    def _places(self, keys: np.ndarray, size: int) -> Iterator[np.ndarray]:
        step = _mixed(keys + np.uint64((2 * self.level + 1) * _GOLDEN % (1 << 64)))
        for i in range(self.probes):
            yield (_mixed(step + np.uint64(i) * (keys | np.uint64(1))) % np.uint64(size)).astype(np.int64)

    def accepts(self, keys: np.ndarray) -> np.ndarray:
        found = np.ones(len(keys), dtype=bool)
        for at in self._places(keys, len(self.bits) * 8):
            found &= (self.bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
        return found


def build_cascade(listed: np.ndarray, others: np.ndarray) -> list[Bloom]:
    """Levels for two disjoint sets of 64-bit keys; empty if nothing is listed."""
    if len(np.intersect1d(listed, others)):
        raise ValueError("a listed key and another one have the same 64-bit hash")
    levels: list[Bloom] = []
    encoded, tested = listed, others
    while len(encoded):
        levels.append(Bloom.of(encoded, NEXT_ERROR if levels else FIRST_ERROR, len(levels)))
        encoded, tested = tested[levels[-1].accepts(tested)], encoded
    return levels


def in_cascade(levels: list[Bloom], keys: np.ndarray) -> np.ndarray:
    """Whether keys of the universe are listed."""
    verdict = np.full(len(keys), len(levels) % 2 == 1)
    open_ = np.arange(len(keys))
    for level in levels:
        accepted = level.accepts(keys[open_])
        verdict[open_[~accepted]] = level.level % 2 == 1
        open_ = open_[accepted]
    return verdict


def _stored(levels: list[Bloom]) -> bytes:
    return b"".join(struct.pack("<BI", b.probes, len(b.bits)) + b.bits.tobytes() for b in levels)


def _loaded(payload: bytes) -> list[Bloom]:
    levels, at = [], 0
    while at < len(payload):
        probes, size = struct.unpack_from("<BI", payload, at)
        at += 5
        levels.append(Bloom(np.frombuffer(payload, dtype=np.uint8, count=size, offset=at), probes, len(levels)))
        at += size
    return levels


def cascades(keys: DataFrame, shards: int) -> DataFrame:
    """(shard, cascade) from the universe (h, listed): distinct 64-bit keys with their flag."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column("shard").to_numpy(), b.column("h").to_numpy(), b.column("listed").to_numpy(zero_copy_only=False)) for b in batches]
        if not parts:
            return
        shard, h, listed = (np.concatenate(x) for x in zip(*parts, strict=True))
        h = h.view(np.uint64)
        made = {
            int(s): _stored(build_cascade(h[(shard == s) & listed], h[(shard == s) & ~listed])) for s in np.unique(shard)
        }
        yield pa.record_batch(
            [pa.array(list(made), pa.int32()), pa.array(list(made.values()), pa.binary())], names=["shard", "cascade"]
        )

    dealt = keys.withColumn("shard", _shard(F.col("h"), shards)).repartitionById(shards, "shard")
    return dealt.mapInArrow(run, "shard int, cascade binary")


def _shard(h: Column, shards: int) -> Column:
    return F.pmod(F.shiftright(h, 17), F.lit(shards)).cast("int")


def _groups(made: DataFrame, limit: int) -> Iterator[dict[int, bytes]]:
    """Cascades by shard, in groups of at most ``limit`` bytes (or one), streamed to the driver."""
    held: dict[int, bytes] = {}
    size = 0
    for shard, cascade in made.toLocalIterator():
        if held and size + len(cascade) > limit:
            yield held
            held, size = {}, 0
        held[shard] = bytes(cascade)
        size += len(cascade)
    if held:
        yield held


def mark_listed(
    rows: DataFrame,
    key: str,
    listed: DataFrame,
    *,
    shard_keys: int = SHARD_KEYS,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Add ``listed``: whether the key of a row is among the keys of ``listed`` (one column).

    The universe is every distinct key of ``rows``, so answers are exact for all of them; listed
    keys outside it are not needed. Equal keys are combined in each task before they are dealt
    out. A null key is not listed. Rows, also repeated ones, and other columns pass as they are.
    Builds the cascades at once; each group of ``broadcast_bytes`` makes one pass over the rows.
    """
    name = listed.columns[0]
    flagged = listed.select(F.col(name).alias("k"), F.lit(1).alias("f")).unionByName(
        rows.select(F.col(key).alias("k"), F.lit(0).alias("f"))
    )
    universe = (
        flagged.where(F.col("k").isNotNull())
        .groupBy("k")
        .agg(F.max("f").alias("f"), F.min("f").alias("own"))
        .where(F.col("own") == 0)
        .select(F.xxhash64("k").alias("h"), (F.col("f") == 1).alias("listed"))
    )
    shards = max(1, math.ceil(rows.select(F.approx_count_distinct(key)).first()[0] / shard_keys))
    found = rows.withColumn("listed", F.lit(False))
    context = rows.sparkSession.sparkContext

    def one_pass(frame: DataFrame, shared) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            loaded = {s: _loaded(p) for s, p in shared.value.items()}
            for batch in batches:
                h = batch.column("_h").to_numpy(zero_copy_only=False)
                shard = batch.column("_shard").to_numpy()
                verdict = batch.column("listed").to_numpy(zero_copy_only=False).copy()
                for s in np.unique(shard):
                    if int(s) in loaded:
                        mine = np.flatnonzero(shard == s)
                        verdict[mine] = in_cascade(loaded[int(s)], h[mine].view(np.uint64))
                at = batch.schema.get_field_index("listed")
                yield batch.set_column(at, "listed", pa.array(verdict))

        return frame.mapInArrow(run, frame.schema)

    found = found.withColumn("_h", F.xxhash64(key)).withColumn("_shard", _shard(F.col("_h"), shards))
    for group in _groups(cascades(universe, shards), broadcast_bytes):
        found = one_pass(found, context.broadcast(group))
    return found.withColumn("listed", F.col("listed") & F.col(key).isNotNull()).drop("_h", "_shard")


def judge_urls(
    pages: DataFrame,
    listed_hosts: DataFrame,
    *,
    page_id: str = "page_id",
    url: str = "url",
    rules: Sequence[tuple[str, str, str]] = RULES,
) -> DataFrame:
    """(page_id, host, path, rule, verdict): the longest rule's verdict, else block if listed.

    A null url, or one without ``://``, has an empty host and path. Repeated rows are judged each
    for itself; other columns are ignored.
    """
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    ruled = matching_rule(F.col("host"), F.col("path"), rules)
    judged = mark_listed(rows, "host", listed_hosts).withColumn("ruled", ruled)
    other = F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))
    return judged.select(
        "page_id",
        "host",
        "path",
        F.col("ruled.rule").alias("rule"),
        F.coalesce(F.col("ruled.verdict"), other).alias("verdict"),
    )
