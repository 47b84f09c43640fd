"""Exact join of documents by the Jaccard similarity of their word n-grams.

Equal sets are collapsed to the smallest id. Members of a set are put in one global order, rare
ones first (counts come from a fixed-size sketch over all documents; ties by hash). Similar sets
share one of their first ``n - ceil(t * n) + 1`` members, so lists of these prefix members give
all candidates. Candidates are compared in prefix trees, and linked sets joined to components.

A list says how many members each of its sets has left from the shared one on. Similar sets have
enough left for all that they must share where their first shared member stands, so a pair for
which either has less left is not a candidate of this list, and a set without a partner leaves it.

A long list is not turned into all its pairs. It is cut into stars first, each document being
compared with the one of its star that has the fewest rarer members, which joins groups of near
copies; then only those pairs of the list are compared whose documents are still in different
components. A pair that is left out is in one component already, so components are exact, whatever
the length of a list. Lists are gathered in tiles of bounded size, and pairs sent in bounded runs.

Before sets travel, candidates exchange histograms of them: the distance of two histograms is at
most the number of members that only one of the sets has, which rules out most chance candidates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridelake.llm import packed
from ridelake.llm.components import components
from ridelake.llm.prefix_tree import build, search
from ridelake.llm.text import BLANK, chunks, mixed, rolled, scan, word_hashes
from ridelake.operators.scale import materialized

SHINGLE = 5
PERCENT = 75
#: Counters of the member sketch; its size does not depend on the data.
SKETCH_BITS = 18
_SKETCH_PARTS = 16
#: Lists up to this length give all pairs at once; longer ones are cut into stars of about STAR.
SHORT_LIST = 4
STAR = 64
#: A list that spans several components is gathered in tiles of about this many sets.
TILE = 4096
#: Pairs that a task holds before it sends them.
HELD_PAIRS = 1_000_000
LIST = -2
SETS = "doc_id long, n_shingles long, h1 long, h2 long, bucket int, owner int, payload binary"


def shingle_sets(texts: list[bytes], shingle: int = SHINGLE) -> list[np.ndarray]:
    """Sorted 64-bit hashes of the distinct runs of ``shingle`` lower-cased words of each text.

    Fewer words are one run of their own; a text without words has an empty set.
    """
    words = scan(texts, BLANK, lower=True)
    single = word_hashes(words)
    runs = rolled(single, shingle)
    sets = []
    for low, high in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if high - low >= shingle:
            sets.append(np.unique(runs[low : high - shingle + 1]))
        elif high > low:
            sets.append(mixed(rolled(single[low:high], high - low) + np.uint64(high - low)))
        else:
            sets.append(np.empty(0, dtype=np.uint64))
    return sets


def set_hashes(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each set."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    ends = np.cumsum(sizes)
    flat = np.concatenate([*sets, np.empty(0, dtype=np.uint64)])
    out = []
    for salt in (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)):
        # Differences of running sums, modulo 2**64: a sum over each set, in any order.
        running = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mixed(flat * salt + salt))])
        total = running[ends] - running[ends - sizes]
        out.append(mixed(total + sizes.astype(np.uint64) * salt).view(np.int64))
    return out[0], out[1]


def _described(shingle: int):
    """Size and hashes of every document's set, and the task's share of the sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
        for rows, texts in chunks(batches):
            sets = shingle_sets(texts, shingle)
            h1, h2 = set_hashes(sets)
            for s in sets:
                counts[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)] += 1
            n = len(sets)
            none = pa.nulls(n, pa.int32())
            sizes = pa.array([len(s) for s in sets], pa.int64())
            columns = [rows["doc_id"].combine_chunks(), sizes, pa.array(h1), pa.array(h2), none, none, pa.nulls(n, pa.binary())]
            yield pa.record_batch(columns, names=["doc_id", "n_shingles", "h1", "h2", "bucket", "owner", "payload"])
        if counts.any():
            parts = np.split(counts, _SKETCH_PARTS)
            used = [(i, np.flatnonzero(p), p) for i, p in enumerate(parts)]
            rows = [(i, -1, packed.pack(at, p[at])) for i, at, p in used if len(at)]
            piece = packed.piece_rows(rows)
            none = pa.nulls(len(rows), pa.int64())
            yield pa.record_batch(
                [none, none, none, none, *piece.columns],
                names=["doc_id", "n_shingles", "h1", "h2", "bucket", "owner", "payload"],
            )

    return run


def _summed(bucket: int, payloads: list[bytes]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((1 << SKETCH_BITS) // _SKETCH_PARTS, dtype=np.int64)
    for payload in payloads:
        at, counts = packed.unpack(payload)
        total[at] += counts
    yield packed.piece_rows([(bucket, -1, packed.pack(total))])


def _sketch(described: DataFrame) -> np.ndarray:
    """Member counts of all documents: ``2 ** SKETCH_BITS`` numbers, whatever the input."""
    pieces = described.where("payload is not null").select("bucket", "owner", "payload")
    counts = np.zeros((_SKETCH_PARTS, (1 << SKETCH_BITS) // _SKETCH_PARTS), dtype=np.int64)
    for bucket, _, payload in packed.by_bucket(pieces, "bucket", _summed, packed.PIECES).collect():
        counts[bucket] = packed.unpack(bytes(payload))[0]
    return counts.ravel()


def _own_sets(rows: pa.Table, texts: list[bytes], shingle: int) -> list[np.ndarray]:
    """Sets of rows that stand for their class; others (another text of the same id) are empty."""
    sets = shingle_sets(texts, shingle)
    h1, h2 = set_hashes(sets)
    mine = (h1 == rows["h1"].to_numpy()) & (h2 == rows["h2"].to_numpy())
    return [s if ok else s[:0] for s, ok in zip(sets, mine.tolist(), strict=True)]


def _prefix_pieces(shingle: int, percent: int, buckets: int, counts):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in chunks(batches):
            sets = _own_sets(rows, texts, shingle)
            sizes = np.array([len(s) for s in sets], dtype=np.int64)
            if not sizes.sum():
                continue
            members = np.concatenate(sets)
            doc = np.repeat(np.arange(len(sets)), sizes)
            often = counts.value[(members >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
            order = np.lexsort((members, often, doc))
            place = np.arange(len(order)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            # At least ceil(t * n) members are shared, so one of the first n - ceil(t * n) + 1 is.
            reach = sizes - (percent * sizes + 99) // 100 + 1
            kept = place < reach[doc]
            member, doc = members[order[kept]], doc[kept]
            ids = rows["doc_id"].to_numpy()
            left = sizes[doc] - place[kept]
            parts = packed.split(packed.bucket_of(member, buckets), member, ids[doc], sizes[doc], left)
            yield packed.piece_rows([(b, -1, packed.pack(*columns)) for b, columns in parts])

    return run


def _largest_partner(size: np.ndarray, left: np.ndarray, percent: int) -> np.ndarray:
    """Size of the largest set that can be similar to one with ``left`` members from the first shared one on."""
    # Similar sets share at least percent / (100 + percent) of their sizes' sum, all of it among what is left.
    return left * (100 + percent) // percent - size


def partnered(group: np.ndarray, size: np.ndarray, largest: np.ndarray) -> np.ndarray:
    """Whether each entry may have a partner in its group (numbered from 0, ascending): one whose size fits, and that it fits."""
    if not len(group):
        return np.empty(0, dtype=bool)
    span = int(max(size.max(), largest.max())) + 1
    order = np.lexsort((size, group))
    sizes = group[order] * span + size[order]
    reached = np.maximum.accumulate(group[order] * span + largest[order])
    # The last entry of the group whose size fits; up to it, the largest partner that any takes.
    last = np.searchsorted(sizes, group * span + largest, side="right") - 1
    return reached[np.maximum(last, 0)] >= np.where(last < 0, np.iinfo(np.int64).max, group * span + size)


def _hub_pieces(x: np.ndarray, y: np.ndarray, buckets: int) -> Iterator[tuple[int, bytes]]:
    """Candidate pairs, packed by a hash of the pair, to be made distinct there."""
    low, high = np.minimum(x, y), np.maximum(x, y)
    key = mixed(low.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ high.astype(np.uint64))
    for bucket, columns in packed.split(packed.bucket_of(key, buckets), low, high):
        yield bucket, packed.pack(*columns)


def _distinct_pairs(x: list[np.ndarray], y: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not x:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    a, b = np.concatenate(x), np.concatenate(y)
    low, high = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((high, low))
    low, high = low[order], high[order]
    fresh = np.concatenate([[True], (low[1:] != low[:-1]) | (high[1:] != high[:-1])])[: len(low)]
    fresh &= low != high
    return low[fresh], high[fresh]


def _listed(percent: int, buckets: int):
    """Candidates of each member's list: all pairs of short lists, the stars of long ones.

    A long list is also passed on whole, with owner ``LIST``.
    """

    def reduce(bucket: int, payloads: list[bytes]) -> Iterator[pa.RecordBatch]:
        member, doc, size, left = packed.concatenated(payloads, 4)
        order, starts, lengths = packed.groups(member)
        order = order[np.repeat(lengths > 1, lengths)]
        member, doc, size, left = member[order], doc[order], size[order], left[order]
        largest = _largest_partner(size, left, percent)
        order, starts, lengths = packed.groups(member)
        kept = order[partnered(np.repeat(np.arange(len(starts)), lengths), size[order], largest[order])]
        member, doc, size, left, largest = member[kept], doc[kept], size[kept], left[kept], largest[kept]
        order, starts, lengths = packed.groups(member)
        doc, size, left, largest = doc[order], size[order], left[order], largest[order]
        length = np.repeat(lengths, lengths)
        # Stars are drawn by a hash of the document, so that they agree from list to list.
        stars = 1 << np.ceil(np.log2(np.maximum(length / STAR, 1))).astype(np.int64)
        star = (mixed(doc.astype(np.uint64)) >> np.uint64(8)).astype(np.int64) & (stars - 1)
        group = np.repeat(np.arange(len(starts)), lengths)
        order = np.lexsort((doc, size - left, star, group))
        doc, size, left, largest, star = doc[order], size[order], left[order], largest[order], star[order]
        place = np.arange(len(doc)) - np.repeat(starts, lengths)
        low, high = [], []

        def pair(a: np.ndarray, b: np.ndarray) -> None:
            near = (size[a] <= largest[b]) & (size[b] <= largest[a])
            low.append(doc[a[near]])
            high.append(doc[b[near]])

        for step in range(1, SHORT_LIST):
            at = np.flatnonzero((length <= SHORT_LIST) & (place + step < length))
            pair(at, at + step)
        centre = np.concatenate([[True], (star[1:] != star[:-1]) | (group[1:] != group[:-1])])[: len(doc)]
        hub = np.flatnonzero(centre)[np.cumsum(centre) - 1] if len(doc) else place
        rest = np.flatnonzero((length > SHORT_LIST) & ~centre)
        pair(hub[rest], rest)
        hubs = np.flatnonzero(centre & (length > SHORT_LIST))
        chained = group[hubs[1:]] == group[hubs[:-1]]
        pair(hubs[:-1][chained], hubs[1:][chained])
        out = [(b, -1, p) for b, p in _hub_pieces(*_distinct_pairs(low, high), buckets)]
        for start, n in zip(starts[lengths > SHORT_LIST].tolist(), lengths[lengths > SHORT_LIST].tolist(), strict=True):
            own = slice(start, start + n)
            out.append((bucket, LIST, packed.pack(doc[own], size[own], left[own])))
        if out:
            yield packed.piece_rows(out)

    return reduce


def _memberships(buckets: int):
    """Distinct pairs, told to both documents: each sends its set to the smaller one's tree."""

    def reduce(bucket: int, payloads: list[bytes]) -> Iterator[pa.RecordBatch]:
        x, y = packed.concatenated(payloads, 2)
        low, high = _distinct_pairs([x], [y])
        hubs = np.unique(low)
        doc, hub = np.concatenate([high, hubs]), np.concatenate([low, hubs])
        found = packed.owner_pieces(doc, np.zeros(len(doc), dtype=np.int64), hub, buckets)
        yield packed.piece_rows([(bucket, o, p) for o, p in found])

    return reduce


def histogram(members: np.ndarray) -> np.ndarray:
    """Counts of a set by its top bits, some four members a bin; counts over 255 are cut."""
    bits = max(6, int(len(members) // 4).bit_length())
    counts = np.bincount((members >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return np.minimum(counts, 255)


def may_be_similar(a: np.ndarray, b: np.ndarray, n_a: int, n_b: int, percent: int) -> bool:
    """False only if histograms show that two sets of sizes n_a and n_b are not similar enough."""
    bins = min(len(a), len(b))
    apart = int(np.abs(a.reshape(bins, -1).sum(1) - b.reshape(bins, -1).sum(1)).sum())
    return apart * (100 + percent) <= (n_a + n_b) * (100 - percent)


def _set_pieces(shingle: int, buckets: int, encode):
    """``encode`` of each document's set, once for every hub bucket that needs it, with its hubs there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in chunks(batches):
            marks = [packed.unpack(m)[1] for m in rows["marks"].to_pylist()]
            sets = _own_sets(rows, texts, shingle)
            ids = rows["doc_id"].to_numpy()
            parts: dict[int, list[tuple[int, int, np.ndarray, np.ndarray]]] = {}
            for i, hubs in enumerate(marks):
                if len(sets[i]):
                    value, hubs = encode(sets[i]), np.unique(hubs)
                    for bucket, (own,) in packed.split(packed.owner_of(hubs, buckets), hubs):
                        parts.setdefault(bucket, []).append((int(ids[i]), len(sets[i]), own, value))
            out = []
            for bucket, entries in parts.items():
                ids_of, sizes, hubs, values = zip(*entries, strict=True)
                numbers = packed.pack(
                    np.array(ids_of, dtype=np.int64),
                    np.array(sizes, dtype=np.int64),
                    np.array([len(h) for h in hubs], dtype=np.int64),
                    np.array([len(v) for v in values], dtype=np.int64),
                    np.concatenate(hubs),
                    np.concatenate(values),
                )
                out.append((bucket, -1, numbers))
            if out:
                yield packed.piece_rows(out)

    return run


def _hub_groups(payloads: list[bytes]) -> tuple[list[tuple[int, int, np.ndarray]], dict[int, list[int]]]:
    """(id, set size, value) of all documents sent to a bucket, and their numbers by hub."""
    sent: list[tuple[int, int, np.ndarray]] = []
    by_hub: dict[int, list[int]] = {}
    for payload in payloads:
        ids, sizes, n_hubs, n_values, hubs, values = packed.unpack(payload)
        at, begin = np.cumsum(n_hubs) - n_hubs, np.cumsum(n_values) - n_values
        for i, (doc, size) in enumerate(zip(ids.tolist(), sizes.tolist(), strict=True)):
            sent.append((doc, size, values[begin[i] : begin[i] + n_values[i]]))
            for hub in hubs[at[i] : at[i] + n_hubs[i]].tolist():
                by_hub.setdefault(hub, []).append(len(sent) - 1)
    return sent, by_hub


def _near_histograms(percent: int, buckets: int):
    """Candidates that their histograms leave, told to both documents."""

    def reduce(bucket: int, payloads: list[bytes]) -> Iterator[pa.RecordBatch]:
        sent, by_hub = _hub_groups(payloads)
        doc, at = [], []
        for hub, numbers in by_hub.items():
            own = [sent[i] for i in numbers if sent[i][0] == hub]
            left = [
                sent[i][0]
                for i in numbers
                if sent[i][0] != hub and any(may_be_similar(h, sent[i][2], n, sent[i][1], percent) for _, n, h in own)
            ]
            if left:
                doc += [hub, *left]
                at += [hub] * (len(left) + 1)
        if doc:
            found = packed.owner_pieces(np.array(doc), np.zeros(len(doc), dtype=np.int64), np.array(at), buckets)
            yield packed.piece_rows([(bucket, o, p) for o, p in found])

    return reduce


class _Forest:
    """Union of ids; keeps the links that join two groups."""

    def __init__(self):
        self.parent: dict[int, int] = {}
        self.links: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        path = []
        while (up := self.parent.setdefault(x, x)) != x:
            path.append(x)
            x = up
        for p in path:
            self.parent[p] = x
        return x

    def link(self, a: int, b: int) -> None:
        x, y = self.root(a), self.root(b)
        if x != y:
            self.parent[max(x, y)] = min(x, y)
            self.links.append((a, b))


def _compared(percent: int):
    """Links of each hub with the sets in its tree."""

    def reduce(bucket: int, payloads: list[bytes]) -> Iterator[pa.RecordBatch]:
        sent, by_hub = _hub_groups(payloads)
        forest = _Forest()
        for hub, numbers in by_hub.items():
            probes = [sent[i][2] for i in numbers if sent[i][0] == hub]
            others = [sent[i] for i in numbers if sent[i][0] != hub]
            if probes and others:
                tree = build([members for _, _, members in others])
                for probe in probes:
                    for k in search(tree, probe, percent):
                        forest.link(hub, others[k][0])
        if forest.links:
            a, b = zip(*forest.links, strict=True)
            yield packed.piece_rows([(bucket, LIST - 1, packed.pack(np.array(a), np.array(b)))])

    return reduce


def _split_lists(percent: int, buckets: int):
    """Pairs of tiles of long lists whose documents are in different components so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high, held = [], [], 0

        def sent() -> pa.RecordBatch:
            rows = [(b, -1, p) for b, p in _hub_pieces(*_distinct_pairs(low, high), buckets)]
            low.clear()
            high.clear()
            return packed.piece_rows(rows)

        names = ("docs", "sizes", "lefts", "components", "tiles")
        for batch in batches:
            for row in range(batch.num_rows):
                doc, size, left, part, tile = (np.array(batch.column(c)[row].values) for c in names)
                order = np.argsort(size, kind="stable")
                doc, size, left, part, tile = doc[order], size[order], left[order], part[order], tile[order]
                across = batch.column("across")[row].as_py()
                largest = _largest_partner(size, left, percent)
                # Sizes are sorted, so partners of a document end at a size bound.
                stop = np.searchsorted(size, largest, side="right")
                for i in range(len(doc)):
                    later = slice(i + 1, stop[i])
                    fit = (part[later] != part[i]) & (largest[later] >= size[i])
                    if across:
                        fit &= tile[later] != tile[i]
                    apart = i + 1 + np.flatnonzero(fit)
                    if len(apart):
                        low.append(np.full(len(apart), doc[i]))
                        high.append(doc[apart])
                        held += len(apart)
                    if held >= HELD_PAIRS:
                        yield sent()
                        held = 0
        if held:
            yield sent()

    return run


def _links(rows: DataFrame) -> DataFrame:
    """(u, v) of packed links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload in batch.column("payload").to_pylist():
                u, v = packed.unpack(payload)
                yield pa.record_batch([pa.array(u), pa.array(v)], names=["u", "v"])

    return rows.where(F.col("owner") == LIST - 1).mapInArrow(run, "u long, v long")


def _list_rows(rows: DataFrame) -> DataFrame:
    """(list, doc, size, left) of long lists; equal lists of several members count once, as that of the first member."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["list", "doc", "size", "left"]
        for batch in batches:
            for payload in batch.column("payload").to_pylist():
                doc, size, left = packed.unpack(payload)
                key = mixed(np.add.reduce(mixed(doc.astype(np.uint64) + np.uint64(len(doc))), keepdims=True))
                lists = np.repeat(key.view(np.int64), len(doc))
                yield pa.record_batch([pa.array(lists), pa.array(doc), pa.array(size), pa.array(left)], names=names)

    long_lists = rows.where(F.col("owner") == LIST).mapInArrow(run, "list long, doc long, size long, left long")
    # A pair that is similar fits at the first member that it shares, whose list leaves the most.
    return long_lists.groupBy("list", "doc", "size").agg(F.max("left").alias("left"))


def _tiled(lists: DataFrame) -> DataFrame:
    """Lists as rows of arrays; one over ``TILE`` entries gives a row for each tile and (``across``) each two tiles."""
    counts = lists.groupBy("list").agg(F.ceil(F.count("*") / TILE).alias("n_tiles"))
    tiled = lists.join(counts, "list").withColumn("tile", F.pmod(F.xxhash64("doc"), "n_tiles"))
    paired = tiled.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_tiles") - 1)))
    low, high = F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high")
    return paired.groupBy("list", low, high, (low != high).alias("across")).agg(
        F.collect_list("doc").alias("docs"),
        F.collect_list("size").alias("sizes"),
        F.collect_list("left").alias("lefts"),
        F.collect_list("component").alias("components"),
        F.collect_list("tile").alias("tiles"),
    )


def link_documents(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT
) -> DataFrame:
    """(doc_id, n_shingles, component_id): documents joined by ``percent`` of Jaccard similarity.

    ``component_id`` is the smallest id reachable by links, itself included. A text without words
    (or null) has an empty set and links with nothing. Rows that repeat an id are one node with
    the sets of all its rows, each row returned with its own size; a row without an id links with
    nothing and has no component. Other columns are ignored. N-grams are compared by 64-bit
    hashes. Runs its stages at once, with checkpoints in the shared folder.
    """
    buckets = packed.partitions(docs)
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    described = materialized(plain.mapInArrow(_described(shingle), SETS))
    counts = docs.sparkSession.sparkContext.broadcast(_sketch(described))
    rows = described.where("h1 is not null").select("doc_id", "n_shingles", "h1", "h2")
    linked = rows.where("doc_id is not null and n_shingles > 0")
    classes = materialized(linked.groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id")))
    texts = plain.where("doc_id is not null and text is not null")
    own = texts.repartition(buckets, "doc_id").join(classes.hint("shuffle_hash"), "doc_id")
    lists = own.mapInArrow(_prefix_pieces(shingle, percent, buckets, counts), packed.PIECES)
    listed = packed.by_bucket(lists, "bucket", _listed(percent, buckets), packed.PIECES)

    def compared(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Links of candidate pairs, and the rows of ``pairs`` that hold something else."""
        told = packed.by_bucket(pairs, "bucket", _memberships(buckets), packed.PIECES, through=True)

        def met(pieces: DataFrame) -> DataFrame:
            """Texts of the documents that have hubs."""
            marks = packed.marks_by_document(pieces.where(F.col("owner") >= 0))
            return own.join(marks.hint("shuffle_hash"), "doc_id")

        rough = met(told).mapInArrow(_set_pieces(shingle, buckets, histogram), packed.PIECES)
        near = packed.by_bucket(rough, "bucket", _near_histograms(percent, buckets), packed.PIECES)
        whole = met(near).mapInArrow(_set_pieces(shingle, buckets, lambda members: members), packed.PIECES)
        links = packed.by_bucket(whole, "bucket", _compared(percent), packed.PIECES)
        return links, told.where(F.col("owner") == LIST)

    # One job: the shuffle of the texts serves the prefixes and the trees.
    first = materialized(DataFrame.unionByName(*compared(listed)))
    repeated = linked.join(classes.withColumnRenamed("doc_id", "rep"), ["h1", "h2"]).groupBy("doc_id")
    several = repeated.agg(F.min("rep").alias("v"), F.max("rep").alias("top"), F.collect_set("rep").alias("reps"))
    same_id = several.where("v <> top").select(F.explode("reps").alias("u"), "v")
    links = _links(first).unionByName(same_id)
    joined = materialized(components(links))
    members = _list_rows(first)
    labelled = materialized(
        members.join(joined, members["doc"] == joined["node"], "left").select(
            "list", "doc", "size", "left", F.coalesce("component", "doc").alias("component")
        )
    )
    # Only lists over several components are gathered.
    open_lists = labelled.groupBy("list").agg(F.min("component").alias("a"), F.max("component").alias("b"))
    tiles = _tiled(labelled.join(open_lists.where("a <> b").select("list"), "list"))
    apart = materialized(tiles.mapInArrow(_split_lists(percent, buckets), packed.PIECES))
    if not apart.isEmpty():
        again, _ = compared(apart)
        joined = materialized(components(links.unionByName(_links(materialized(again)))))
    named = rows.join(classes.withColumnRenamed("doc_id", "rep"), ["h1", "h2"], "left")
    found = named.join(joined, named["rep"] == joined["node"], "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component", "rep")).otherwise(F.col("doc_id"))
    return found.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))
