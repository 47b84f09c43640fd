"""Token ids as binary files: frequency-ranked ids in a byte-aligned code with control bytes.

Documents are encoded once, and their ids written as a table. One aggregation counts the ids;
the most frequent id gets rank 0, so that the 256 most frequent ones take one byte. Ranks are
written in groups of four: a control byte holds their four byte counts, two bits each, and stands
apart from the data bytes, so that a reader looks up whole groups in a table of 256 masks.

A folder of token files holds ``shards`` (the files), ``manifest`` (a table of the files that
were committed, in order) and ``ranks`` (a table of rank, id and count). A file is a run of
blocks; a block is :data:`_HEADER`, then the ids of its documents, which of them are null, their
numbers of ids, the control bytes and the data bytes.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridelake.llm.text import BLANK, CHUNK_BYTES, chunks

#: Distinct words that a task holds (some 170 bytes each) before it begins a new table.
TABLE_ROWS = 500_000
#: Ids in a block, and bytes of a file, from which the next one is begun; documents never split.
BLOCK_IDS = 1_000_000
FILE_BYTES = 64_000_000
#: Bytes of ids that one task of the write sorts and codes.
TASK_BYTES = 256_000_000
MAGIC = b"RTOK0001"
#: Documents, ids, control bytes, data bytes, and the crc32 of what follows.
_HEADER = struct.Struct("<5I")

#: Which of the 16 bytes of four 32-bit ranks are stored, by control byte.
_SIZES = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3
MASKS = (np.arange(4) <= _SIZES[:, :, None]).reshape(256, 16)


def coded(ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Control bytes and data bytes of 32-bit ranks."""
    padded = np.zeros(-(-len(ranks) // 4) * 4, dtype="<u4")
    padded[: len(ranks)] = ranks
    sizes = (padded >= 1 << 8).astype(np.uint8) + (padded >= 1 << 16) + (padded >= 1 << 24)
    four = sizes.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    return control, padded.view(np.uint8)[MASKS[control].ravel()]


def decoded(control: np.ndarray, data: np.ndarray, count: int) -> np.ndarray:
    """The ranks of :func:`coded`."""
    stored = MASKS[control].ravel()
    out = np.zeros(len(stored), dtype=np.uint8)
    out[stored] = data
    return out.view("<u4")[:count]


def _cuts_at_space(path: str) -> bool:
    """Whether a tokenizer file treats every run between ASCII white space as a text of its own."""
    spec = json.loads(open(path, encoding="utf-8").read())
    normal = spec.get("normalizer") or {"type": "Sequence", "normalizers": []}
    plain = all(
        n["type"] in ("NFC", "Lowercase") or (n["type"] == "Replace" and n["pattern"].get("Regex") == r"\s+")
        for n in normal.get("normalizers", [normal])
    )
    parts = spec.get("pre_tokenizer") or {}
    first = parts.get("pretokenizers", [parts])[0]
    removed = first.get("type") == "Split" and first.get("invert") and first.get("behavior") == "Removed"
    # No alternative of the pattern may hold white space.
    pattern = first.get("pattern", {}).get("Regex", " ")
    spaced = re.search(r"(?<!\^)\\s|\[\^(?!\\s)|[ \t\n.]|\\[SWDnrt]", pattern)
    added = all(not re.search(r"\s", a["content"]) and not a["lstrip"] and not a["rstrip"] for a in spec["added_tokens"])
    return bool(plain and removed and not spaced and added and spec.get("post_processor") is None)


def _cut_classes() -> np.ndarray:
    """Class of each byte: 1 letter, 2 digit, 4 punctuation, 8 apostrophe, 0 any other."""
    classes = np.zeros(256, dtype=np.uint8)
    for byte in range(0x21, 0x7F):
        char = chr(byte)
        classes[byte] = 1 if char.isalpha() else 2 if char.isdigit() else 8 if char == "'" else 4
    return classes


_CLASS = _cut_classes()


def _boundaries(buffer: np.ndarray) -> np.ndarray:
    """Places before which a word may be cut: where the tokenizer's pattern always ends a match.

    Those are places behind a letter and before ASCII punctuation, the other way round (but for an
    apostrophe, which may begin a contraction), and around a digit beside ASCII. Letters are those
    of ASCII and Latin-1; other bytes are left as they are.
    """
    kind = _CLASS[buffer]
    latin = np.flatnonzero(buffer == 0xC3)
    latin = latin[~np.isin(buffer[np.minimum(latin + 1, len(buffer) - 1)], (0x97, 0xB7))]
    kind[latin] = 1
    kind[np.minimum(latin + 1, len(buffer) - 1)] = 1
    left, right = kind[:-1], kind[1:]
    cut = ((left == 1) & (right >= 4)) | ((left == 4) & (right == 1))
    cut |= ((left == 2) & (right > 0)) | ((right == 2) & (left > 0))
    return np.flatnonzero(cut) + 1


#: Words of lower-case ASCII and Latin-1 letters.
_LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")


def _word_ends(path: str, tokenizer) -> np.ndarray | None:
    """Which ids end a word, where the model marks those."""
    suffix = json.loads(open(path, encoding="utf-8").read())["model"].get("end_of_word_suffix")
    if not suffix:
        return None
    ends = np.zeros(max(tokenizer.get_vocab().values()) + 1, dtype=bool)
    ends[[i for token, i in tokenizer.get_vocab().items() if token.endswith(suffix)]] = True
    return ends


class _Words:
    """Distinct words of a task with their ids; number 0 is the end id."""

    def __init__(self, path: str, end_id: int, limit: int):
        # A task is one of many on its machine: no threads of its own.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cuts = _cuts_at_space(path)
        self.ends = _word_ends(path, self.tokenizer) if self.cuts else None
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.end_id, self.limit = end_id, limit
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.ids = [np.array([self.end_id], dtype=np.uint32)]
        self.counts = [np.array([1], dtype=np.int64)]

    def _cut(self, texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
        """Words of all texts, and how many each text has.

        A text that holds a special token is cut at white space only, and keeps its capitals.
        """
        if not self.cuts:
            return pa.array([t for t in texts if t], pa.binary()), np.array([1 if t else 0 for t in texts], dtype=np.int64)
        plain = [not any(s in t for s in self.special) for t in texts]
        buffer = np.frombuffer(b" ".join([b"", *[t.lower() if p else t for t, p in zip(texts, plain, strict=True)], b""]), np.uint8)
        bounds = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        at = _boundaries(buffer)
        at = at[np.array(plain)[np.searchsorted(bounds, at, side="right") - 1]]
        blank = BLANK[buffer]
        starts = blank[:-1] & ~blank[1:]
        starts[at - 1] = True
        # The words without the blanks between them, as one array over their bytes.
        kept = ~blank
        offsets = np.append(np.flatnonzero(np.concatenate([[False], starts])[kept]), np.count_nonzero(kept)).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(buffer[kept])])
        return words, np.diff(np.concatenate([[0], np.cumsum(starts)])[np.minimum(bounds, len(starts))])

    def _segment(self, new: list[bytes]) -> list[bytes]:
        """Add the ids of words to the table; returns the words in the order of the table.

        Words of letters only are one match of the tokenizer's pattern, whose last id alone ends a
        word, so that many of them are encoded as one text and told apart by those ids.
        """
        lettered = [w for w in new if _LETTERS.fullmatch(w)] if self.ends is not None else []
        lines = [b" ".join(lettered[i : i + 100]).decode() for i in range(0, len(lettered), 100)]
        found = self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)
        ids = np.fromiter(chain.from_iterable(e.ids for e in found), dtype=np.uint32)
        stops = np.flatnonzero(self.ends[ids]) + 1 if lettered else ids[:0]
        if len(stops) != len(lettered):
            lettered, ids, stops = [], ids[:0], ids[:0]
        taken = set(lettered)
        others = [w for w in new if w not in taken]
        found = self.tokenizer.encode_batch_fast([w.decode() for w in others], add_special_tokens=False)
        self.ids += [ids, np.fromiter(chain.from_iterable(e.ids for e in found), dtype=np.uint32)]
        self.counts += [np.diff(stops, prepend=0), np.fromiter(map(len, found), dtype=np.int64, count=len(found))]
        return lettered + others

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with the end id behind it, and where each text begins."""
        if len(self.number) > self.limit:
            self.clear()
        words, per_text = self._cut(texts)
        number = self.number
        # Python sees each distinct word of the chunk once, not each word.
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False)
        known = np.fromiter(map(number.get, distinct, repeat(0)), dtype=np.int32, count=len(distinct))
        missing = np.flatnonzero(known == 0)
        if len(missing):
            fresh = distinct[missing].tolist()
            new = self._segment(fresh)
            start = len(number) + 1
            number.update(zip(new, range(start, start + len(new)), strict=True))
            known[missing] = np.fromiter(map(number.__getitem__, fresh), dtype=np.int32, count=len(fresh))
        self.ids, self.counts = [np.concatenate(self.ids)], [np.concatenate(self.counts)]
        # Positions within a chunk fit 32 bits.
        counts = self.counts[0].astype(np.int32)
        starts = np.cumsum(counts, dtype=np.int32) - counts
        sizes = per_text + 1
        used = np.zeros(int(sizes.sum()), dtype=np.int32)
        inner = np.ones(len(used), dtype=bool)
        inner[np.cumsum(sizes) - 1] = False
        used[inner] = known[coded.indices.to_numpy()]
        per_word = counts[used]
        ends = np.cumsum(per_word, dtype=np.int32)
        places = np.repeat(starts[used] - ends + per_word, per_word)
        places += np.arange(len(places), dtype=np.int32)
        return self.ids[0][places], np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes)])]


def _binaries(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Runs of fixed-width numbers as one binary each."""
    data = pa.py_buffer(np.ascontiguousarray(values))
    offsets = pa.py_buffer((bounds * values.itemsize).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, offsets, data])


def encode_ids(
    docs: DataFrame, tokenizer_path: str, end_id: int, *, doc_id: str = "doc_id", text: str = "text",
    table_rows: int = TABLE_ROWS,
) -> DataFrame:
    """(doc_id, row, n_tokens, ids): the ids of each text with ``end_id`` behind them.

    ``ids`` are little-endian numbers of two bytes, or four where the vocabulary or the end id
    needs them; ``row`` numbers the rows of the input as they are read, and tells equal ones
    apart. A null or empty text has the end id only.
    """
    from tokenizers import Tokenizer

    width = id_type(max(Tokenizer.from_file(tokenizer_path).get_vocab_size(), end_id + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, row = None, TaskContext.get().partitionId() << 40
        for rows, texts in chunks(batches, "text", CHUNK_BYTES // 2):
            words = words or _Words(tokenizer_path, end_id, table_rows)
            flat, bounds = words.encode(texts)
            yield pa.record_batch(
                [
                    rows["doc_id"].combine_chunks(),
                    pa.array(np.arange(row, row + len(texts))),
                    pa.array(np.diff(bounds)),
                    _binaries(flat.astype(width), bounds),
                ],
                names=["doc_id", "row", "n_tokens", "ids"],
            )
            row += len(texts)

    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return plain.mapInArrow(run, "doc_id long, row long, n_tokens long, ids binary")


def id_type(size: int) -> np.dtype:
    return np.dtype("<u2" if size <= 1 << 16 else "<u4")


def rank_ids(encoded: DataFrame, width: np.dtype) -> pa.Table:
    """(rank, id, count) by falling count, then id. As long as the vocabulary, not the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            found = np.bincount(_values(batch.column("ids"), width))
            if len(found) > len(total):
                found[: len(total)] += total
                total = found
            else:
                total[: len(found)] += found
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used.astype(np.int64)), pa.array(total[used])], names=["id", "n"])

    counted = encoded.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    table = counted.toArrow()
    ids, n = (table[c].to_numpy() for c in ("id", "n"))
    order = np.lexsort((ids, -n))
    return pa.table({"rank": np.arange(len(ids)), "id": ids[order], "count": n[order]})


def _values(binaries: pa.Array, width: np.dtype) -> np.ndarray:
    """All numbers of a column of binaries."""
    offsets = np.frombuffer(binaries.buffers()[1], dtype=np.int32)[binaries.offset : binaries.offset + len(binaries) + 1]
    if not len(binaries) or offsets[-1] == offsets[0]:
        return np.zeros(0, dtype=width)
    return np.frombuffer(binaries.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]].view(width)


def _store(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", folder))


def _block(doc_ids: list[int | None], counts: np.ndarray, ranks: np.ndarray) -> bytes:
    control, data = coded(ranks)
    null = np.array([i is None for i in doc_ids], dtype=np.uint8)
    body = b"".join(
        [
            np.array([i or 0 for i in doc_ids], dtype="<i8").tobytes(),
            null.tobytes(),
            counts.astype("<u4").tobytes(),
            control.tobytes(),
            data.tobytes(),
        ]
    )
    return _HEADER.pack(len(doc_ids), len(ranks), len(control), len(data), zlib.crc32(body)) + body


def _read_blocks(stream) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Document ids, their null marks, their numbers of ids and all ranks of each block."""
    if stream.read(len(MAGIC)) != MAGIC:
        raise ValueError("not a token file")
    while head := stream.read(_HEADER.size):
        docs, ids, controls, bytes_, crc = _HEADER.unpack(head)
        body = stream.read(13 * docs + controls + bytes_)
        if zlib.crc32(body) != crc:
            raise ValueError("a block of a token file is damaged")
        at = np.cumsum([0, 8 * docs, docs, 4 * docs, controls, bytes_])
        types = ("<i8", np.uint8, "<u4", np.uint8, np.uint8)
        doc_ids, null, counts, control, data = (
            np.frombuffer(body[a:b], dtype=t) for a, b, t in zip(at[:-1], at[1:], types, strict=True)
        )
        yield doc_ids, null, counts, decoded(control, data, ids)


def write_token_files(
    docs: DataFrame,
    tokenizer_path: str,
    folder: str,
    *,
    end_id: int,
    doc_id: str = "doc_id",
    text: str = "text",
    block_ids: int = BLOCK_IDS,
    file_bytes: int = FILE_BYTES,
    task_bytes: int = TASK_BYTES,
) -> None:
    """Encode every text and write the ids in ascending ``doc_id`` order (null first).

    Rows that repeat an id follow one another in an order fixed by their ids. ``folder`` is one
    that driver and executors share and must not exist. A task that is run again writes files of new names;
    only those of the manifest count.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    width = id_type(max(Tokenizer.from_file(tokenizer_path).get_vocab_size(), end_id + 1))
    encode_ids(docs, tokenizer_path, end_id, doc_id=doc_id, text=text).write.parquet(f"{folder}/encoded")
    encoded = spark.read.parquet(f"{folder}/encoded")
    ranks = rank_ids(encoded, width)
    spark.createDataFrame(ranks).coalesce(1).write.parquet(f"{folder}/ranks")
    ids = ranks["id"].to_numpy()
    rank_of = np.zeros(int(ids.max()) + 1 if len(ids) else 1, dtype=np.uint32)
    rank_of[ids] = np.arange(len(ids))
    shared = spark.sparkContext.broadcast(rank_of)
    total = int(ranks["count"].to_numpy().sum()) * width.itemsize
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // task_bytes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _store(f"{folder}/shards")
        fs.create_dir(root, recursive=True)
        task, files, stream = TaskContext.get().partitionId(), [], None
        held, size = [], 0

        def flush():
            nonlocal held, size, stream
            counts = np.array([len(v) for _, v in held], dtype=np.int64) // width.itemsize
            ranked = shared.value[np.frombuffer(b"".join(v for _, v in held), dtype=width)]
            if stream is None:
                name = f"{task:06d}-{len(files):04d}-{uuid.uuid4().hex}.tok"
                files.append([name, task, len(files), 0, 0])
                stream = fs.open_output_stream(f"{root}/{name}")
                stream.write(MAGIC)
            stream.write(_block([i for i, _ in held], counts, ranked))
            files[-1][3] += len(held)
            files[-1][4] += int(counts.sum())
            held, size = [], 0
            if stream.tell() >= file_bytes:
                stream.close()
                stream = None

        for batch in batches:
            for key, value in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                held.append((key, value))
                size += len(value) // width.itemsize
                if size >= block_ids:
                    flush()
        if held:
            flush()
        if stream is not None:
            stream.close()
        columns = list(zip(*files, strict=True)) or [[]] * 5
        types = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
        yield pa.record_batch(
            [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["name", "task", "number", "n_docs", "n_ids"]
        )

    order = ["doc_id", "_digest", "row"]
    ranged = encoded.withColumn("_digest", F.xxhash64("ids")).repartitionByRange(tasks, *order)
    written = ranged.sortWithinPartitions(*order).select("doc_id", "ids").mapInArrow(
        run, "name string, task int, number int, n_docs long, n_ids long"
    )
    written.write.parquet(f"{folder}/written")
    # One row per file, whose order gives the first position of each.
    before = Window.orderBy("task", "number").rowsBetween(Window.unboundedPreceding, -1)
    files = spark.read.parquet(f"{folder}/written")
    starts = F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("start")
    files.select("name", "n_docs", "n_ids", starts).write.parquet(f"{folder}/manifest")


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document in the files of a folder.

    ``start`` counts the ids of all documents before it, ``ids`` are little-endian unsigned
    32-bit numbers. A damaged block raises.
    """
    ids = spark.read.parquet(f"{folder}/ranks").toArrow().sort_by("rank")["id"].to_numpy().astype("<u4")
    shared = spark.sparkContext.broadcast(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _store(f"{folder}/shards")
        for batch in batches:
            for name, at in zip(batch.column("name").to_pylist(), batch.column("start").to_pylist(), strict=True):
                with fs.open_input_stream(f"{root}/{name}") as stream:
                    for docs, null, counts, ranks in _read_blocks(stream):
                        counts = counts.astype(np.int64)
                        ends = np.cumsum(counts)
                        yield pa.record_batch(
                            [
                                pa.array(docs.astype(np.int64), mask=null.astype(bool)),
                                pa.array(at + ends - counts),
                                pa.array(counts),
                                _binaries(shared.value[ranks], np.concatenate([[0], ends])),
                            ],
                            names=["doc_id", "start", "n_tokens", "ids"],
                        )
                        at += int(ends[-1])

    files = spark.read.parquet(f"{folder}/manifest").select("name", "start")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return files.repartition(tasks, "name").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")
