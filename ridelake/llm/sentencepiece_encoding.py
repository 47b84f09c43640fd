"""SentencePiece encoding and decoding through a table of distinct marked words.

A text is normalised to markers (every space becomes one, and one stands in front), and cut
before each run of markers. Where no piece of the model holds a marker behind another character,
no merge crosses such a cut, so each distinct marked word is segmented once and its ids are
joined back by position. The table of a task is dropped when it grows over ``table_rows`` words,
which bounds memory and changes no result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ridelake.llm.text import CHUNK_BYTES, chunks

MARK = "▁"
TABLE_ROWS = 300_000


def load_model(path: str):
    """Processor of a model file whose pieces do not cross whitespace markers."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    crossing = [
        p for p in map(model.id_to_piece, range(model.get_piece_size())) if MARK in p.lstrip(MARK)
    ]
    if crossing:
        raise ValueError(f"{len(crossing)} pieces cross a whitespace marker, such as {crossing[0]!r}")
    return model


class WordTable:
    """Distinct marked words with their ids and decoded text, in order of first use."""

    def __init__(self, model, limit: int):
        self.model, self.limit = model, limit
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.ids: list[pa.Array] = []
        self.counts: list[np.ndarray] = []
        self.decoded: list[str] = []

    def add(self, words: set[str]) -> None:
        """Segment the words that the table lacks."""
        new = [w for w in words if w not in self.number]
        if not new:
            return
        # A marked word is a text of its own once the marker that the library puts in front is off.
        encoded = self.model.encode([w[1:].replace(MARK, " ") for w in new], num_threads=1)
        single = self.model.piece_to_id(MARK)
        encoded = [ids if w != MARK else [single] for w, ids in zip(new, encoded, strict=True)]
        self.decoded += [" " + text for text in self.model.decode(encoded)]
        self.counts.append(np.fromiter(map(len, encoded), dtype=np.int64, count=len(new)))
        self.ids.append(np.fromiter((i for ids in encoded for i in ids), dtype=np.int32))
        start = len(self.number)
        self.number.update(zip(new, range(start, start + len(new)), strict=True))

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all words, start and count of each word's ids."""
        self.ids, self.counts = [np.concatenate(self.ids)], [np.concatenate(self.counts)]
        counts = self.counts[0]
        return self.ids[0], np.cumsum(counts) - counts, counts


def _encode_chunk(table: WordTable, texts: list[bytes]) -> tuple[pa.Array, pa.Array]:
    if len(table.number) > table.limit:
        table.clear()
    cut = re.compile(f"{MARK}+[^{MARK}]*").findall
    words = [cut(MARK + t.decode().replace(" ", MARK)) if t else [] for t in texts]
    table.add(set().union(*words))
    per_text = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    if not per_text.sum():
        empty = pa.array([[]] * len(texts), pa.list_(pa.int32()))
        return empty, pa.array([""] * len(texts))
    ids, starts, counts = table.arrays()
    number, decoded = table.number, table.decoded
    used = np.fromiter((number[w] for ws in words for w in ws), dtype=np.int64, count=per_text.sum())
    sizes = counts[used]
    ends = np.cumsum(sizes)
    flat = ids[np.arange(ends[-1]) + np.repeat(starts[used] - ends + sizes, sizes)]
    offsets = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(per_text)])]
    texts_out = ["".join([decoded[number[w]] for w in ws])[1:] for ws in words]
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat)), pa.array(texts_out, pa.string())


def encode_documents(
    docs: DataFrame, model_path: str, *, text: str = "text", table_rows: int = TABLE_ROWS
) -> DataFrame:
    """Add ``piece_ids`` (array<int>) and ``decoded`` (the library's decoding of them).

    No begin or end ids, no sampling. A null or empty text has no ids and decodes to an empty
    text; every other column and repeated rows pass as they are. Columns named like the two
    results are replaced. The model is read by each task from ``model_path``.
    """
    kept = docs.drop("piece_ids", "decoded")
    schema = ", ".join(
        [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields]
        + ["piece_ids array<int>", "decoded string"]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None
        for rows, texts in chunks(batches, text, CHUNK_BYTES // 2):
            table = table or WordTable(load_model(model_path), table_rows)
            ids, decoded = _encode_chunk(table, texts)
            rows = rows.append_column("piece_ids", ids).append_column("decoded", decoded)
            yield from rows.combine_chunks().to_batches()

    return kept.mapInArrow(run, schema)
