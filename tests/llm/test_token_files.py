"""Token files: the code itself, and files against the tokenizer's own encoding."""

import functools
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from test_edge_cases import prose

from ridelake.llm import queries as llm
from ridelake.llm import token_files as tf

FOLDER = "/root/testdata/sf0.001"


@settings(deadline=None)
@given(st.lists(st.sampled_from([0, 1, 255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1])))
def test_code_round_trip(ranks):
    ranks = np.array(ranks, dtype=np.uint32)
    control, data = tf.coded(ranks)
    assert len(control) == -(-len(ranks) // 4)
    assert tf.decoded(control, data, len(ranks)).tolist() == ranks.tolist()


def test_code_layout():
    control, data = tf.coded(np.array([7, 256, 65536, 5, 9], dtype=np.uint32))
    assert control.tolist() == [0b00_10_01_00, 0]
    assert data.tolist() == [7, 0, 1, 0, 0, 1, 5, 9, 0, 0, 0]


@functools.cache
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(llm.tokenizer_file("word_bpe_49k.json"))


def expected(rows):
    """{(doc_id, start): (n, crc)} in id order; rows with one id are taken with equal texts only."""
    own, at, out = tokenizer(), 0, []
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*own.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        at += len(ids)
    return out


NASTY = [
    "don't DON'T it's 's' '' 'll", "İstanbul İ. Σίσυφος ΟΔΟΣ ΟΔΟΣ.", "é é ́x a ́", "<|endoftext|> a<|startoftext|>b",
    "\x00 a\x1cb\x85c d e　f", "１２ ½ ² 12ab 一二三 日本語のテキスト", "👩‍👩‍👧 🇫🇷 ﬁ ǅ ß ẞ", "\r\n\t\v\f ", "...,;:!?a.", "x" * 5000,
    "a'b 'tis ('s x's. don't. 'S 'LL've rock'n'roll '' 's't", "4.5,6'7'8é9 ½2 a1b2 _a_ __ a_b", "é.è! ×a a× ÷.÷ ñ'll É. Ç'S",
    "=\u0338a e\u0301. .\u0301a a\u0327.", "<|ENDOFTEXT|>", "x<|endoftext|>Y. <| |>", "\u00aa\u00b5.a\u02b0.b", "\u0130. \u0131'd", "\u00df. \u1e9e!",
]


def test_files_equal_the_tokenizer(spark, tmp_path):
    rows = [(5, None), (None, "no id"), (3, ""), (3, ""), (-7, prose(1, 30_000)), *[(100 + i, t) for i, t in enumerate(NASTY)]]
    rows += [(9, "same text twice")] * 2 + [(1000 + i, prose(i, 40)) for i in range(300)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, n_tokens string, start int")
    folder = f"{tmp_path}/files"
    # Small blocks, files and tables, so that each is begun many times.
    tf.write_token_files(
        docs.repartition(5), llm.tokenizer_file("word_bpe_49k.json"), folder, end_id=2, block_ids=100, file_bytes=2000
    )
    assert spark.read.parquet(f"{folder}/manifest").count() > 8
    found = tf.read_token_files(spark, folder).collect()
    assert sorted(((r.doc_id, r.start, r.n_tokens, zlib.crc32(r.ids)) for r in found), key=lambda r: r[1]) == expected(rows)
    ranks = spark.read.parquet(f"{folder}/ranks").orderBy("rank").collect()
    assert [r["count"] for r in ranks] == sorted((r["count"] for r in ranks), reverse=True)


def test_word_table_may_be_dropped(spark):
    docs = spark.createDataFrame([(i, prose(i, 300)) for i in range(40)], "doc_id long, text string")
    path = llm.tokenizer_file("word_bpe_49k.json")
    whole = tf.encode_ids(docs, path, 2).select("doc_id", "ids").collect()
    small = tf.encode_ids(docs, path, 2, table_rows=1).select("doc_id", "ids").collect()
    assert sorted(whole) == sorted(small)


def test_other_tokenizers_get_whole_texts(spark):
    """A tokenizer whose pieces hold spaces is called with whole texts."""
    path = llm.tokenizer_file("byte_bpe_50k.json")
    assert not tf._cuts_at_space(path) and tf._cuts_at_space(llm.tokenizer_file("word_bpe_49k.json"))
    from tokenizers import Tokenizer

    docs = spark.createDataFrame([(1, "two  words\n"), (2, None)], "doc_id long, text string")
    found = {r.doc_id: np.frombuffer(r.ids, dtype="<u2").tolist() for r in tf.encode_ids(docs, path, 7).collect()}
    assert found == {1: [*Tokenizer.from_file(path).encode("two  words\n").ids, 7], 2: [7]}


def test_no_documents_and_damaged_files(spark, tmp_path):
    path = llm.tokenizer_file("word_bpe_49k.json")
    empty = spark.createDataFrame([], "doc_id long, text string")
    tf.write_token_files(empty, path, f"{tmp_path}/empty", end_id=2)
    assert tf.read_token_files(spark, f"{tmp_path}/empty").collect() == []
    one = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    tf.write_token_files(one, path, f"{tmp_path}/one", end_id=2)
    (file,) = (tmp_path / "one" / "shards").iterdir()
    file.write_bytes(file.read_bytes()[:-1] + b"\xff")
    with pytest.raises(Exception, match="damaged"):
        tf.read_token_files(spark, f"{tmp_path}/one").collect()


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    found = llm.QUERIES["op11_token_output"](spark, FOLDER).collect()
    assert sorted((tuple(r) for r in found), key=lambda r: r[1]) == expected(rows)


@settings(deadline=None, max_examples=60)
@given(st.lists(st.text(alphabet=list("aZé9½'.!<|>-_ \t\n\x00\x1c\x85́İ̧×ßsdtlmrve一"), max_size=25), max_size=4))
def test_cut_words_give_the_tokenizers_ids(texts):
    words = tf._Words(llm.tokenizer_file("word_bpe_49k.json"), 2, 50)
    flat, bounds = words.encode([t.encode() for t in texts] or [b""])
    own = tokenizer()
    for i, text in enumerate(texts):
        assert flat[bounds[i] : bounds[i + 1]].tolist() == [*own.encode(text, add_special_tokens=False).ids, 2]


def test_words_are_looked_up_once_a_chunk():
    class Counted(dict):
        lookups = 0

        def get(self, *args):
            Counted.lookups += 1
            return super().get(*args)

        def __getitem__(self, key):
            Counted.lookups += 1
            return super().__getitem__(key)

    words = tf._Words(llm.tokenizer_file("word_bpe_49k.json"), 2, 50)
    one, _ = words.encode([b"so la ti"])
    words.clear()
    words.number = Counted()
    flat, bounds = words.encode([b"so la ti"] * 1000)
    assert flat.tolist() == one.tolist() * 1000 and len(bounds) == 1001
    assert Counted.lookups <= 6
