"""Every query of the operators over the smallest tables: check SQL, or a plain version."""

from pathlib import Path

import brute_force as plain
import duckdb
import pytest

from ridelake.llm import queries as llm
from ridelake.llm.preference_format import format_preferences, neighbours

FOLDER = "/root/testdata/sf0.001"
TABLES = ["documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no sample tables")


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    return [(r.doc_id, r.text) for r in rows]


def by_id(spark, name):
    found = llm.QUERIES[name](spark, FOLDER).collect()
    assert len({r.doc_id for r in found}) == len(found)
    return {r.doc_id: r for r in found}


@pytest.mark.parametrize("name", sorted(llm.ORACLES))
def test_query_matches_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    found = llm.QUERIES[name](spark, FOLDER)
    expected = db.execute(llm.ORACLES[name])
    names = [d[0] for d in expected.description]
    assert sorted(found.columns) == sorted(names)
    ours = sorted((tuple(r[c] for c in names) for r in found.collect()), key=repr)
    assert ours == sorted(expected.fetchall(), key=repr)


def test_suffix_array_dedup(spark, docs):
    found = by_id(spark, "op1_suffix_array_dedup")
    expected = plain.repeated_strings(docs)
    assert {i: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for i, r in found.items()} == {
        i: (a, b, c, plain.sha(kept)) for i, (a, b, c, kept) in expected.items()
    }
    assert sum(r.n_removed for r in found.values()) > 0


def test_substring_dedup(spark, docs):
    found = by_id(spark, "op9_substring_dedup")
    expected = plain.repeated_runs(docs)
    assert {i: (r.n_words, r.n_removed, r.kept_sha256) for i, r in found.items()} == {
        i: (a, b, plain.sha(kept)) for i, (a, b, kept) in expected.items()
    }
    assert sum(r.n_removed for r in found.values()) > 0


def test_benchmark_decontamination(spark, docs):
    found = by_id(spark, "op4_benchmark_decontamination")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    expected = plain.passages(docs, items)
    for i, (n, hit, met) in expected.items():
        r = found[i]
        digest = plain.sha(",".join(sorted(map(str, met))))
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (n, hit, len(met), digest, hit > 0)


def test_quality_rules(spark, docs):
    found = by_id(spark, "op2_quality_rules")
    for i, text in docs:
        r = found[i]
        ours = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        assert ours == plain.statistics(text)
        assert not (r.kept and r.base_failed)


def test_secret_scans(spark, docs):
    found = by_id(spark, "op5_secret_scans")
    for i, text in docs:
        base = plain.base_secrets(text)
        r = found[i]
        assert r.base_sha256 == plain.sha(",".join(base))
        assert [s for s in r.spans.split(",") if s and not s.startswith("entropy")] == base
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(
            sum(b.startswith(k) for b in base) for k in ("assign", "access", "hex")
        )


def test_ngram_jaccard_join(spark, docs):
    found = by_id(spark, "op8_ngram_jaccard_join")
    assert {i: (r.n_shingles, r.component_id) for i, r in found.items()} == plain.groups(docs)


def test_sentencepiece_encoding(spark, docs):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=llm.tokenizer_file("piece_bpe_32k.model"))
    found = by_id(spark, "op10_sentencepiece_encoding")
    for i, text in docs:
        ids = model.encode(text or "")
        r = found[i]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == plain.sha(",".join(map(str, ids)))
        assert r.decoded_sha256 == plain.sha(model.decode(ids))


def test_license_scans(spark, docs):
    lines = {
        "Licensed under CC BY-NC": "cc-by-nc",
        "GNU General Public License, version": "gpl",
        "Apache License, Version": "apache",
        "under the MIT License": "mit",
        "All rights reserved.": "proprietary",
    }
    found = by_id(spark, "op7_license_scans")
    for i, text in docs:
        families = sorted({family for line, family in lines.items() if line in (text or "")})
        assert found[i].families == ",".join(families)


def test_preferences_rebuild_the_conversations(spark):
    turns = spark.read.parquet(f"{FOLDER}/conversations.parquet")
    shown = {}
    for r in turns.orderBy("conv_id", "turn").collect():
        shown[r.conv_id] = shown.get(r.conv_id, "") + f"<|{r.role}|>\n{r.text}<|end|>\n"
    for r in format_preferences(neighbours(turns), turns).collect():
        assert r.prompt + r.chosen == shown[2 * r.pair_id]
        assert r.prompt + r.rejected == shown[2 * r.pair_id + 1]
