"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import random
import sys
from pathlib import Path

import brute_force as plain
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from ridelake.llm import jaccard_join, license_scan, packed, preference_format, quality_rules, secret_scan, url_filter  # noqa: E402
from ridelake.llm.benchmark_search import covered_words, find_passages, matched_items  # noqa: E402
from ridelake.llm.components import components  # noqa: E402
from ridelake.llm.jaccard_join import histogram, link_documents, may_be_similar  # noqa: E402
from ridelake.llm.prefix_tree import build, search  # noqa: E402
from ridelake.llm.queries import tokenizer_file  # noqa: E402
from ridelake.llm.sentencepiece_encoding import encode_documents  # noqa: E402
from ridelake.llm.substring_dedup import drop_repeated_runs  # noqa: E402
from ridelake.llm.suffix_arrays import common_prefixes, suffix_array  # noqa: E402
from ridelake.llm.suffix_dedup import drop_repeated_strings  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = ["alpha", "beta", "Gamma", "delta-x", "épsilon", "ζeta", "eta", "theta", "iota", "kappa"]


def prose(seed, n):
    chosen = random.Random(seed)
    return " ".join(chosen.choice(WORDS) + str(chosen.randrange(40)) for _ in range(n))


LONG = "x" * 60_000 + " " + prose(99, 9000) + " same" * 3000
TEXTS = {
    1: prose(1, 300),
    2: prose(1, 300),
    3: prose(1, 150) + "\n" + prose(3, 150),
    4: None,
    5: "",
    6: " \t\n\x0b ",
    7: LONG,
    8: "tiny",
    9: prose(1, 290) + " changed",
    10: LONG + " more",
    11: "a " * 500,
    12: "𝔘nicode ñ 語 " * 30,
    13: "One Two three four five",
    14: "one two THREE four five",
}


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 2}", None if t is None else len(t)) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, list(TEXTS.items()))


@pytest.fixture(scope="module")
def odd(spark):
    """Repeated rows, one id with two texts, rows without id, and columns that clash."""
    rows = [(1, TEXTS[1]), (1, TEXTS[1]), (2, TEXTS[2]), (2, TEXTS[3]), (None, TEXTS[1]), (None, None)]
    clash = {c: F.lit(1) for c in ("sub", "marks", "bucket", "owner", "payload", "hits", "secrets", "piece_ids", "h1", "host")}
    return table(spark, rows).withColumns(clash)


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, [])


@pytest.mark.parametrize("seed", range(5))
def test_suffix_arrays_of_random_strings(seed):
    import numpy as np

    chosen = np.random.default_rng(seed)
    for _ in range(40):
        s = np.append(chosen.integers(1, chosen.integers(2, 6), chosen.integers(0, 80)), 0)
        ranked = sorted(range(len(s)), key=lambda i: s[i:].tolist())
        order = suffix_array(s, int(s.max()) + 1)
        assert order.tolist() == ranked
        data = np.concatenate([s.astype(np.uint8), np.zeros(64, dtype=np.uint8)])
        lengths = common_prefixes(data, order, 16)
        for i, before in zip(ranked[1:], ranked[:-1]):
            n = next(k for k in range(len(s)) if s[i + k] != s[before + k])
            assert lengths[i] == min(n, 16)


def test_repeated_strings(docs):
    found = {r.doc_id: r for r in drop_repeated_strings(docs).collect()}
    expected = plain.repeated_strings(TEXTS.items())
    assert {i: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept_bytes)) for i, r in found.items()} == expected


def test_repeated_strings_of_odd_rows(odd, empty):
    found = sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_removed) for r in drop_repeated_strings(odd).collect())
    size, other = len(TEXTS[1].encode()), len(TEXTS[3].encode())
    gone = plain.repeated_strings([(1, TEXTS[1]), (2, TEXTS[3])])[2][1]
    assert found == sorted(
        [(False, 1, size, 0), (False, 1, size, 0), (False, 2, size, size), (False, 2, other, gone), (True, 0, size, 0), (True, 0, 0, 0)]
    )
    assert drop_repeated_strings(empty).collect() == []


def test_repeated_runs(docs):
    found = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in drop_repeated_runs(docs).collect()}
    assert found == plain.repeated_runs(TEXTS.items())


def test_repeated_runs_of_odd_rows(odd, empty):
    found = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_removed) for r in drop_repeated_runs(odd).collect())
    # The two texts of id 2 count in text order; each repeats text 1.
    assert [f[:3] for f in found] == [(False, 1, 300), (False, 1, 300), (False, 2, 300), (False, 2, 300), (True, 0, 0), (True, 0, 300)]
    assert {f[3] for f in found if f[1] == 1 or f[0]} == {0}
    assert drop_repeated_runs(empty).collect() == []


@pytest.mark.parametrize("window", [1, 5, 20, 33])
def test_repeated_runs_of_other_windows(docs, window):
    found = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in drop_repeated_runs(docs, window=window).collect()}
    assert found == plain.repeated_runs(TEXTS.items(), window)


def test_passages(spark, docs, empty):
    items = [(1, prose(1, 40)), (2, "tiny"), (3, None), (4, ""), (5, "THREE four"), (5, "THREE four"), (None, "alpha"), (7, "a a")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    for limit in (16_000_000, 200):
        found = find_passages(docs, benchmark, item_bytes=limit)
        rows = found.select("doc_id", "n_words", covered_words().alias("hit"), matched_items().alias("items")).collect()
        known = [(i, t) for i, t in items if i is not None]
        assert {r.doc_id: (r.n_words, r.hit, set(r["items"])) for r in rows} == plain.passages(TEXTS.items(), known)
    assert find_passages(empty, benchmark).collect() == []
    nothing = find_passages(docs, benchmark.limit(0)).collect()
    assert len(nothing) == len(TEXTS) and not any(r.hits for r in nothing)


def test_passages_keep_rows_and_columns(spark, odd):
    benchmark = spark.createDataFrame([(1, prose(1, 40))], "item_id long, text string")
    found = find_passages(odd, benchmark)
    assert set(found.columns) == set(odd.columns) | {"n_words"}
    assert found.count() == odd.count()


def test_quality_statistics(docs):
    judged = {r.doc_id: r for r in quality_rules.judge_documents(docs).collect()}
    for i, text in TEXTS.items():
        r = judged[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain.statistics(text)


def test_quality_of_hosts(spark, odd, empty):
    good, bad = prose(5, 60), "too short"
    rows = [(i, good if i % 10 else bad, "en", "fine", 1) for i in range(40)]
    rows += [(100 + i, bad if i % 10 else good, "en", "junk", 1) for i in range(40)]
    rows += [(200, good, "en", None, 1), (None, good, None, "fine", None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    judged = quality_rules.judge_documents(docs).collect()
    kept = {r.host: set() for r in judged}
    for r in judged:
        kept[r.host].add(r.kept)
    assert kept == {"fine": {True, False}, "junk": {False}, None: {True}}
    rates = {r.host: r.shrunk_rate for r in judged}
    assert 0.1 < rates["fine"] < 0.2 and 0.8 < rates["junk"] < 0.9
    left = quality_rules.keep_documents(docs)
    assert left.columns == docs.columns and left.count() == 36 + 2
    assert quality_rules.judge_documents(odd).count() == 6
    assert quality_rules.judge_documents(empty).collect() == []
    assert quality_rules.keep_documents(empty).collect() == []


SECRET_TEXTS = [
    "password = hunter22 and token:'abc' secret=token:abcdefgh",
    'API_KEY="Zz9+/_.=-Zz9" apikey : ' + "x" * 5,
    "AKIA" + "Q7" * 8 + " AKIA" + "Q" * 15 + " AKIA" + "9" * 40,
    "deadbeef" * 3 + " " + "0" * 23 + " x" + "abc123" * 10,
    "ñé語 token=" + "k" * 6 + " 語 password:" + "9" * 5,
    "id Zx81kQw7Lp0sVt3nRy5uBm9e uuid 123e4567-e89b-12d3-a456-426614174000 example1234567890abcdefXYZ",
    "token" + " " * 500 + "= " + "A1b2C3d4E5f6G7h8I9j0" * 50,
]


def test_secrets(spark, docs, odd, empty):
    texts = SECRET_TEXTS + list(TEXTS.values())
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = secret_scan.find_secrets(frame)
    rows = found.select("doc_id", "text", "secrets", secret_scan.redacted(F.col("text"), F.col("secrets")).alias("clean")).collect()
    for r in rows:
        spans = [f"{s.kind}:{s.begin}:{s.stop}" for s in r.secrets]
        assert [s for s in spans if not s.startswith("entropy")] == plain.base_secrets(r.text)
        assert all(r.text[s.begin : s.stop] == s.value for s in r.secrets)
        clean, at = "", 0
        for begin, stop in sorted((s.begin, s.stop) for s in r.secrets):
            if stop > at:
                clean += (r.text[at:begin] + "[SECRET]") if begin >= at else ""
                at = stop
        assert r.clean == (clean + r.text[at:] if r.text is not None else None)
    by_id = {r.doc_id: [s.value for s in r.secrets if s.kind == "entropy"] for r in rows}
    assert "Zx81kQw7Lp0sVt3nRy5uBm9e" in by_id[5]
    assert not any("uuid" in v or "123e4567" in v or "example" in v for v in by_id[5])
    assert secret_scan.find_secrets(odd).count() == 6
    assert secret_scan.find_secrets(empty).collect() == []


def test_entropy_of_windows(spark):
    import math
    from collections import Counter

    values = ["a1" * 20, "abcdefghij0123456789", "Zx81kQw7Lp0sVt3nRy5uBm9e", "f" * 19 + "0" * 19 + "0123456789abcdef" * 3]
    frame = spark.createDataFrame([(v,) for v in values], "v string")
    for r in frame.select("v", secret_scan.highest_entropy(F.col("v")).alias("h")).collect():
        best = 0.0
        for i in range(len(r.v) - 19):
            counts = Counter(r.v[i : i + 20]).values()
            best = max(best, -sum(c / 20 * math.log2(c / 20) for c in counts))
        assert r.h == pytest.approx(best, abs=1e-9)


def test_url_verdicts(spark):
    urls = [
        (1, "https://A.Example.org/es/x?y"), (2, "http://example.org/en/12"), (3, "http://b.com/fr/"), (4, "http://b.com/de/"),
        (5, "ftp://spam-farm.example.net"), (6, "no scheme"), (7, None), (8, "http://"), (9, "x://notorg/"), (10, "a://b.org#f"),
        (11, "http://WWW.Spam-Farm.example.net/en?q"), (11, "http://WWW.Spam-Farm.example.net/en?q"),
    ]
    pages = spark.createDataFrame(urls, "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("listed", F.lit(1))
    listed = spark.createDataFrame([("spam-farm.example.net",), ("www.spam-farm.example.net",), ("unseen",)], "host string")
    found = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages, listed).collect()]
    assert sorted(found, key=lambda r: r[0]) == [
        (1, "a.example.org", "/es/x", "example.org/es/", "block"),
        (2, "example.org", "/en/12", "example.org/en/1", "block"),
        (3, "b.com", "/fr/", "com/fr/", "allow"),
        (4, "b.com", "/de/", "com/de/", "block"),
        (5, "spam-farm.example.net", "", None, "block"),
        (6, "", "", None, "allow"),
        (7, "", "", None, "allow"),
        (8, "", "", None, "allow"),
        (9, "notorg", "/", None, "allow"),
        (10, "b.org", "", None, "allow"),
        (11, "www.spam-farm.example.net", "/en", None, "block"),
        (11, "www.spam-farm.example.net", "/en", None, "block"),
    ]
    assert url_filter.judge_urls(pages.limit(0), listed).collect() == []
    assert {r.verdict for r in url_filter.judge_urls(pages.where("page_id > 4 and page_id < 8"), listed.limit(0)).collect()} == {"allow"}


@pytest.mark.parametrize(("shard_keys", "limit"), [(200_000, 64_000_000), (300, 400)])
def test_cascade_is_exact(spark, shard_keys, limit):
    rows = spark.range(3000).select(F.concat(F.lit("h"), F.col("id").cast("string")).alias("k")).unionByName(
        spark.createDataFrame([(None,)], "k string")
    )
    listed = rows.where("k rlike '7$'")
    found = url_filter.mark_listed(rows, "k", listed, shard_keys=shard_keys, broadcast_bytes=limit).collect()
    assert len(found) == 3001 and all(r.listed == bool(r.k and r.k.endswith("7")) for r in found)


def test_preferences(spark):
    turns = [
        (0, 0, "user", "hi"), (0, 1, "assistant", "yes"), (0, 2, "user", "more"), (0, 3, "assistant", "ok"),
        (1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 2, "user", "less"), (1, 2, "user", "less"),
        (2, 0, "user", None), (3, 0, "user", ""), (4, None, None, "x"), (6, 0, "user", "a"), (7, 0, "user", "a"), (7, 1, "assistant", "b"),
        (None, 0, "user", "lost"),
    ]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(0))
    pairs = preference_format.neighbours(frame)
    found = {r.pair_id: r for r in preference_format.format_preferences(pairs, frame).collect()}
    assert set(found) == {0, 1, 3}
    r = found[0]
    assert (r.n_prompt_turns, r.prompt) == (2, "<|user|>\nhi<|end|>\n<|assistant|>\nyes<|end|>\n")
    assert [r.chosen[m.begin : m.stop] for m in r.chosen_mask] == ["ok<|end|>\n"] and r.rejected_mask == []
    assert (found[1].n_prompt_turns, found[1].chosen, found[1].rejected) == (1, "", "")
    assert (found[3].chosen, [found[3].rejected[m.begin : m.stop] for m in found[3].rejected_mask]) == ("", ["b<|end|>\n"])
    assert preference_format.format_preferences(pairs, frame.limit(0)).collect() == []


def test_licenses(spark, docs, odd, empty):
    lines = [
        (1, "some words first\nLicensed under the Apache License, Version 2.0.\nand then more words"),
        (2, "This work is licensed under the GNU General Public License, version 2."),
        (3, "they said that all the rights of the licence were reserved for nobody at all"),
        (4, None), (5, ""), (None, "All rights reserved."), (7, "Released under the MIT License."), (7, "Released under the MIT License."),
    ]
    rows = spark.createDataFrame(lines, "doc_id long, text string").withColumn("family", F.lit("clash"))
    corpus = docs.select("doc_id", "text")
    model = license_scan.fit(corpus, plain_rows=500, template_rows=300)
    assert model.held_out_accuracy > 0.95
    found = sorted((r.doc_id or 0, r.paragraph, r.family) for r in license_scan.find_licenses(rows, model).where("confirmed").collect())
    assert found == [(0, 0, "proprietary"), (1, 1, "apache"), (2, 0, "gpl"), (7, 0, "mit"), (7, 0, "mit")]
    assert license_scan.find_licenses(docs, model).where("confirmed").collect() == []
    assert license_scan.find_licenses(odd, model).where("confirmed").collect() == []
    assert license_scan.find_licenses(empty, license_scan.fit(empty)).collect() == []


def test_linked_documents(docs):
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in link_documents(docs).collect()}
    assert found == plain.groups(TEXTS.items())


def test_linked_documents_of_odd_rows(odd, empty):
    found = sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in link_documents(odd).collect())
    n, other = len(plain.shingles(TEXTS[1])), len(plain.shingles(TEXTS[3]))
    assert found == sorted([(False, 1, n, 1), (False, 1, n, 1), (False, 2, n, 1), (False, 2, other, 1), (True, 0, n, 0), (True, 0, 0, 0)])
    assert link_documents(empty).collect() == []


def test_linked_documents_of_large_groups(spark):
    """Many near copies, chains of them, and one passage that all documents share."""
    chosen = random.Random(7)
    passage = prose(70, 30)
    rows = []
    for i in range(160):
        words = prose(71, 120).split()
        for _ in range(chosen.randrange(1, 5)):
            words[chosen.randrange(120)] = f"edit{chosen.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    rows += [(200 + i, prose(200 + i, 60) + " " + passage) for i in range(120)]
    # A chain: each is near the next one, the ends are far apart.
    base = prose(300, 200).split()
    rows += [(400 + i, " ".join([f"v{k}" for k in range(14 * i)] + base[14 * i :])) for i in range(12)]
    chosen.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in link_documents(docs).collect()}
    assert found == plain.groups(rows)


def test_pages_of_one_template_are_no_candidates():
    """Sets with too many own members to be similar meet in no list, however many share the others."""
    import numpy as np
    import pyarrow as pa
    from types import SimpleNamespace

    shared = prose(5, 300)
    texts = [shared + " " + " ".join(f"own{i}x{k}" for k in range(60)) for i in range(200)]
    sets = jaccard_join.shingle_sets([t.encode() for t in texts])
    h1, h2 = jaccard_join.set_hashes(sets)
    counts = np.bincount(np.concatenate(sets) >> np.uint64(64 - jaccard_join.SKETCH_BITS), minlength=1 << jaccard_join.SKETCH_BITS)
    batch = pa.record_batch([pa.array(range(200)), pa.array(texts), pa.array(h1), pa.array(h2)], names=["doc_id", "text", "h1", "h2"])
    pieces = jaccard_join._prefix_pieces(5, 75, 1, SimpleNamespace(value=counts))(iter([batch]))
    payloads = [p for piece in pieces for p in piece.column("payload").to_pylist()]
    assert payloads and list(jaccard_join._listed(75, 1)(0, payloads)) == []


def test_pairs_of_long_lists_are_sent_in_bounded_runs():
    import pyarrow as pa

    n = 2500
    columns = {"docs": range(n), "sizes": [100] * n, "lefts": [100] * n, "components": range(n), "tiles": [0] * n}
    arrays = [pa.array([list(c)], pa.list_(pa.int64())) for c in columns.values()]
    batch = pa.record_batch([*arrays, pa.array([False])], names=[*columns, "across"])
    sent = [sum(len(packed.unpack(p)[0]) for p in piece.column("payload").to_pylist()) for piece in jaccard_join._split_lists(75, 4)(iter([batch]))]
    assert sum(sent) == n * (n - 1) // 2
    assert max(sent) < jaccard_join.HELD_PAIRS + n


def test_linked_documents_of_lists_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "TILE", 8)
    chosen = random.Random(11)
    base = prose(72, 120).split()
    rows = []
    for i in range(120):
        words = list(base)
        for at in chosen.sample(range(120), chosen.randrange(1, 6)):
            words[at] = f"edit{chosen.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in link_documents(docs).collect()}
    assert found == plain.groups(rows)
    lists = spark.createDataFrame([(k, i, 50, 50, i % 3) for k, n in ((1, 60), (2, 5)) for i in range(n)], "list long, doc long, size long, left long, component long")
    met: dict[tuple[int, int, int], int] = {}
    for r in jaccard_join._tiled(lists).collect():
        assert len(r.docs) < 40
        for x in range(len(r.docs)):
            for y in range(x):
                if not r.across or r.tiles[x] != r.tiles[y]:
                    key = (r.list, *sorted((r.docs[x], r.docs[y])))
                    met[key] = met.get(key, 0) + 1
    assert len(met) == 60 * 59 // 2 + 10 and set(met.values()) == {1}


def test_partners_of_a_list():
    """An entry stays if it and another of its group leave each other enough."""
    import numpy as np

    chosen = np.random.default_rng(5)
    group = np.sort(chosen.integers(0, 12, 150))
    group = np.unique(group, return_inverse=True)[1]
    size = chosen.integers(10, 40, 150)
    largest = chosen.integers(0, 45, 150)
    stays = jaccard_join.partnered(group, size, largest)
    for i in range(150):
        fits = (group == group[i]) & (size <= largest[i]) & (size[i] <= largest)
        assert stays[i] == fits.any()
    assert len(jaccard_join.partnered(group[:0], size[:0], largest[:0])) == 0


def test_prefix_tree_and_histograms():
    import numpy as np

    chosen = np.random.default_rng(3)
    sets = [np.unique(chosen.integers(0, 40, chosen.integers(1, 60)).astype(np.uint64) << np.uint64(57)) for _ in range(80)]
    sets.append(sets[0])
    tree = build(sets)
    for probe in sets[:30]:
        expected = []
        for i, s in enumerate(sets):
            shared = len(np.intersect1d(probe, s))
            if 100 * shared >= 75 * (len(probe) + len(s) - shared):
                expected.append(i)
                assert may_be_similar(histogram(probe), histogram(s), len(probe), len(s), 75)
        assert sorted(search(tree, probe, 75)) == expected


def test_components(spark):
    edges = [(i, i + 1) for i in range(10, 40)] + [(100, 100), (5, 200), (200, 300), (300, 5), (7, None)]
    frame = spark.createDataFrame(edges, "u long, v long")
    found = {r.node: r.component for r in components(frame).collect()}
    assert found == {**{i: 10 for i in range(10, 41)}, 100: 100, 5: 5, 200: 5, 300: 5}
    assert components(frame.limit(0)).collect() == []


@pytest.mark.parametrize("rows", [5, 300_000])
def test_encoding(docs, odd, empty, rows):
    import sentencepiece

    path = tokenizer_file("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = encode_documents(docs, path, table_rows=rows).collect()
    for r in found:
        ids = model.encode(r.text or "")
        assert list(r.piece_ids) == ids and r.decoded == model.decode(ids)
    assert encode_documents(odd, path).count() == 6
    assert encode_documents(empty, path).collect() == []


def test_pipeline(spark, tmp_path):
    secret = " token = " + "0123456789abcdef" * 2
    rows = [(i, t) for i, t in TEXTS.items() if i not in (7, 10)]
    rows += [(50, prose(50, 80) + secret), (51, prose(51, 80) + " " + prose(1000, 12)), (52, prose(52, 90))]
    source = F.when(F.col("doc_id").isin([i for i, t in rows if plain.statistics(t)[5]]), "junk").otherwise("fine")
    table(spark, rows).withColumn("source", source).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, prose(1000, 12))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    good = [(i, t) for i, t in rows if not plain.statistics(t)[5]]
    groups = plain.groups(good)
    single = [(i, t) for i, t in good if groups[i][1] == i]
    hit = plain.passages(single, [(1, prose(1000, 12))])
    expected = {i for i, _ in single if not hit[i][1]}
    assert set(found) == expected and 50 in expected and 51 not in expected
    assert found[50].decoded == prose(50, 80) + " [SECRET]"
    assert found[52].decoded == prose(52, 90)
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "ngram_jaccard_join", "benchmark_decontamination", "secret_scans", "sentencepiece",
    ]


def test_near_copies_of_template_pages_gather_no_lists(spark, monkeypatch):
    """Pages too far apart to be copies are not gathered by what they share; copies among them still go."""
    gathered = []
    listed = jaccard_join._list_rows
    monkeypatch.setattr(jaccard_join, "_list_rows", lambda rows: gathered.append(listed(rows).count()) or listed(rows))
    shared = prose(6, 300)
    rows = [(i, shared + " " + " ".join(f"own{i}x{k}" for k in range(60))) for i in range(150)]
    rows += [(200, rows[7][1] + " more words"), (201, rows[9][1])]
    kept = corpus_pipeline.near_copies(spark, table(spark, rows), "")
    assert sorted(r.doc_id for r in kept.collect()) == list(range(150))
    assert gathered == [0]
