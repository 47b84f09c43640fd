"""Merkle manifests against a plain build, and the order of nodes in a block."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridelake.llm import merkle_manifest as mm

SCHEMA = "source string, doc_id long, text string, lang string, n_chars long, leaf string, tree int"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, lower=False):
    source, doc_id, text, lang, n_chars = row[:5]
    if lower and text is not None:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    fields = [doc_id, source, lang, n_chars, text]
    return h("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def climb(nodes, at):
    """Root of a list of nodes, and the siblings on the way from place ``at``."""
    path = []
    while len(nodes) > 1:
        run = nodes[at // 16 * 16 : at // 16 * 16 + 16]
        path.append((at % 16, run[: at % 16] + run[at % 16 + 1 :]))
        nodes, at = [h("".join(nodes[i : i + 16])) for i in range(0, len(nodes), 16)], at // 16
    return nodes[0], path


def expected(rows, tampered=lambda doc_id: False):
    trees = {}
    for row in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, leaf(r))):
        trees.setdefault(row[0], []).append(row)
    sources = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    subroots = [climb([leaf(r) for r in trees[s]], 0)[0] for s in sources]
    out = []
    for k, source in enumerate(sources):
        leaves = [leaf(r) for r in trees[source]]
        root, above = climb(subroots, k)
        for i, row in enumerate(trees[source]):
            path = climb(leaves, i)[1] + above
            value = leaf(row, lower=tampered(row[1]))
            for at, others in path:
                value = h("".join(others[:at] + [value] + others[at:]))
            proof = h("".join("".join(others) for _, others in path))
            out.append((row[1], source, leaves[i], subroots[k], root, proof, value, value == root))
    return sorted(out, key=repr)


def found(spark, rows, folder, **more):
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
    names = ["doc_id", "source", "leaf", "subroot", "root", "proof", "folded_root", "verified"]
    return sorted((tuple(r) for r in mm.verify_documents(docs, str(folder), **more).select(*names).collect()), key=repr)


def test_addresses_of_a_small_tree():
    """Of four levels, the upper two stand first, then each lower two by two, all places once."""
    assert mm.address(4, 0, np.array([0])).tolist() == [0]
    assert mm.address(4, 1, np.arange(3)).tolist() == [1, 2, 3]
    assert mm.address(4, 2, np.array([0, 1])).tolist() == [17, 34]
    assert mm.address(4, 3, np.array([0, 15, 16])).tolist() == [18, 33, 35]
    for height in (1, 2, 3, 5):
        all_places = np.concatenate([mm.address(height, v, np.arange(16**v)) for v in range(height)])
        assert sorted(all_places.tolist()) == list(range(mm.nodes_of(height)))


@pytest.mark.parametrize("size", [1, 2, 15, 16, 17, 256, 257, 300])
def test_blocks_hold_whole_trees(size):
    leaves = [h(str(i)) for i in range(size)]
    height = mm._height_of(size)
    nodes = mm.stored(leaves, height)
    root, path = climb(leaves, size - 1)
    assert nodes[:32].hex() == root
    levels = mm.siblings(nodes, height, size)
    assert [(at, others) for at, others in ((v[(size - 1) // 16**k]) for k, v in enumerate(levels))] == [
        (at, "".join(others)) for at, others in path
    ]


def test_trees_of_many_shapes(spark, tmp_path):
    rows = [(None, None, None, None, None), (None, 3, "", "", 0), ("", 5, "Ünïcode ABC", "en", 3), ("ä", 1, "X" * 200_000, None, 1)]
    rows += [("same", 7, "Twice", "en", 5)] * 20 + [("same", 8, "Once", "en", None), ("same", None, "a", "b", 1)]
    for n in (1, 16, 17, 33, 256, 257, 600):
        rows += [(f"s{n}", i * 3 - 50, f"Text {i}", "fr", i) for i in range(n)]
    check = lambda i: i is not None and i % 2 == 0
    tampered = F.when(F.col("doc_id") % 2 == 0, mm.leaf_hash(mm.lowered()))
    ours = found(spark, rows, tmp_path / "m", tampered=tampered)
    assert ours == expected(rows, check)
    assert {r[-1] for r in ours} == {True, False}


def test_blocks_below_blocks(spark, tmp_path):
    """Blocks of one level of parents, so that a tree has four tables of blocks, and sources three."""
    rows = [("big", i, f"Text {i}", None, None) for i in range(4100)] + [(f"s{k:03d}", k, "T", None, None) for k in range(300)]
    assert found(spark, rows, tmp_path / "m", block_levels=1) == expected(rows)
    levels = math.ceil(math.log(4100, 16))
    assert len(list((tmp_path / "m" / "sources").iterdir())) == levels


def test_no_documents(spark, tmp_path):
    assert found(spark, [], tmp_path / "m") == []
