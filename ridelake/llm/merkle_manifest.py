"""Merkle manifest of a dataset: hash trees kept as blocks in van Emde Boas order.

Every row is a leaf, every source has a tree with a fan-out of 16, and the roots of the sources
are the leaves of one more tree. A tree is cut into aligned blocks of :data:`BLOCK_LEVELS` levels
of parents; one group of a Spark aggregation is one block, whose nodes are stored in van Emde Boas
order: the upper half of the levels, then each lower subtree, and so on within each. Block roots
are the leaves of the next table of blocks, until a block holds all that is left of its tree.

Proofs go the other way: from the highest blocks down, a block's rows get the path of its root by
a join of one row per block, and find their own siblings by address in their block.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FAN = 16
#: Levels of parents in a block: 4096 leaves at most.
BLOCK_LEVELS = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_HEX = 64
_PATH = "path array<struct<at:int,siblings:string>>"
_CARRIED = "array<struct<doc_id:bigint,tampered:string>>"
_BLOCK = f"tree string, block long, total long, size int, height int, nodes binary, root string, carried {_CARRIED}"


def nodes_of(height: int) -> int:
    """Nodes of a full tree with ``height`` levels."""
    return (FAN**height - 1) // (FAN - 1)


def address(height: int, level: int, index: np.ndarray) -> np.ndarray:
    """Place of node ``index`` of ``level`` (0: the root) in the van Emde Boas order of a full tree."""
    at = np.zeros(len(index), dtype=np.int64)
    while height > 1:
        top = (height + 1) // 2
        if level < top:
            height = top
            continue
        below = FAN ** (level - top)
        at += nodes_of(top) + index // below * nodes_of(height - top)
        index, level, height = index % below, level - top, height - top
    return at


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def _levels_up(leaves: list[str], height: int) -> list[list[str]]:
    """Nodes by level, from the leaves up, with ``height`` levels in all."""
    levels = [leaves]
    for _ in range(height - 1):
        below = levels[-1]
        levels.append([digest("".join(below[i : i + FAN])) for i in range(0, len(below), FAN)])
    return levels


def _height_of(size: int) -> int:
    """Levels of the smallest tree over ``size`` leaves."""
    height = 1
    while FAN ** (height - 1) < size:
        height += 1
    return height


def stored(leaves: list[str], height: int) -> bytes:
    """All nodes of a block over some leaves, by address; places of absent nodes are zero."""
    out = np.zeros((nodes_of(height), 32), dtype=np.uint8)
    for up, nodes in enumerate(_levels_up(leaves, height)):
        raw = np.frombuffer(bytes.fromhex("".join(nodes)), dtype=np.uint8).reshape(-1, 32)
        out[address(height, height - 1 - up, np.arange(len(nodes)))] = raw
    return out.tobytes()


def _fetched(nodes: bytes, height: int, size: int) -> list[str]:
    """Each level of a block as one text, from the leaves up, gathered by address."""
    table = np.frombuffer(nodes, dtype=np.uint8).reshape(-1, 32)
    out = []
    for level in range(height - 1, -1, -1):
        out.append(table[address(height, level, np.arange(size))].tobytes().hex())
        size = -(-size // FAN)
    return out


def siblings(nodes: bytes, height: int, size: int) -> list[list[tuple[int, str]]]:
    """Per level below the root and node: its place in its run, and the run's others as text."""
    out = []
    for text in _fetched(nodes, height, size)[:-1]:
        level = []
        for start in range(0, len(text), FAN * _HEX):
            run = text[start : start + FAN * _HEX]
            level += [(p // _HEX, run[:p] + run[p + _HEX :]) for p in range(0, len(run), _HEX)]
        out.append(level)
    return out


def folded(leaf: str, path: list[tuple[int, str]]) -> str:
    """The root that a leaf and the siblings on its path give."""
    for at, others in path:
        leaf = digest(others[: at * _HEX] + leaf + others[at * _HEX :])
    return leaf


def _field(name: str, value: Column | None = None) -> Column:
    text = (F.col(name) if value is None else value).cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(text: Column | None = None) -> Column:
    """Hash of a row's fields; ``text`` takes the place of its text."""
    return F.sha2(F.concat(*[_field(c, text if c == "text" else None) for c in FIELDS]), 256)


def lowered(text: str = "text") -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def _numbered(rows: DataFrame, order: list[str], folder: str) -> DataFrame:
    """Add ``i``, the place of a row in its ``tree`` by ``order``, and ``total``, the tree's rows.

    Rows are dealt by ranges of (tree, order), so that a large tree spreads over many tasks;
    a task numbers its own, and one row per task and tree carries the numbers across.
    """
    spark = rows.sparkSession
    plain = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, inside, last = None, -1, 0, None
        for batch in batches:
            part = batch.column("part")
            trees = batch.column("tree").to_pylist()
            numbers, places = [], []
            for tree in trees:
                if number < 0 or tree != last:
                    number, inside, last = number + 1, 0, tree
                numbers.append(number)
                places.append(inside)
                inside += 1
            columns = [c for c in batch.columns] + [pa.array(numbers, pa.int32()), pa.array(places, pa.int64())]
            yield pa.record_batch(columns, names=[*batch.schema.names, "run", "inside"])

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(tasks, "tree", *order).sortWithinPartitions("tree", *order)
    dealt = dealt.withColumn("part", F.spark_partition_id())
    schema = ", ".join([*plain, "part int", "run int", "inside long"])
    dealt.mapInArrow(run, schema).write.parquet(folder)
    placed = spark.read.parquet(folder)
    counts = placed.groupBy("part", "run", "tree").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "part",
        "run",
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_offset"),
        F.sum("n").over(Window.partitionBy("tree")).alias("total"),
    )
    joined = placed.join(offsets, ["part", "run"]).withColumn("i", F.col("inside") + F.col("_offset"))
    return joined.drop("part", "run", "inside", "_offset")


def _build(batches: Iterator[pa.RecordBatch], block_levels: int) -> Iterator[pa.RecordBatch]:
    """Blocks from their sorted leaves."""
    for batch in batches:
        out = {"size": [], "height": [], "nodes": [], "root": [], "carried": []}
        for total, members in zip(batch.column("total").to_pylist(), batch.column("members"), strict=True):
            leaves = members.values.field("leaf").to_pylist()
            # A block that is all of its tree ends where one node is left.
            height = block_levels + 1 if total > FAN**block_levels else _height_of(len(leaves))
            nodes = stored(leaves, height)
            out["size"].append(len(leaves))
            out["height"].append(height)
            out["nodes"].append(nodes)
            out["root"].append(nodes[:32].hex())
            values = members.values
            out["carried"].append(
                pa.StructArray.from_arrays([values.field("doc_id"), values.field("tampered")], ["doc_id", "tampered"])
            )
        carried_type = pa.list_(pa.struct([("doc_id", pa.int64()), ("tampered", pa.string())]))
        carried = pa.array([c.to_pylist() for c in out["carried"]], carried_type)
        yield pa.record_batch(
            [
                batch.column("tree"),
                batch.column("block"),
                batch.column("total"),
                pa.array(out["size"], pa.int32()),
                pa.array(out["height"], pa.int32()),
                pa.array(out["nodes"], pa.binary()),
                pa.array(out["root"], pa.string()),
                carried,
            ],
            names=["tree", "block", "total", "size", "height", "nodes", "root", "carried"],
        )


def _blocks(leaves: DataFrame, folder: str, block_levels: int) -> list[DataFrame]:
    """Tables of blocks over numbered leaves, from the lowest up; each is written below ``folder``."""
    spark, levels, wide = leaves.sparkSession, [], FAN**block_levels
    while True:
        member = F.struct(F.col("i"), F.col("leaf"), F.col("doc_id"), F.col("tampered"))
        # At most ``wide`` rows make a group.
        grouped = leaves.groupBy("tree", F.floor(F.col("i") / wide).alias("block"), "total").agg(
            F.sort_array(F.collect_list(member)).alias("members")
        )
        grouped.mapInArrow(partial(_build, block_levels=block_levels), _BLOCK).write.parquet(f"{folder}/{len(levels)}")
        levels.append(spark.read.parquet(f"{folder}/{len(levels)}"))
        above = levels[-1].where(F.col("total") > wide)
        if above.isEmpty():
            return levels
        leaves = above.select(
            "tree",
            F.col("block").alias("i"),
            F.col("root").alias("leaf"),
            F.ceil(F.col("total") / wide).alias("total"),
            F.lit(None).cast("long").alias("doc_id"),
            F.lit(None).cast("string").alias("tampered"),
        )


def _with_paths(blocks: DataFrame, paths: DataFrame) -> DataFrame:
    """Blocks with the path of their root, by tree and number."""
    keys = paths.select(F.col("tree").alias("_tree"), F.col("block").alias("_block"), "path")
    met = F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("block") == F.col("_block"))
    return blocks.join(keys, met).drop("_tree", "_block")


def _leaf_paths(batches: Iterator[pa.RecordBatch], wide: int) -> Iterator[pa.RecordBatch]:
    """Path of every leaf of blocks that have the path of their root."""
    for batch in batches:
        for row in batch.to_pylist():
            levels = siblings(row["nodes"], row["height"], row["size"])
            paths = []
            for i in range(row["size"]):
                own = [level[i // FAN**up] for up, level in enumerate(levels)]
                paths.append([{"at": at, "siblings": others} for at, others in own] + row["path"])
            first = row["block"] * wide
            yield pa.record_batch(
                [
                    pa.array([row["tree"]] * len(paths), pa.string()),
                    pa.array(range(first, first + len(paths)), pa.int64()),
                    pa.array(paths, pa.list_(pa.struct([("at", pa.int32()), ("siblings", pa.string())]))),
                ],
                names=["tree", "block", "path"],
            )


def _paths_below(blocks: DataFrame, wide: int) -> DataFrame:
    return blocks.drop("carried").mapInArrow(partial(_leaf_paths, wide=wide), f"tree string, block long, {_PATH}")


def _descend(levels: list[DataFrame], tops: DataFrame, wide: int) -> DataFrame:
    """Lowest blocks with the paths of their roots; ``tops`` has the path of each tree's root."""
    paths = None
    for k in range(len(levels) - 1, -1, -1):
        whole = levels[k].where(F.col("total") <= wide)
        ended = _with_paths(whole, tops.select("tree", F.lit(0).cast("long").alias("block"), "path"))
        if paths is None:
            met = ended
        else:
            met = ended.unionByName(_with_paths(levels[k].where(F.col("total") > wide), paths))
        paths = _paths_below(met, wide)
    return met


def _proofs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of documents with their proof and the root that it gives."""
    names = ["doc_id", "leaf", "proof", "folded_root"]
    for batch in batches:
        for row in batch.to_pylist():
            leaves = _fetched(row["nodes"], row["height"], row["size"])[0]
            levels = siblings(row["nodes"], row["height"], row["size"])
            above = [(p["at"], p["siblings"]) for p in row["path"]]
            above_text = "".join(others for _, others in above)
            out = []
            for i, doc in enumerate(row["carried"]):
                leaf = leaves[i * _HEX : (i + 1) * _HEX]
                own = [level[i // FAN**up] for up, level in enumerate(levels)]
                proof = digest("".join(others for _, others in own) + above_text)
                out.append((doc["doc_id"], leaf, proof, folded(doc["tampered"] or leaf, own + above)))
            columns = zip(*out, strict=True)
            types = (pa.int64(), pa.string(), pa.string(), pa.string())
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            arrays.append(pa.array([row["tree"]] * len(out), pa.string()))
            yield pa.record_batch(arrays, names=[*names, "source"])


def build_manifest(
    docs: DataFrame, folder: str, tampered: Column | None = None, *, block_levels: int = BLOCK_LEVELS
) -> tuple[list[DataFrame], list[DataFrame]]:
    """Write the tables of blocks of all sources, and of the tree over them, below ``folder``.

    Leaves of a source ascend by ``doc_id`` (null first), then by hash; repeated rows are leaves
    of their own. Sources ascend bytewise, null first. ``tampered`` is another leaf hash to be
    checked against the tree (null: the leaf's own).
    """
    spark = docs.sparkSession
    columns = [
        F.col("source").cast("string").alias("tree"),
        F.col("doc_id").cast("long").alias("doc_id"),
        leaf_hash().alias("leaf"),
        (F.lit(None).cast("string") if tampered is None else tampered).alias("tampered"),
        F.monotonically_increasing_id().alias("row"),
    ]
    docs.select(*columns).write.parquet(f"{folder}/leaves")
    leaves = spark.read.parquet(f"{folder}/leaves")
    numbered = _numbered(leaves, ["doc_id", "leaf", "row"], f"{folder}/placed").drop("row")
    levels = _blocks(numbered, f"{folder}/sources", block_levels)
    tops = [b.where(F.col("total") <= FAN**block_levels).select("tree", "root") for b in levels]
    roots = tops[0]
    for more in tops[1:]:
        roots = roots.unionByName(more)
    roots = roots.select(
        F.lit(None).cast("string").alias("tree"),
        F.col("tree").alias("source"),
        F.col("root").alias("leaf"),
        F.lit(None).cast("long").alias("doc_id"),
        F.lit(None).cast("string").alias("tampered"),
    )
    numbered = _numbered(roots, ["source"], f"{folder}/roots")
    numbered.select("source", "i", "leaf").write.parquet(f"{folder}/subroots")
    return levels, _blocks(numbered.drop("source"), f"{folder}/dataset", block_levels)


def verify_documents(
    docs: DataFrame, folder: str, tampered: Column | None = None, *, block_levels: int = BLOCK_LEVELS
) -> DataFrame:
    """(doc_id, source, leaf, subroot, root, proof, folded_root, verified) of every row.

    The manifest is written below ``folder``, which driver and executors share and which must not
    exist. A null in any field is hashed as ``-``; empty and very long texts are texts; columns
    besides the five fields are not part of a leaf. No documents give no rows.
    """
    spark, wide = docs.sparkSession, FAN**block_levels
    sources, dataset = build_manifest(docs, folder, tampered, block_levels=block_levels)
    top = dataset[-1].select("root")
    empty = F.array().cast("array<struct<at:int,siblings:string>>").alias("path")
    paths = _paths_below(_descend(dataset, dataset[-1].select("tree", empty), wide), wide)
    # One row per source.
    subroots = spark.read.parquet(f"{folder}/subroots").join(paths.select(F.col("block").alias("i"), "path"), "i")
    subroots = subroots.select(F.col("source").alias("tree"), F.col("leaf").alias("subroot"), "path")
    rows = _descend(sources, subroots, wide).mapInArrow(
        _proofs, "doc_id long, leaf string, proof string, folded_root string, source string"
    )
    named = subroots.select(F.col("tree").alias("_tree"), "subroot")
    whole = rows.join(named, F.col("source").eqNullSafe(F.col("_tree"))).drop("_tree").withColumn("root", top.scalar())
    return whole.withColumn("verified", F.col("folded_root") == F.col("root"))
