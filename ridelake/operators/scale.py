"""Building blocks that keep global orderings distributed.

A global ``Window.orderBy`` without partitions sends every row to one task. The helpers
here cut an ordering into blocks, work inside the blocks, and carry one row per block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridelake.session import shared_folder

#: Blocks of an ordering per shuffle partition.
BLOCKS_PER_PARTITION = 4


def block_count(df: DataFrame) -> int:
    """Blocks for an ordering, by the session's shuffle partitions."""
    return BLOCKS_PER_PARTITION * max(4, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def materialized(df: DataFrame) -> DataFrame:
    """Checkpoint a frame that several branches of a plan read; runs its plan at once.

    The same at every master and size: the files go to the folder that all nodes share.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


def value_blocks(
    df: DataFrame, by: Sequence[str], order: str, blocks: int, few_groups: bool = False
) -> DataFrame:
    """Add ``block``: the number of sketch quantiles of ``order`` below the row's value.

    The quantiles are approximate but every row of one value gets the same block and
    blocks follow the order of values, so whatever is computed per block is exact.
    """
    steps = F.array(*[F.lit(i / blocks) for i in range(1, blocks)])
    if by:
        cuts = df.groupBy(*by).agg(F.percentile_approx(order, steps, 10000).alias("_cuts"))
        keys = [df[c].eqNullSafe(cuts[c]) for c in by]
        condition = keys[0]
        for key in keys[1:]:
            condition = condition & key
        side = F.broadcast(cuts) if few_groups else cuts
        joined = df.join(side, condition).drop(*[cuts[c] for c in by])
    else:
        cuts = df.select(F.percentile_approx(order, steps, 10000).alias("_cuts"))
        joined = df.withColumn("_cuts", cuts.scalar())
    # Count the smaller cuts in two steps, first by every ``stride``-th cut, then inside the
    # stride that is left, so that a row compares with some 2 * sqrt(blocks) cuts.
    stride = max(2, int(blocks**0.5))
    marks = [F.get("_cuts", F.lit(i)) for i in range(stride - 1, blocks - 1, stride)]
    passed = F.size(F.filter(F.array(*marks), lambda cut: cut < F.col(order))) * stride
    rest = F.filter(F.slice("_cuts", F.col("_passed") + 1, stride), lambda cut: cut < F.col(order))
    return (
        joined.withColumn("_passed", passed)
        .withColumn("block", F.col("_passed") + F.size(rest))
        .drop("_cuts", "_passed")
    )


def running_totals(
    df: DataFrame,
    by: Sequence[str],
    order: str,
    values: Sequence[str],
    blocks: int | None = None,
    *,
    few_groups: bool = False,
) -> DataFrame:
    """Add ``cum_<v>`` (running sum by ``order``) and ``all_<v>`` (total) per group.

    ``df`` holds one row per (group, order value): reduce to distinct values first, which
    also takes the weight out of hot values. Rows are summed inside blocks of the order;
    only one row per block is carried across. ``few_groups`` states that the groups are as
    few as the columns of a table; their per-group and per-block rows are then broadcast,
    and otherwise joined by whatever their size allows.
    """
    by = list(by)
    blocks = blocks or block_count(df)
    blocked = value_blocks(df, by, order, blocks, few_groups)
    inside = Window.partitionBy(*by, "block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    per_block = blocked.groupBy(*by, "block").agg(*[F.sum(v).alias(f"_sum_{v}") for v in values])
    earlier = Window.partitionBy(*by).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    carried = per_block.select(
        *[F.col(c).alias(f"_k_{c}") for c in by],
        F.col("block").alias("_k_block"),
        *[F.coalesce(F.sum(f"_sum_{v}").over(earlier), F.lit(0)).alias(f"_before_{v}") for v in values],
        *[F.sum(f"_sum_{v}").over(whole).alias(f"all_{v}") for v in values],
    )
    condition = F.col("block") == F.col("_k_block")
    for c in by:
        condition = condition & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    summed = blocked.withColumns({f"cum_{v}": F.sum(v).over(inside) for v in values})
    return (
        summed.join(F.broadcast(carried) if few_groups else carried, condition)
        .withColumns({f"cum_{v}": F.col(f"cum_{v}") + F.col(f"_before_{v}") for v in values})
        .drop("block", "_k_block", *[f"_k_{c}" for c in by], *[f"_before_{v}" for v in values])
    )


def dense_index(df: DataFrame, key: Sequence[str], name: str, blocks: int | None = None) -> DataFrame:
    """Add consecutive numbers 0..n-1, in an order fixed by a hash of the ``key`` columns.

    Rows are numbered inside hash blocks; the block offsets come from one row per block.
    """
    blocks = blocks or block_count(df)
    hashed = df.withColumn("_h", F.xxhash64(*key))
    blocked = hashed.withColumn("_block", F.pmod(F.col("_h"), F.lit(blocks)).cast("int"))
    counts = blocked.groupBy("_block").agg(F.count("*").alias("_n"))
    offsets = counts.select(
        F.col("_block").alias("_b"),
        F.coalesce(
            F.sum("_n").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0),
        ).alias("_offset"),
    )
    inside = Window.partitionBy("_block").orderBy("_h", *key)
    return (
        blocked.withColumn("_i", F.row_number().over(inside) - 1)
        .join(F.broadcast(offsets), F.col("_block") == F.col("_b"))
        .withColumn(name, (F.col("_i") + F.col("_offset")).cast("long"))
        .drop("_h", "_block", "_b", "_i", "_offset")
    )
