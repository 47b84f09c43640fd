"""Checked, as-of and membership joins.

No join here carries a broadcast hint unless its side has a proven bound: Spark broadcasts
a side whose size, by statistics or measured at run time, is below the threshold, and
otherwise sorts and merges with skewed partitions split.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridelake.operators.quality import QualityError
from ridelake.operators.scale import materialized

#: Begins the messages of guards in a plan.
GUARD = "guard: "


@dataclass(frozen=True)
class JoinContract:
    """Declared left join between two tables."""

    left_keys: tuple[str, ...]
    right_keys: tuple[str, ...]
    required: bool = False
    right_unique: bool = True
    missing_policy: str = "warn"  # error, warn, fill_zero or skip
    fill_columns: tuple[str, ...] = ()


# Declared joins of the modelling base (fixed values of the data contract).
MODEL_BASE_JOINS = {
    "external": JoinContract(("service_date",), ("date",), True, True, "error"),
    "stations": JoinContract(("linea", "estacion"), ("linea", "estacion"), True, True, "error"),
    "lines": JoinContract(("linea",), ("linea",), False, True, "warn"),
    "network_changes": JoinContract(
        ("service_date", "linea", "estacion"),
        ("service_date", "linea", "estacion"),
        False,
        True,
        "fill_zero",
    ),
    "equipment": JoinContract(("linea", "estacion"), ("linea", "estacion"), False, False, "skip"),
}


def one_per_slot(rows: Column, name: str) -> Column:
    """True where a grouped pairing has at most one row per side; a job error elsewhere."""
    message = F.concat(F.lit(f"{name}: a key has "), rows.cast("string"), F.lit(" rows on one side"))
    return F.when(rows > 1, F.raise_error(message).cast("boolean")).otherwise(F.lit(True))


def left_join(
    left: DataFrame,
    right: DataFrame,
    left_keys: Sequence[str],
    right_keys: Sequence[str] | None = None,
    *,
    suffix: str = "_right",
    match_flag: str | None = None,
) -> DataFrame:
    """Left join on key pairs; the right keys go and clashing right columns get a suffix."""
    right_keys = list(right_keys or left_keys)
    renamed = right.select(
        *[F.col(k).alias(f"_rk{i}") for i, k in enumerate(right_keys)],
        *[
            F.col(c).alias(c + suffix if c in left.columns else c)
            for c in right.columns
            if c not in right_keys
        ],
        F.lit(True).alias("_matched"),
    )
    condition = F.col(left_keys[0]) == F.col("_rk0")
    for i, key in enumerate(left_keys[1:], start=1):
        condition = condition & (F.col(key) == F.col(f"_rk{i}"))
    joined = left.join(renamed, condition, "left").drop(*[f"_rk{i}" for i in range(len(right_keys))])
    if match_flag:
        joined = joined.withColumn(match_flag, F.coalesce("_matched", F.lit(False)))
    return joined.drop("_matched")


def unmatched_keys(
    left: DataFrame,
    right: DataFrame,
    left_keys: Sequence[str],
    right_keys: Sequence[str] | None = None,
) -> DataFrame:
    """Distinct left keys that no right row has."""
    right_keys = list(right_keys or left_keys)
    keys = left.select(*left_keys).distinct()
    known = right.select(*[F.col(k).alias(f"_rk{i}") for i, k in enumerate(right_keys)])
    condition = F.col(left_keys[0]) == F.col("_rk0")
    for i, key in enumerate(left_keys[1:], start=1):
        condition = condition & (F.col(key) == F.col(f"_rk{i}"))
    return keys.join(known, condition, "left_anti")


def _or_raise(fine: Column, *message: Column | str) -> Column:
    """True where a condition holds; the job fails with the message elsewhere."""
    text = F.concat(F.lit(GUARD), *[F.lit(m) if isinstance(m, str) else F.coalesce(m.cast("string"), F.lit("NULL")) for m in message])
    return F.when(fine, F.lit(True)).otherwise(F.raise_error(text).cast("boolean"))


def guarded_left_join(
    left: DataFrame,
    right: DataFrame,
    left_keys: Sequence[str],
    right_keys: Sequence[str] | None = None,
    *,
    required: bool = False,
    right_unique: bool = True,
    name: str = "join",
) -> DataFrame:
    """Left join that may neither lose nor multiply rows, with its guards in the plan.

    The right side is grouped by its keys, on the exchange that the join needs anyway, and every
    guard is a condition on rows that pass: NULLs in left keys, several right rows per key, and
    left keys without a match when ``required``. Nothing runs for them; a row that breaks one
    fails the job that reads it (:func:`checked` turns that into a ``QualityError``).
    """
    left_keys, right_keys = list(left_keys), list(right_keys or left_keys)
    rest = [c for c in right.columns if c not in right_keys]
    keys = [F.col(k).alias(f"_rk{i}") for i, k in enumerate(right_keys)]
    values = [F.any_value(F.struct(F.lit(True).alias("_matched"), *rest)).alias("_right")]
    grouped = right.groupBy(*keys).agg(F.count("*").alias("_n"), *values)
    shown = F.concat_ws(", ", *[F.coalesce(F.col(f"_rk{i}").cast("string"), F.lit("NULL")) for i in range(len(right_keys))])
    if right_unique:
        grouped = grouped.filter(_or_raise(F.col("_n") <= 1, f"{name} right side: duplicate key, e.g. ", shown))
    whole = F.lit(True)
    for key in left_keys:
        whole = whole & F.col(key).isNotNull()
    given = left.filter(_or_raise(whole, f"{name} left side: NULLs in {', '.join(sorted(left_keys))}"))
    condition = F.lit(True)
    for i, key in enumerate(left_keys):
        condition = condition & (F.col(key) == F.col(f"_rk{i}"))
    # Spark drops a left join with grouped rows where no column of theirs is read later, and its
    # guards with it; this condition, true of every row, reads one.
    joined = given.join(grouped, condition, "left").filter(F.coalesce(F.col("_n"), F.lit(1)) > 0)
    found = F.concat_ws(", ", *[F.col(k).cast("string") for k in left_keys])
    if not right_unique:
        joined = joined.filter(_or_raise(F.coalesce(F.col("_n"), F.lit(1)) <= 1, f"{name} would multiply rows: right side, e.g. ", found))
    if required:
        joined = joined.filter(_or_raise(F.col("_n").isNotNull(), f"{name}: left keys without a match, e.g. ", found))
    shared = set(left.columns)
    return joined.select(
        *[F.col(c) for c in left.columns], *[F.col(f"_right.{c}").alias(c + "_right" if c in shared else c) for c in rest]
    )


def checked(df: DataFrame) -> DataFrame:
    """Checkpoint a frame, which runs its guards; a row that breaks one raises ``QualityError``."""
    try:
        return materialized(df)
    except PySparkException as error:
        found = re.search(re.escape(GUARD) + r"([^\n]*)", str(error))
        if found is None:
            raise
        raise QualityError(found[1].strip()) from None


def safe_left_join(
    left: DataFrame,
    right: DataFrame,
    left_keys: Sequence[str],
    right_keys: Sequence[str] | None = None,
    *,
    required: bool = False,
    right_unique: bool = True,
    name: str = "join",
) -> DataFrame:
    """:func:`guarded_left_join`, run at once: the checked and checkpointed result."""
    return checked(
        guarded_left_join(left, right, left_keys, right_keys, required=required, right_unique=right_unique, name=name)
    )


def guarded_contract_join(left: DataFrame, right: DataFrame, contract: JoinContract, name: str = "join") -> DataFrame:
    """:func:`guarded_left_join` driven by a declared contract and its missing policy."""
    if contract.missing_policy == "skip":
        return left
    joined = guarded_left_join(
        left,
        right,
        contract.left_keys,
        contract.right_keys,
        required=contract.required or contract.missing_policy == "error",
        right_unique=contract.right_unique,
        name=name,
    )
    if contract.missing_policy == "fill_zero":
        added = contract.fill_columns or tuple(c for c in right.columns if c not in contract.right_keys)
        joined = joined.fillna(0, subset=[c for c in added if c in joined.columns])
    return joined


def contract_join(left: DataFrame, right: DataFrame, contract: JoinContract, name: str = "join") -> DataFrame:
    """:func:`guarded_contract_join`, run at once."""
    return left if contract.missing_policy == "skip" else checked(guarded_contract_join(left, right, contract, name))


def asof_join(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    left_on: str,
    right_on: str,
    values: Sequence[str],
    *,
    direction: str = "backward",
    strict: bool = False,
    block: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Nearest earlier (or later) right row of the same ``by`` group for every left row.

    Both sides are unioned and swept by a window. ``strict`` excludes equal times. With
    ``block`` (for example a month of the time column) each group is swept block by block
    and only one row per block is carried over, so a hot group spreads over its blocks;
    without it, use the join on inputs with a bounded number of rows per group.
    """
    by = list(by)
    forward = direction == "forward"
    payload = F.struct(*[F.col(v) for v in values])
    right_rows = right.select(
        *by,
        F.col(right_on).alias("_t"),
        payload.alias("_hit"),
        F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("_row"),
    ).filter(F.col("_t").isNotNull())
    left_rows = left.select(
        *by,
        F.col(left_on).alias("_t"),
        F.lit(None).cast(right_rows.schema["_hit"].dataType).alias("_hit"),
        F.struct(*left.columns).alias("_row"),
    )
    # On equal times the right row must lie before the left row in sweep order unless strict.
    tie = F.when(F.col("_row").isNull(), F.lit(1 if strict else 0)).otherwise(F.lit(0 if strict else 1))
    swept = left_rows.unionByName(right_rows).withColumn("_tie", tie)
    time_order = [F.col("_t").desc() if forward else F.col("_t").asc(), F.col("_tie").asc()]
    if block is None:
        sweep = Window.partitionBy(*by).orderBy(*time_order).rowsBetween(Window.unboundedPreceding, 0)
        found = swept.withColumn("_found", F.last("_hit", ignorenulls=True).over(sweep))
    else:
        swept = swept.withColumn("_block", block(F.col("_t")))
        sweep = (
            Window.partitionBy(*by, "_block")
            .orderBy(*time_order)
            .rowsBetween(Window.unboundedPreceding, 0)
        )
        nearest = F.min_by if forward else F.max_by
        per_block = swept.groupBy(*by, "_block").agg(
            nearest("_hit", F.when(F.col("_hit").isNotNull(), F.col("_t"))).alias("_edge")
        )
        block_order = F.col("_block").desc() if forward else F.col("_block").asc()
        earlier = (
            Window.partitionBy(*by).orderBy(block_order).rowsBetween(Window.unboundedPreceding, -1)
        )
        carried = per_block.select(
            *[F.col(c).alias(f"_k_{c}") for c in by],
            F.col("_block").alias("_k_block"),
            F.last("_edge", ignorenulls=True).over(earlier).alias("_carried"),
        )
        condition = F.col("_block").eqNullSafe(F.col("_k_block"))
        for c in by:
            condition = condition & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
        found = (
            swept.withColumn("_inside", F.last("_hit", ignorenulls=True).over(sweep))
            .join(carried, condition, "left")
            .withColumn("_found", F.coalesce("_inside", "_carried"))
        )
    hits = found.filter(F.col("_row").isNotNull())
    return hits.select("_row.*", *[F.col(f"_found.{v}").alias(v) for v in values])


def nearest_holiday(dates: DataFrame, date: str, holidays: DataFrame, holiday: str) -> DataFrame:
    """Days to the next and since the previous holiday; 0 on a holiday, NULL where none.

    The gaps between consecutive holidays are expanded to days, which depends on the
    holiday list alone; the dates then need one equi-join and are read once.
    """
    marks = holidays.select(F.col(holiday).alias("_prev")).distinct()
    # One row per holiday: an ordering over all of them is as long as the holiday list.
    gaps = marks.select("_prev", F.lead("_prev").over(Window.orderBy("_prev")).alias("_next"))
    days = gaps.filter(F.col("_next").isNotNull()).select(
        "_prev",
        "_next",
        F.explode(F.sequence(F.col("_prev"), F.date_sub("_next", 1))).alias("_day"),
    )
    edge = marks.select(F.struct(F.min("_prev").alias("lo"), F.max("_prev").alias("hi"))).scalar()
    day = F.col(date)
    is_mark = day == F.col("_prev")
    following = F.when(is_mark | (day == edge["hi"]), day).when(day < edge["lo"], edge["lo"]).otherwise(
        F.col("_next")
    )
    previous = F.when(day >= edge["hi"], edge["hi"]).otherwise(F.col("_prev"))
    return (
        dates.join(days, day == F.col("_day"), "left")
        .withColumns(
            {
                "days_to_next_holiday": F.datediff(following, day).cast("double"),
                "days_since_prev_holiday": F.datediff(day, previous).cast("double"),
            }
        )
        .drop("_prev", "_next", "_day")
    )


def keep_listed(df: DataFrame, listed: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(listed.select(*on).distinct(), list(on), "left_semi")


def drop_listed(df: DataFrame, listed: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(listed.select(*on).distinct(), list(on), "left_anti")
