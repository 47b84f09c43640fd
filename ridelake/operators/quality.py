"""Data-quality checks.

Each check is one distributed aggregation that returns a small report; the ``require_*``
forms read that report and raise.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


class QualityError(ValueError):
    """A table breaks its contract."""


@dataclass(frozen=True)
class Contract:
    """What a table must satisfy before it is used."""

    name: str
    required_columns: tuple[str, ...] = ()
    unique_key: tuple[str, ...] = ()
    non_null: tuple[str, ...] = ()
    grain: str = ""
    format: str = "parquet"


@dataclass(frozen=True)
class ColumnRule:
    """Type, nullability and lower bound of one column."""

    type: str
    nullable: bool = True
    minimum: float | None = None


# Contract of the raw validations table (fixed values of its schema).
RAW_VALIDATION_RULES: dict[str, ColumnRule] = {
    "fecha_validacion": ColumnRule("timestamp"),
    "linea": ColumnRule("string", nullable=False),
    "estacion": ColumnRule("string", nullable=False),
    "cod_eq": ColumnRule("string", nullable=False),
    "tipo_validacion": ColumnRule("string", nullable=False),
    "tipo_titulo": ColumnRule("string", nullable=False),
    "id_tarjeta": ColumnRule("string", nullable=False),
    "num_tarjeta": ColumnRule("string"),
    "dinero_deducido": ColumnRule("double", minimum=0),
    "saldo_restante": ColumnRule("double"),
    "viajes_deducidos": ColumnRule("bigint", minimum=0),
    "dia": ColumnRule("string", nullable=False),
}


def missing_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    return [c for c in columns if c not in df.columns]


def require_columns(df: DataFrame, columns: Sequence[str], name: str = "table") -> DataFrame:
    missing = missing_columns(df, columns)
    if missing:
        raise QualityError(f"{name}: missing columns {', '.join(missing)}")
    return df


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per present column with its number of NULLs (``column_name, null_count``)."""
    present = [c for c in columns if c in df.columns]
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in present])
    return wide.unpivot([], present, "column_name", "null_count")


def require_non_null(df: DataFrame, columns: Sequence[str], name: str = "table") -> DataFrame:
    bad = null_counts(df, columns).filter("null_count > 0").orderBy("column_name").collect()
    if bad:
        raise QualityError(f"{name}: NULLs in {', '.join(r.column_name for r in bad)}")
    return df


def duplicate_rows(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row: rows, distinct keys and rows beyond the first of their key.

    NULL keys compare equal. Counts per key are combined before the shuffle, so a hot key
    costs one partial row per task.
    """
    per_key = df.groupBy(*key).agg(F.count("*").alias("n"))
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("row_count"),
        F.count("*").alias("distinct_keys"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("duplicate_rows"),
    )


def require_unique(df: DataFrame, key: Sequence[str], name: str = "table") -> DataFrame:
    duplicates = duplicate_rows(df, key).first().duplicate_rows
    if duplicates:
        raise QualityError(f"{name}: {duplicates} duplicate rows on {', '.join(key)}")
    return df


def coerce(df: DataFrame, rules: Mapping[str, ColumnRule]) -> DataFrame:
    """Cast the ruled columns; unreadable values become NULL."""
    present = {c: r for c, r in rules.items() if c in df.columns}
    return df.withColumns({c: F.col(c).try_cast(r.type) for c, r in present.items()})


def schema_violations(df: DataFrame, rules: Mapping[str, ColumnRule]) -> DataFrame:
    """Rows ``(column_name, check_name, violations)`` for every rule of a present column."""
    checks: list[Column] = []
    labels: list[tuple[str, str]] = []
    for column, rule in rules.items():
        if column not in df.columns:
            continue
        raw = F.col(column)
        typed = raw.try_cast(rule.type)
        tests = {"type": raw.isNotNull() & typed.isNull()}
        if not rule.nullable:
            tests["nullability"] = raw.isNull()
        if rule.minimum is not None:
            tests["minimum"] = typed < rule.minimum
        for check, failed in tests.items():
            labels.append((column, check))
            checks.append(F.count_if(failed).alias(f"c{len(checks)}"))
    counted = df.agg(*checks)
    rows = F.array(
        *[
            F.struct(
                F.lit(column).alias("column_name"),
                F.lit(check).alias("check_name"),
                F.col(f"c{i}").alias("violations"),
            )
            for i, (column, check) in enumerate(labels)
        ]
    )
    return counted.select(F.inline(rows))


def contract_report(df: DataFrame, contract: Contract) -> DataFrame:
    """Row count, duplicate rows and NULL key cells of a table, in one plan."""
    require_columns(df, contract.required_columns, contract.name)
    checked = [c for c in (contract.non_null or contract.unique_key) if c in df.columns]
    key = list(contract.unique_key)
    per_key = df.groupBy(*key).agg(
        F.count("*").alias("_n"),
        *[F.count_if(F.col(c).isNull()).alias(f"_null_{i}") for i, c in enumerate(checked)],
    )
    nulls = F.lit(0)
    for i in range(len(checked)):
        nulls = nulls + F.coalesce(F.sum(f"_null_{i}"), F.lit(0))
    return per_key.agg(
        F.lit(contract.name).alias("table_name"),
        F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("row_count"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("long").alias("duplicate_rows"),
        nulls.cast("long").alias("null_key_cells"),
    )


def check_contract(df: DataFrame, contract: Contract) -> DataFrame:
    """Columns, then uniqueness, then NULL keys; raises at the first that fails."""
    report = contract_report(df, contract).first()
    if report.duplicate_rows:
        raise QualityError(f"{contract.name}: {report.duplicate_rows} duplicate rows")
    if report.null_key_cells:
        raise QualityError(f"{contract.name}: {report.null_key_cells} NULL key cells")
    return df


def inspect(df: DataFrame, key: Sequence[str], date_columns: Sequence[str] = ()) -> DataFrame:
    """Long profile ``(item, column_name, value)``: counts, NULLs, types, date ranges."""
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    facts: list[tuple[str, str, Column]] = [("row_count", "", F.count("*").cast("string"))]
    for c in df.columns:
        facts.append(("null_count", c, F.count_if(F.col(c).isNull()).cast("string")))
    for c in [c for c in date_columns if c in df.columns]:
        day = F.to_date(F.col(c)) if types[c] != "string" else F.try_to_date(F.col(c))
        facts.append(("date_min", c, F.min(day).cast("string")))
        facts.append(("date_max", c, F.max(day).cast("string")))
    wide = df.agg(*[f[2].alias(f"f{i}") for i, f in enumerate(facts)])
    rows = [
        F.struct(F.lit(item).alias("item"), F.lit(c).alias("column_name"), F.col(f"f{i}").alias("value"))
        for i, (item, c, _) in enumerate(facts)
    ]
    rows.append(
        F.struct(
            F.lit("column_count").alias("item"),
            F.lit("").alias("column_name"),
            F.lit(str(len(df.columns))).alias("value"),
        )
    )
    rows += [
        F.struct(F.lit("dtype").alias("item"), F.lit(c).alias("column_name"), F.lit(t).alias("value"))
        for c, t in types.items()
    ]
    profile = wide.select(F.inline(F.array(*rows)))
    duplicates = duplicate_rows(df, key).select(
        F.lit("duplicate_count").alias("item"),
        F.lit("").alias("column_name"),
        F.col("duplicate_rows").cast("string").alias("value"),
    )
    keep = (F.col("item") != "null_count") | (F.col("value") != "0")
    return profile.filter(keep & F.col("value").isNotNull()).unionByName(duplicates)


def inspection_summary(sources: Mapping[str, tuple[DataFrame, Sequence[str], str, Mapping[str, Column]]]) -> DataFrame:
    """One row per source: counts, date range and ``k=v; k=v`` notes.

    Each source is ``(frame, unique key, date column, named counters)``.
    """
    parts = []
    for name, (df, key, day_column, counters) in sources.items():
        key = list(key)
        day = F.to_date(day_column)
        per_key = df.groupBy(*key).agg(
            F.count("*").alias("_n"),
            F.min(day).alias("_min"),
            F.max(day).alias("_max"),
            *[F.count_if(c).alias(f"_c_{label}") for label, c in counters.items()],
        )
        notes = F.concat_ws(
            "; ",
            *[
                F.concat(F.lit(f"{label}="), F.sum(f"_c_{label}").cast("string"))
                for label in counters
            ],
        )
        parts.append(
            per_key.agg(
                F.lit(name).alias("source_name"),
                F.sum("_n").cast("long").alias("row_count"),
                F.lit(len(df.columns)).cast("long").alias("column_count"),
                F.sum(F.col("_n") - 1).cast("long").alias("duplicate_count"),
                F.min("_min").alias("date_min"),
                F.max("_max").alias("date_max"),
                notes.alias("notes"),
            )
        )
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def coverage_gaps(
    days: DataFrame, day: str, lookback_days: int = 90, delay_days: int = 0, *, newest: Column | None = None
) -> DataFrame:
    """Calendar days without data in the lookback before the newest allowed day.

    The newest allowed day is ``newest`` (by default the newest day of the table) minus
    ``delay_days``.
    """
    known = days.select(F.col(day).alias("_d")).distinct()
    last = F.date_sub(known.select(F.max("_d")).scalar() if newest is None else newest, delay_days)
    grid = days.sparkSession.range(1).select(
        F.explode(F.sequence(F.date_sub(last, lookback_days - 1), last)).alias("missing_day")
    )
    return grid.join(known, F.col("missing_day") == F.col("_d"), "left_anti")


def latest_day_status(days: DataFrame, day: str, limit: Column) -> DataFrame:
    """Newest day of a table and whether it lies before ``limit``."""
    newest = F.max(day)
    return days.agg(newest.alias("latest_day"), (newest < limit).alias("is_late"))


def dataset_summary(df: DataFrame, contract: Contract) -> DataFrame:
    return df.agg(
        F.lit(contract.name).alias("table_name"),
        F.count("*").alias("row_count"),
        F.lit(len(df.columns)).cast("long").alias("column_count"),
        F.lit("|".join(contract.unique_key)).alias("unique_key"),
    )


def table_fingerprint(df: DataFrame) -> DataFrame:
    """Row count and an order-insensitive digest of all cells.

    XOR alone cancels pairs of equal rows, so the sum of the hashes is kept as well.
    """
    digest = F.xxhash64(*[F.col(c) for c in sorted(df.columns)])
    return df.select(digest.alias("_h")).agg(
        F.count("*").alias("row_count"),
        F.bit_xor("_h").alias("xor_digest"),
        F.sum(F.col("_h").cast("decimal(20,0)")).alias("sum_digest"),
    )


def nested_status(metrics: DataFrame, parent: str, status: str = "status") -> DataFrame:
    """Status of each parent from the statuses of its leaves."""
    bad = F.bool_or(F.col(status).isin("error", "drifted"))
    thin = F.bool_or(F.col(status).isin("missing_data", "insufficient_data"))
    rolled = F.when(bad, "drifted").when(thin, "insufficient_data").otherwise("stable")
    return metrics.filter(F.col(status).isNotNull()).groupBy(parent).agg(rolled.alias("status"))


def monitor_status(statuses: DataFrame, status: str = "status") -> DataFrame:
    """Global monitor status over all checks."""
    critical = F.coalesce(F.bool_or(F.col(status).isin("error", "drifted")), F.lit(False))
    warning = F.coalesce(
        F.bool_or(F.col(status).isin("missing_data", "insufficient_data")), F.lit(False)
    )
    return statuses.agg(
        F.when(critical, "critical").when(warning, "warning").otherwise("ok").alias("global_status")
    )
