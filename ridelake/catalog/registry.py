"""Registration of queries with their check SQL."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridelake.catalog.roles import Tables, ctes

QueryFunction = Callable[[Tables], DataFrame]


@dataclass(frozen=True)
class Query:
    run: QueryFunction
    sql: str | None


QUERIES: dict[str, Query] = {}
CTES: dict[str, str] = ctes()


def query(name: str, sql: str | None = None) -> Callable[[QueryFunction], QueryFunction]:
    """Register a query; ``sql`` is its check over the sample tables and the named CTEs."""
    def register(function: QueryFunction) -> QueryFunction:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = Query(function, sql)
        return function

    return register


def define(name: str, sql: str) -> None:
    """Add a named CTE for check queries; later ones may use earlier ones."""
    CTES[name] = sql


def presented(df: DataFrame) -> DataFrame:
    """Dates and timestamps as text, so that results compare the same in any client."""
    columns = {}
    for field in df.schema.fields:
        if isinstance(field.dataType, T.DateType):
            columns[field.name] = F.date_format(field.name, "yyyy-MM-dd")
        elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            columns[field.name] = F.date_format(field.name, "yyyy-MM-dd HH:mm:ss")
    return df.withColumns(columns) if columns else df


def runner(query_: Query) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: presented(query_.run(Tables(spark, folder)))


def complete_sql(sql: str) -> str:
    """The check SQL preceded by the CTEs it uses, each after the ones it needs itself."""
    ordered: list[str] = []

    def collect(text: str) -> None:
        for name, body in CTES.items():
            if name not in ordered and re.search(rf"\b{name}\b", text):
                collect(body)
                if name not in ordered:
                    ordered.append(name)

    collect(sql)
    parts = [f"{name} AS ({CTES[name]})" for name in ordered]
    return f"WITH {', '.join(parts)} {sql}" if parts else sql
