"""Sinks. Writes are plain or partition-wise overwrites, or commits of new folders: a retried job is safe."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridelake.operators.quality import Contract, check_contract
from ridelake.sources.readers import path_exists

SPEC_PARTITIONS = ["feature_variant", "series_policy", "horizon_days"]
RUN_PARTITIONS = ["model_name", "variant", "series_policy", "horizon_days"]


def write_output(df: DataFrame, path: str, contract: Contract) -> str:
    """Write a table in its contract's format (CSV for reports) after checking it."""
    checked = check_contract(df, contract) if contract.unique_key else df
    if contract.grain == "report":
        target = f"{path}/{contract.name}.csv"
        checked.write.mode("overwrite").option("header", True).csv(target)
    else:
        target = f"{path}/{contract.name}.parquet"
        checked.write.mode("overwrite").parquet(target)
    return target


def replace_days(stored: DataFrame, fresh: DataFrame, day: str = "dia") -> DataFrame:
    """Stored rows without the freshly parsed days, plus the fresh rows."""
    days = fresh.select(day).distinct()
    return stored.join(days, day, "left_anti").unionByName(fresh, allowMissingColumns=True)


def upsert_days(fresh: DataFrame, path: str, day: str = "dia", *, version: str | None = None) -> str:
    """Replace the days that ``fresh`` holds, all at once; returns the name of the new version.

    Rows go to a folder of their own below ``<path>/data``, which no reader looks at until the
    commit below ``<path>/commits`` names it: one small file with a row per day. So a reader sees
    all days of an upsert or none, a writer that dies leaves the store as it was, and writers that
    run side by side do not touch each other's files. Commits are numbered one above the highest
    that a writer sees; of equal numbers the larger version name is the newer one for everybody.

    A writer that gives its own ``version`` (a stream: its batch) may be run again: the version
    that is committed stays as it is. Days without fresh rows keep their data.
    """
    spark = fresh.sparkSession
    version = version or uuid.uuid4().hex
    known = commits(spark, path, day)
    if not known.filter(F.col("version") == version).isEmpty():
        return version
    fresh.write.mode("overwrite").partitionBy(day).parquet(f"{path}/data/version={version}")
    number = known.select(F.coalesce(F.max("number"), F.lit(0)) + 1).scalar()
    written = spark.read.option("basePath", f"{path}/data").parquet(f"{path}/data/version={version}")
    days = written.select("version", F.col(day).cast("string").alias(day), number.alias("number")).distinct()
    days.coalesce(1).write.mode("overwrite").parquet(f"{path}/commits/{version}")
    return version


def commits(spark: SparkSession, path: str, day: str = "dia") -> DataFrame:
    """(version, day, number) of all commits of a store of days."""
    schema = f"version string, `{day}` string, number long"
    if not path_exists(spark, f"{path}/commits"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/commits/*")


def read_days(spark: SparkSession, path: str, day: str = "dia") -> DataFrame:
    """Rows of a store of days: of each day, those of the newest version that holds it.

    A day is a partition, so that older versions of it are pruned, not read.
    """
    newest = F.max(F.struct("number", "version"))["version"].alias("version")
    live = commits(spark, path, day).groupBy(day).agg(newest)
    stored = spark.read.option("basePath", f"{path}/data").parquet(f"{path}/data")
    stored = stored.withColumns({"version": F.col("version").cast("string"), day: F.col(day).cast("string")})
    return stored.join(live, ["version", day], "left_semi").drop("version")


def persist_training_specs(datasets: Sequence[DataFrame], catalog: DataFrame, diagnostics: DataFrame, path: str) -> None:
    """All training datasets in one partitioned table, with catalogue, diagnostics and manifest."""
    merged = datasets[0]
    for dataset in datasets[1:]:
        merged = merged.unionByName(dataset, allowMissingColumns=True)
    merged.write.mode("overwrite").partitionBy(*SPEC_PARTITIONS).parquet(f"{path}/datasets")
    catalog.write.mode("overwrite").parquet(f"{path}/feature_catalog")
    diagnostics.write.mode("overwrite").parquet(f"{path}/panel_diagnostics")
    written = diagnostics.sparkSession.read.parquet(f"{path}/datasets")
    manifest = written.groupBy(*SPEC_PARTITIONS).agg(
        F.count("*").alias("row_count"),
        F.countDistinct("series_id").alias("series_count"),
        F.min("forecast_origin_date").alias("forecast_origin_min"),
        F.max("forecast_origin_date").alias("forecast_origin_max"),
        F.min("target_date").alias("target_min"),
        F.max("target_date").alias("target_max"),
    )
    manifest.write.mode("overwrite").json(f"{path}/manifest")


def _replace_parts(df: DataFrame, by: Sequence[str], path: str, fmt: str = "parquet") -> None:
    """Overwrite the partitions that ``df`` holds rows of, and leave all others."""
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by)
    writer.format(fmt).option("header", fmt == "csv").save(path)


def persist_experiment(
    predictions: DataFrame,
    metrics: DataFrame,
    path: str,
    model: PipelineModel | None = None,
    *,
    catalog: DataFrame | None = None,
    used: DataFrame | None = None,
    metadata: DataFrame | None = None,
) -> None:
    """Predictions by run, the metric tables as CSV, used features, metadata and the fitted pipeline.

    Each table may hold many runs (``RUN_PARTITIONS``), and replaces those it holds only. ``used``
    has a row per run and feature; the entries of the feature catalogue are stored for them, and a
    feature that the catalogue lacks is left out. ``metadata`` has a row per run, stored as JSON.
    """
    _replace_parts(predictions, RUN_PARTITIONS, f"{path}/predictions")
    run = [c for c in RUN_PARTITIONS if c in metrics.columns]
    _replace_parts(metrics, [*run, "metric_level"], f"{path}/metrics", "csv")
    if catalog is not None and used is not None:
        features = used.select(*RUN_PARTITIONS, "feature_name").distinct().join(catalog, "feature_name")
        _replace_parts(features, RUN_PARTITIONS, f"{path}/features", "csv")
    if metadata is not None:
        _replace_parts(metadata, RUN_PARTITIONS, f"{path}/metadata", "json")
    if model is not None:
        model.write().overwrite().save(f"{path}/model")


def save_scenario_result(
    predictions: DataFrame, aggregates: DataFrame, audit: DataFrame, path: str, explanations: DataFrame | None = None
) -> None:
    """Replace the rows of the executions at hand; audit events are only ever appended.

    An execution that has predictions and no explanation replaces its earlier explanations by one
    row of NULLs, which ``read_explanations`` leaves out.
    """
    _replace_parts(predictions, ["execution_id"], f"{path}/predictions")
    _replace_parts(aggregates, ["execution_id"], f"{path}/aggregates")
    if explanations is not None:
        executions = predictions.select("execution_id").distinct()
        marked = explanations.withColumn("is_explanation", F.lit(True))
        _replace_parts(executions.join(marked, "execution_id", "full"), ["execution_id"], f"{path}/explanations")
    audit.write.mode("append").parquet(f"{path}/audit_events")


def read_explanations(spark: SparkSession, path: str) -> DataFrame:
    """Explanations of all executions, as they were saved last."""
    return spark.read.parquet(f"{path}/explanations").filter("is_explanation").drop("is_explanation")


def write_smoke_predictions(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(f"{path}/smoke_predictions.parquet")
    df.write.mode("overwrite").option("header", True).csv(f"{path}/smoke_predictions.csv")
