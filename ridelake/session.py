"""Session defaults for local runs and clusters."""

from __future__ import annotations

from pyspark.sql import SparkSession

LOCAL_TIMEZONE = "Europe/Madrid"

_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
}


def build_session(
    app_name: str = "ridelake",
    *,
    master: str | None = None,
    timezone: str = "UTC",
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Session with adaptive execution, dynamic partition overwrite and a fixed timezone.

    ``master`` and ``shuffle_partitions`` are for local runs; on a cluster both come from
    the submit command.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    options = {**_DEFAULTS, "spark.sql.session.timeZone": timezone, **(extra or {})}
    for key, value in options.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``.

    Where a session leaves it unset, as local ones do, a folder of the warehouse (which every
    node sees as well) is taken and set; a machine-local temporary folder never is.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or f"{warehouse}/_checkpoints")
    return context.getCheckpointDir()
