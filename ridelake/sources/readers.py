"""Table readers: contract tables, exports, metric files and run artefacts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridelake.functions.text import blank_to_null, snake_columns, snake_name
from ridelake.operators.quality import Contract, check_contract, require_columns

TABLE_PATTERNS = ["*.parquet", "*.csv", "*.xlsx", "*.xlsm"]


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or glob matches anything in its file system (driver metadata)."""
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.globStatus(hadoop_path)
    return found is not None and len(found) > 0


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None, **options) -> DataFrame:
    """Read by suffix; a missing path or an unknown suffix is an error."""
    suffix = path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
    if suffix in ("xlsx", "xlsm"):
        raise ValueError("workbooks are read from their CSV or Parquet exports")
    if suffix not in ("parquet", "csv"):
        raise ValueError(f"unsupported table format: {path}")
    if not path_exists(spark, path):
        raise FileNotFoundError(path)
    reader = spark.read.schema(schema) if schema else spark.read
    if suffix == "parquet":
        return reader.options(**options).parquet(path)
    return reader.options(**{"header": True, **options}).csv(path)


def discover_files(spark: SparkSession, directory: str, patterns: Sequence[str] = TABLE_PATTERNS) -> DataFrame:
    """Distinct sorted paths under a directory that match any pattern, without their content."""
    found = None
    for pattern in patterns:
        part = (
            spark.read.format("binaryFile")
            .option("recursiveFileLookup", True)
            .option("pathGlobFilter", pattern)
            .load(directory)
            .select("path", "modificationTime", "length")
        )
        found = part if found is None else found.unionByName(part)
    return found.dropDuplicates(["path"]).orderBy("path")


def discover_tables(spark: SparkSession, directory: str, patterns: Sequence[str] = TABLE_PATTERNS) -> DataFrame:
    """Distinct sorted tables under a directory, with their newest part and all their bytes.

    A table is a file, or the outermost folder with the suffix of the files in it, as Spark
    writes tables: ``orders.parquet/part-0.parquet`` is a part of ``orders.parquet``.
    """
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(directory)
    fs = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    above = len(fs.makeQualified(hadoop_path).toString().rstrip("/").split("/"))
    names = F.split("path", "/")
    suffix = F.concat(F.lit("."), F.element_at(F.split("path", "\\."), -1))
    below = F.transform(F.slice(names, above + 1, F.size(names)), lambda name: name.endswith(suffix))
    at = F.array_position(below, True).cast("int")
    table = F.when(at > 0, F.array_join(F.slice(names, F.lit(1), at + above), "/")).otherwise(F.col("path"))
    return (
        discover_files(spark, directory, patterns)
        .groupBy(table.alias("path"))
        .agg(F.max("modificationTime").alias("modificationTime"), F.sum("length").alias("length"))
        .orderBy("path")
    )


def read_contract_table(spark: SparkSession, path: str, contract: Contract, **options) -> DataFrame:
    return check_contract(read_table(spark, path, **options), contract)


def read_first_existing(
    spark: SparkSession, base: str, empty_schema: T.StructType | str | None = None
) -> DataFrame:
    """``base.parquet`` if present, else ``base.csv``, else an empty frame or an error."""
    for suffix in (".parquet", ".csv"):
        if path_exists(spark, base + suffix):
            return read_table(spark, base + suffix)
    if empty_schema is None:
        raise FileNotFoundError(f"neither {base}.parquet nor {base}.csv exists")
    return spark.createDataFrame([], empty_schema)


def read_workbook_export(
    spark: SparkSession, glob: str, required_columns: Sequence[str] = ()
) -> DataFrame:
    """The single export matching a glob, with snake-case headers and blanks as NULL."""
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(glob)
    fs = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    matches = [s.getPath() for s in (fs.globStatus(hadoop_path) or [])]
    usable = [p for p in matches if not p.getName().startswith("~$")]
    if not usable:
        raise FileNotFoundError(f"nothing matches {glob}")
    if len(usable) > 1:
        raise FileExistsError(f"{len(usable)} files match {glob}")
    frame = blank_to_null(snake_columns(read_table(spark, usable[0].toString())))
    return require_columns(frame, [snake_name(c) for c in required_columns], glob)


def list_records(pages: DataFrame) -> DataFrame:
    """One row per record of landed JSON pages, in either envelope (``value``, ``d.results``)."""
    candidates: list[Column] = []
    if "value" in pages.columns:
        candidates.append(F.col("value"))
    if "d" in pages.columns:
        candidates.append(F.col("d.results"))
    if not candidates:
        raise ValueError("pages hold neither value nor d.results")
    return pages.select(F.explode(F.coalesce(*candidates)).alias("_r")).select("_r.*")


def normalize_list_export(
    records: DataFrame, renames: dict[str, str] | None = None, excluded: Sequence[str] = ()
) -> DataFrame:
    """Records of a list service as a flat table.

    Columns that differ only in case keep their first form, metadata and excluded columns
    go, nested values become JSON text, and the rest get their contract names.
    """
    dropped = {e.lower() for e in excluded}
    seen: set[str] = set()
    columns: list[Column] = []
    for field in records.schema.fields:
        low = field.name.lower()
        if low in seen or low in dropped or low.startswith(("__", "odata.", "@odata.")):
            continue
        seen.add(low)
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.StructType, T.ArrayType, T.MapType)):
            column = F.when(column.isNotNull(), F.to_json(column))
        columns.append(column.alias((renames or {}).get(field.name, field.name)))
    return records.select(*columns)


def read_list_export(
    spark: SparkSession, glob: str, renames: dict[str, str] | None = None, excluded: Sequence[str] = ()
) -> DataFrame:
    pages = spark.read.option("multiLine", True).json(glob)
    return normalize_list_export(list_records(pages), renames, excluded)


def parse_demand_history(raw: DataFrame, date: str = "Fecha", value: str = "Viajeros") -> DataFrame:
    """Date and value of text rows; a byte-order mark is tolerated, bad rows are dropped."""
    clean = raw.toDF(*[c.replace("\ufeff", "").strip() for c in raw.columns])
    day = F.coalesce(
        F.to_date(F.try_to_timestamp(F.substring(date, 1, 10), F.lit("yyyy-MM-dd"))),
        F.to_date(F.try_to_timestamp(F.substring(date, 1, 10), F.lit("dd/MM/yyyy"))),
    )
    return clean.select(
        day.alias("target_date"), F.translate(F.col(value), ",", ".").try_cast("double").alias("actual")
    ).dropna()


def read_demand_history(
    spark: SparkSession, path: str, date: str = "Fecha", value: str = "Viajeros"
) -> DataFrame:
    """``parse_demand_history`` of a file with a header."""
    return parse_demand_history(spark.read.option("header", True).csv(path), date, value)


#: Text columns of metric and prediction files; all others are numbers.
METRIC_TEXTS = {
    "model_name", "model_label", "variant", "series_policy", "split_name", "split_type", "metric_level", "horizon",
    "linea", "estacion", "series_id", "station_abbrev", "segment_name",
}


def parse_metric_rows(rows: DataFrame) -> DataFrame:
    """Text rows of metric files with numbers as doubles; what is no number becomes NULL."""
    return rows.select(*[F.col(c) if c in METRIC_TEXTS else F.col(c).try_cast("double").alias(c) for c in rows.columns])


def read_metric_files(spark: SparkSession, glob: str) -> DataFrame:
    """All metric files of a pattern as one table; types follow from the names, in one pass."""
    return parse_metric_rows(spark.read.options(header=True, enforceSchema=False).csv(glob))


def run_folders(path: Column, names: Sequence[str] = ("model_name", "variant", "series_policy", "horizon_days")) -> Column:
    """Struct of the ``name=value`` folders of a run artifact's path; the horizon is a number."""
    found = [F.nullif(F.regexp_extract(path, f"/{n}=([^/]*)/", 1), F.lit("")).alias(n) for n in names]
    typed = [c.cast("int").alias(n) if n == "horizon_days" else c for n, c in zip(names, found, strict=True)]
    return F.struct(*typed)


def read_run_artifacts(spark: SparkSession, root: str) -> DataFrame:
    """Predictions of all runs; model, variant, policy and horizon come from the folders."""
    return spark.read.option("basePath", root).parquet(root).withColumn(
        "horizon_days", F.col("horizon_days").cast("int")
    )


def station_catalog(
    forecasts: DataFrame, order: str, fallback: DataFrame | None = None
) -> DataFrame:
    """First row per series by file order, baselines excluded, sorted by network order."""
    attributes = ["linea", "estacion", "station_abbrev", "network_order"]
    rows = forecasts
    if "model_variant" in forecasts.columns:
        rows = rows.filter(~F.coalesce(F.col("model_variant"), F.lit("")).startswith("baseline"))
    first = rows.groupBy("series_id").agg(F.min_by(F.struct(*attributes), order).alias("_row"))
    catalog = first.select("series_id", "_row.*")
    if fallback is not None and catalog.isEmpty():
        catalog = fallback.select("series_id", *attributes)
    return catalog.orderBy("network_order", "series_id")


def deduplicate_first(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key in a given order; the row cut is applied before the shuffle."""
    ranked = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_i", F.row_number().over(ranked)).filter("_i = 1").drop("_i")
