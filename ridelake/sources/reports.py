"""Daily ticket-validation reports: pipe-delimited Latin-1 text files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridelake.functions import times
from ridelake.operators.scale import materialized

# Layout of a report line and of the stored table.
REPORT_FIELDS = [
    "fecha_validacion",
    "linea",
    "estacion",
    "cod_eq",
    "tipo_validacion",
    "tipo_titulo",
    "id_tarjeta",
    "num_tarjeta",
    "dinero_deducido",
    "saldo_restante",
    "viajes_deducidos",
]
STORED_COLUMNS = [
    *REPORT_FIELDS,
    "fecha_validacion_hora_estimada",
    "fecha_generacion",
    "rango_desde",
    "rango_hasta",
    "rango_fechas_raw",
    "dia",
    "archivo_origen",
    "fecha_validacion_iso",
    "fecha_generacion_iso",
    "rango_desde_iso",
    "rango_hasta_iso",
    "_orden_manifest",
    "idtarjeta",
]
TEXT_DEFAULTS = {
    "linea": "DESCONOCIDA",
    "estacion": "DESCONOCIDA",
    "cod_eq": "DESCONOCIDO",
    "tipo_validacion": "DESCONOCIDA",
    "tipo_titulo": "DESCONOCIDO",
    "id_tarjeta": "No aplica",
}
HEADER_LINES = 4
DAY_FOLDERS = "/\\d{4}/\\d{2}_\\d{4}/\\d{6}/"
#: Fixed value: how the name of a validation report begins; other files of a day are not its report.
REPORT_STEM = "Validaciones detalladas "
_STAMP = "\\d{2}-\\d{2}-\\d{4}\\s+\\d{2}:\\d{2}(?::\\d{2})?"


def report_files(spark: SparkSession, directory: str) -> DataFrame:
    """Report files as binary rows (``path, modificationTime, length, content``).

    One file is one day of one network and is decoded whole by one task.
    """
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.csv")
        .load(directory)
    )


def report_day(path: Column, stem: str = REPORT_STEM) -> Column:
    """Day of a report from its path, NULL when folders or file name have another shape."""
    digits = F.regexp_extract(path, f"{DAY_FOLDERS}\\Q{stem}\\E(\\d{{6}})\\.csv$", 1)
    return F.to_date(F.try_to_timestamp(F.nullif(digits, F.lit("")), F.lit("ddMMyy")))


def report_header(content: Column) -> Column:
    """Struct with the generation time and the date range of a report's second line."""
    # Only the first two lines are cut off, however long the file is.
    second = F.get(F.split(content, "\n", 3), F.lit(1))

    def stamp(pattern: str, group: int = 1) -> Column:
        return F.nullif(F.regexp_extract(second, pattern, group), F.lit(""))

    span = f"Rango de Fechas:\\s*({_STAMP})\\s*-\\s*({_STAMP})"
    start, end = stamp(span, 1), stamp(span, 2)
    return F.struct(
        times.parse_report_timestamp(stamp(f"Generado:\\s*({_STAMP})")).alias("fecha_generacion"),
        times.parse_report_timestamp(start).alias("rango_desde"),
        times.parse_report_timestamp(end).alias("rango_hasta"),
        F.coalesce(F.concat(start, F.lit(" - "), end), F.lit("")).alias("rango_fechas_raw"),
    )


def report_parts(line: Column) -> Column:
    """Trimmed, non-empty parts of a report line, still quoted."""
    return F.array_remove(F.split(F.btrim(line, F.lit(" \t\r")), "\\s*\\|\\s*"), "")


def has_enough_parts(line: Column) -> Column:
    """Cheap test before a line is taken apart: enough separators."""
    return F.substring_index(line, "|", len(REPORT_FIELDS) - 1) != line


def parse_reports(files: DataFrame) -> DataFrame:
    """Raw text rows of report files, with the report day and header fields."""
    decoded = files.select(
        F.col("path").alias("archivo_origen"),
        report_day(F.col("path")).alias("_day"),
        F.decode("content", "ISO-8859-1").alias("_text"),
    ).filter(F.col("_day").isNotNull())
    headed = decoded.withColumn("_header", report_header(F.col("_text")))
    lines = headed.select(
        "archivo_origen",
        "_day",
        "_header",
        # A carriage return at the end of a line goes with the blanks around its parts.
        F.posexplode(F.split("_text", "\n")).alias("_pos", "_line"),
    ).filter((F.col("_pos") >= HEADER_LINES) & has_enough_parts(F.col("_line")))
    # Head and total lines are recognised on the raw line. The parts are taken as a list of one,
    # emptied where their number is wrong: a filter behind them would have the line taken apart twice.
    title = F.col("_line").rlike('^[\\s|]*"*(Fecha|Total)')
    whole = F.filter(F.array(report_parts(F.col("_line"))), lambda parts: F.size(parts) == len(REPORT_FIELDS))
    rows = lines.filter(~title).select("archivo_origen", "_day", "_header", F.explode(whole).alias("_parts"))
    return rows.select(
        *[F.btrim(F.get("_parts", F.lit(i)), F.lit('"')).alias(c) for i, c in enumerate(REPORT_FIELDS)],
        "_header.*",
        F.date_format("_day", "yyyy-MM-dd").alias("dia"),
        "archivo_origen",
    )


def type_raw_rows(rows: DataFrame) -> DataFrame:
    """Typed validations with defaults for missing text and ISO copies of the times."""
    def iso(column: str) -> Column:
        return F.date_format(column, "yyyy-MM-dd'T'HH:mm:ssXXX")

    stamp = F.try_to_timestamp("fecha_validacion", F.lit("dd-MM-yyyy HH:mm:ss"))
    typed = rows.withColumns(
        {
            "fecha_validacion": stamp,
            **{c: F.coalesce(F.col(c), F.lit(d)) for c, d in TEXT_DEFAULTS.items()},
            "num_tarjeta": F.regexp_replace(F.coalesce("num_tarjeta", F.lit("")), "\\.0$", ""),
            "dinero_deducido": times.clean_number(F.col("dinero_deducido")),
            "saldo_restante": times.clean_number(F.col("saldo_restante")),
            "viajes_deducidos": times.clean_number(F.col("viajes_deducidos")).cast("long"),
            "fecha_validacion_hora_estimada": F.lit(False),
            "idtarjeta": F.lit(None).cast("string"),
        }
    )
    return typed.withColumns(
        {
            "fecha_validacion_iso": F.date_format("fecha_validacion", "yyyy-MM-dd'T'HH:mm:ssXX"),
            **{f"{c}_iso": F.coalesce(iso(c), F.lit("")) for c in ("fecha_generacion", "rango_desde", "rango_hasta")},
        }
    )


def number_manifests(rows: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Add ``_orden_manifest``: stored days keep their number, new days follow in date order.

    Only distinct days are numbered, never rows.
    """
    days = rows.select("dia").distinct()
    if stored is None:
        known = days.limit(0).withColumn("manifest_id", F.lit(0).cast("long"))
    else:
        known = stored.groupBy("dia").agg(F.max("_orden_manifest").cast("long").alias("manifest_id"))
    highest = known.select(F.coalesce(F.max("manifest_id"), F.lit(0))).scalar()
    fresh = days.join(known, "dia", "left_anti").withColumn(
        "manifest_id", (F.row_number().over(Window.orderBy("dia")) + highest).cast("long")
    )
    numbers = known.unionByName(fresh).withColumnRenamed("manifest_id", "_orden_manifest")
    return rows.join(numbers, "dia")


def consolidated_rows(files: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Stored-layout rows of report files.

    Files are parsed at once, into a checkpoint: the days to be numbered, the rows that get the
    numbers and whatever the caller does with them read that.
    """
    parsed = materialized(type_raw_rows(parse_reports(files)))
    return number_manifests(parsed, stored).select(*STORED_COLUMNS)


def read_daily_reports(spark: SparkSession, directory: str) -> DataFrame:
    return type_raw_rows(parse_reports(report_files(spark, directory)))
