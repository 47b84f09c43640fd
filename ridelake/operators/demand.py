"""From raw ticket validations to the daily demand table and the modelling base."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridelake.functions import text, times
from ridelake.operators import joins
from ridelake.operators.quality import require_unique

# Attribute columns that may be joined from the station and line masters.
STATION_COLUMNS = [
    "linea",
    "estacion",
    "station_join_key",
    "station_display_name",
    "station_abbrev",
    "network_order",
    "lat",
    "lon",
    "zone",
    "station_group",
    "is_interchange_candidate",
    "station_reference_label",
]
LINE_COLUMNS = ["linea", "line_reference_path"]

# Change type -> column of the daily network-change table.
NETWORK_CHANGE_COLUMNS = {
    "equipment_first_seen": "network_equipment_first_seen_count",
    "equipment_last_seen_observed": "network_equipment_last_seen_observed_count",
    "line_station_first_seen": "network_line_station_first_seen_count",
    "line_station_last_seen_observed": "network_line_station_last_seen_observed_count",
}

DEMAND_KEY = ["service_date", "linea", "estacion"]


def filter_trips(df: DataFrame, type_column: str = "tipo_validacion", title_column: str | None = None) -> DataFrame:
    """Validations that are trips: an entry, regularisation or transfer with a listed title."""
    title = title_column or ("tipo_titulo_limpio" if "tipo_titulo_limpio" in df.columns else "tipo_titulo")
    typed = df.withColumns(
        {
            "tipo_validacion_normalizada": text.canonical_validation_type(F.col(type_column)),
            "tipo_titulo_limpio": text.canonical_title(F.col(title)),
        }
    )
    is_trip = F.col("tipo_validacion_normalizada").rlike("|".join(text.TRIP_MARKERS))
    return typed.filter(is_trip & F.col("tipo_titulo_limpio").isNotNull())


def station_daily_trips(
    raw: DataFrame,
    *,
    boundary_hour: int = 0,
    boundary_minute: int = 0,
    keep_row: Column | None = None,
) -> DataFrame:
    """Trips per day, line and station with first/last time, equipment and missing counts.

    Rows are counted by their raw type and title first, so that the text rules of
    ``filter_trips`` see each of these strings once per group and not once per row; counts
    are combined per task before the shuffle. Distinct equipment is reduced per (group,
    equipment), so a hot station does not land in one task.
    """
    day = times.service_date(F.col("fecha_validacion"), boundary_hour, boundary_minute)
    usable = raw.withColumn("service_date", day).dropna(
        subset=["service_date", "fecha_validacion", "linea", "estacion"]
    )
    if keep_row is not None:
        usable = usable.filter(keep_row)
    estimated = F.coalesce(F.col("fecha_validacion_hora_estimada"), F.lit(False))
    money_missing = F.col("dinero_deducido").isNull() | F.col("saldo_restante").isNull()
    title = "tipo_titulo_limpio" if "tipo_titulo_limpio" in raw.columns else "tipo_titulo"
    per_label = usable.groupBy(*DEMAND_KEY, "cod_eq", "tipo_validacion", title).agg(
        F.count("*").alias("_n"),
        F.min("fecha_validacion").alias("_first"),
        F.max("fecha_validacion").alias("_last"),
        F.count_if(estimated).alias("_estimated"),
        F.count_if(money_missing).alias("_money"),
        F.count_if(F.col("viajes_deducidos").isNull()).alias("_trips"),
    )
    sums = ("_n", "_estimated", "_money", "_trips")
    per_equipment = filter_trips(per_label).groupBy(*DEMAND_KEY, "cod_eq").agg(
        F.min("_first").alias("_first"), F.max("_last").alias("_last"), *[F.sum(c).alias(c) for c in sums]
    )
    return per_equipment.groupBy(*DEMAND_KEY).agg(
        F.sum("_n").alias("trip_count"),
        F.min("_first").alias("first_trip_timestamp"),
        F.max("_last").alias("last_trip_timestamp"),
        F.count("cod_eq").alias("raw_unique_equipment_count"),
        F.sum("_estimated").alias("raw_rows_with_estimated_time"),
        F.sum("_money").alias("raw_missing_money_fields_count"),
        F.sum("_trips").alias("raw_missing_trip_fields_count"),
    )


def network_changes_daily(
    changes: DataFrame, *, boundary_hour: int = 0, boundary_minute: int = 0
) -> DataFrame:
    """Changes of each of four types per day, line and station, plus their total."""
    day = times.service_date(F.col("effective_date"), boundary_hour, boundary_minute)
    dated = changes.withColumn("service_date", day).dropna(subset=DEMAND_KEY)
    counted = dated.groupBy(*DEMAND_KEY).agg(
        *[
            F.count_if(F.col("change_type") == kind).alias(column)
            for kind, column in NETWORK_CHANGE_COLUMNS.items()
        ]
    )
    total = F.lit(0)
    for column in NETWORK_CHANGE_COLUMNS.values():
        total = total + F.col(column)
    return counted.withColumn("network_change_count", total.cast("long"))


def shared_codes(stations: DataFrame) -> DataFrame:
    """Station codes on more than one line, together with the codes always shared."""
    code = text.station_code(F.col("station_abbrev"))
    found = (
        stations.dropna(subset=["station_abbrev", "linea"])
        .groupBy(code.alias("station_abbrev"))
        .agg(F.countDistinct("linea").alias("_lines"))
        .filter("_lines > 1")
        .select("station_abbrev")
    )
    fixed = stations.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(c) for c in text.ALWAYS_SHARED_CODES])).alias("station_abbrev")
    )
    return found.union(fixed).distinct()


def add_series_id(df: DataFrame, stations: DataFrame) -> DataFrame:
    """Add ``series_id`` and ``series_label`` from line and station code."""
    shared = shared_codes(stations).withColumn("_shared", F.lit(True))
    coded = df.withColumn("station_abbrev", text.station_code(F.col("station_abbrev")))
    label = text.series_label(
        F.col("linea"), F.col("station_abbrev"), F.coalesce(F.col("_shared"), F.lit(False))
    )
    return (
        coded.join(shared, "station_abbrev", "left")
        .withColumns({"series_id": label, "series_label": label})
        .drop("_shared")
    )


def station_reference(stations: DataFrame) -> DataFrame:
    """Attribute columns of the station master that are safe to join."""
    present = [c for c in STATION_COLUMNS if c in stations.columns]
    return stations.select(*present).withColumn(
        "station_abbrev", text.station_code(F.col("station_abbrev"))
    )


def line_reference(lines: DataFrame) -> DataFrame:
    return lines.select(*[c for c in LINE_COLUMNS if c in lines.columns])


def station_groups(stations: DataFrame) -> DataFrame:
    """Attributes and number of lines per station code; NULL codes form a group.

    "First" is by network order, then line, and skips NULLs.
    """
    order = F.struct(F.col("network_order"), F.col("linea"))

    def first(column: str) -> Column:
        return F.min_by(column, F.when(F.col(column).isNotNull(), order)).alias(column)

    return (
        stations.groupBy("station_abbrev")
        .agg(
            first("station_join_key"),
            first("station_group"),
            first("station_display_name"),
            F.countDistinct("linea").alias("line_count"),
        )
        .withColumn("is_shared_between_lines", F.col("line_count") > 1)
    )


def build_model_base(
    trips: DataFrame,
    external: DataFrame,
    stations: DataFrame,
    lines: DataFrame,
    network_changes: DataFrame,
    *,
    checked: bool = True,
) -> DataFrame:
    """Daily demand with calendar, station, line and network-change attributes.

    ``checked`` puts the guards of the declared joins into the one plan of all joins, runs it once
    into a checkpoint and looks for repeated keys there; without it the result is one lazy plan
    of left joins.
    """
    sides = {
        "external": external,
        "stations": station_reference(stations),
        "lines": line_reference(lines),
        "network_changes": network_changes,
    }
    base = trips
    for name, side in sides.items():
        contract = joins.MODEL_BASE_JOINS[name]
        if checked:
            base = joins.guarded_contract_join(base, side, contract, name)
        else:
            base = joins.left_join(base, side, contract.left_keys, contract.right_keys)
    change_columns = [*NETWORK_CHANGE_COLUMNS.values(), "network_change_count"]
    base = base.fillna(0, subset=[c for c in change_columns if c in base.columns])
    base = add_series_id(base, stations)
    if checked:
        base = joins.checked(base)
        require_unique(base, ["service_date", "series_id"], "model base")
    return base


def daily_total(raw: DataFrame, day: str = "dia", trips: str = "viajes_deducidos") -> DataFrame:
    """Deducted trips per day (input of the demand drift check)."""
    return raw.groupBy(day).agg(F.coalesce(F.sum(trips), F.lit(0)).alias(trips))


def manifest_by_day(raw: DataFrame) -> DataFrame:
    return raw.groupBy("dia").agg(F.max("_orden_manifest").alias("manifest_id"))


def interval_demand(trips: DataFrame, interval: str = "15 minutes", series: str = "series_id") -> DataFrame:
    """Trips per series and time interval; works on batch and streaming frames."""
    return (
        trips.groupBy(F.window("fecha_validacion", interval).alias("_w"), series)
        .agg(F.count("*").alias("trip_count"))
        .select(series, F.col("_w.start").alias("interval_start"), "trip_count")
    )
