"""Planned services, events and incidents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridelake.functions import text, times
from ridelake.operators.demand import station_groups
from ridelake.operators.scale import materialized

HIGH_IMPACT_ATTENDANCE = 10000
NON_STATION_CODES = ["TYC"]

# Location texts of whole lines and the keywords of the other scopes.
LINE_LOCATIONS = ["LINEA 1", "LINEA 2"]
CROSSING_KEYWORDS = ["CRUCE"]
DEPOT_KEYWORDS = ["COCHERAS", "TALLERES", "RECINTO CMM"]
NETWORK_KEYWORDS = ["RED DE METRO DE MALAGA", "LINEA 1 Y 2"]

# Folded service effect -> count column of the daily incident table.
EFFECT_COLUMNS = {
    "retrasos": "delay_incident_count",
    "servicio parcial": "partial_service_incident_count",
    "paro de la linea": "line_stop_incident_count",
    "via unica temporal": "single_track_incident_count",
}

# Measures of event days; note and scope names below are fixed as well.
EVENT_MEASURES = [
    "active_event_count",
    "starting_event_count",
    "ending_event_count",
    "starting_estimated_attendance_sum",
    "starting_unknown_attendance_count",
    "high_impact_starting_event_count",
]


# Services -------------------------------------------------------------------------------


def services_daily(services: DataFrame, rollover_minutes: int = times.SERVICE_ROLLOVER_MINUTES) -> DataFrame:
    """Planned service per day with start, line ends and the effective end.

    The effective end is the later line end on the service axis; line 1 wins a tie.
    """
    parsed = services
    for column, prefix in (
        ("inicio_serv_comercial", "commercial_start"),
        ("fin_l1_serv_comercial", "line_1_end"),
        ("fin_l2_serv_comercial", "line_2_end"),
    ):
        parsed = times.add_service_time(parsed, column, prefix, rollover_minutes)
    parsed = parsed.withColumns(
        {
            "planned_service_xml_name": text.clean_service_name(F.col("archivo_xml_planificado")),
            "used_service_xml_name": text.clean_service_name(F.col("archivo_xml_usado")),
        }
    )
    first, second = F.col("line_1_end_minutes"), F.col("line_2_end_minutes")
    source = (
        F.when(second.isNull() | (first >= second), F.when(first.isNotNull(), "line_1")).otherwise("line_2")
    )
    planned, used = F.col("planned_service_xml_name"), F.col("used_service_xml_name")

    def effective(field: str) -> Column:
        return F.when(F.col("commercial_end_source") == "line_1", F.col(f"line_1_end_{field}")).when(
            F.col("commercial_end_source") == "line_2", F.col(f"line_2_end_{field}")
        )

    return parsed.withColumn("commercial_end_source", source).select(
        F.to_date("fecha").alias("service_date"),
        F.col("servicio").alias("service_name_raw"),
        "planned_service_xml_name",
        "used_service_xml_name",
        text.service_code(planned).alias("planned_service_code"),
        text.service_code(used).alias("used_service_code"),
        F.coalesce(planned != used, F.lit(False)).alias("used_service_override_flag"),
        *[
            f"{prefix}_{field}"
            for prefix in ("commercial_start", "line_1_end", "line_2_end")
            for field in ("time", "minutes", "day_offset")
        ],
        effective("time").alias("commercial_end_time_effective"),
        effective("minutes").alias("commercial_end_minutes"),
        effective("day_offset").alias("commercial_end_day_offset"),
        "commercial_end_source",
    )


def services_line_daily(daily: DataFrame) -> DataFrame:
    """One row per day and line that has an end."""
    shared = [
        "service_date",
        "service_name_raw",
        "planned_service_xml_name",
        "used_service_xml_name",
        "commercial_start_time",
        "commercial_start_minutes",
    ]
    lines = F.array(
        *[
            F.struct(
                F.lit(line).alias("linea"),
                F.col(f"line_{i}_end_time").alias("line_end_time"),
                F.col(f"line_{i}_end_minutes").alias("line_end_minutes"),
                F.col(f"line_{i}_end_day_offset").alias("line_end_day_offset"),
            )
            for i, line in enumerate(LINE_LOCATIONS, start=1)
        ]
    )
    return daily.select(*shared, F.inline(lines)).filter("line_end_minutes IS NOT NULL")


def inspect_services(daily: DataFrame) -> DataFrame:
    planned = F.col("planned_service_xml_name").isNotNull()
    used = F.col("used_service_xml_name").isNotNull()
    return daily.agg(
        F.count("*").alias("row_count"),
        F.count_if(planned).alias("rows_with_planned"),
        F.count_if(used).alias("rows_with_used"),
        F.count_if(planned & used).alias("rows_with_both"),
        F.count_if("used_service_override_flag").alias("rows_with_override"),
        F.count_if(F.col("line_1_end_day_offset") == 1).alias("line_1_overnight_ends"),
        F.count_if(F.col("line_2_end_day_offset") == 1).alias("line_2_overnight_ends"),
    )


# Events ---------------------------------------------------------------------------------


def events_normalized(events: DataFrame) -> DataFrame:
    """Events with repaired ends, durations, location keys and parsed attendance."""
    start = F.col("start_raw")
    attendance = text.clean_blank(F.col("attendance_raw"))
    parsed = events.withColumns(
        {
            "start_ts": start,
            "end_ts": times.rolled_end(start, F.col("end_raw")),
            "end_ts_correction_applied": times.end_was_rolled(start, F.col("end_raw")),
            "location_key": text.match_label(F.col("location_raw")),
            "_attendance": times.parse_attendance(attendance),
        }
    )
    return parsed.withColumns(
        {
            "start_date": F.to_date("start_ts"),
            "end_date": F.to_date("end_ts"),
            "duration_minutes": times.duration_minutes(F.col("start_ts"), F.col("end_ts"), 0),
            "attendance_estimated": F.col("_attendance.value"),
            "attendance_parse_status": F.col("_attendance.status"),
        }
    ).withColumn("is_multi_day_event", F.col("end_date") > F.col("start_date")).drop(
        "start_raw", "end_raw", "attendance_raw", "_attendance"
    )


def source_row_numbers(events: DataFrame, order: Sequence[str]) -> DataFrame:
    """Workbook row of each event: its position by ``order`` plus two (header and base 1).

    Rows without a first column come last. The ordering is cut into ranges of all its columns,
    written once to a checkpoint; positions are counted in each range and offset by the ranges
    before. So a busy month, or events without a start, spread over tasks; only rows that are
    equal in the whole ordering share one.
    """
    keys = [F.col(order[0]).asc_nulls_last(), *order[1:]]
    ranges = events.repartitionByRange(*keys)
    placed = materialized(ranges.withColumn("_range", F.spark_partition_id()))
    counts = placed.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("_range", F.coalesce(before, F.lit(0)).alias("_before"))
    position = F.row_number().over(Window.partitionBy("_range").orderBy(*keys))
    return (
        placed.withColumn("_i", position)
        .join(offsets, "_range")
        .withColumn("source_row_number", (F.col("_i") + F.col("_before") + 1).cast("long"))
        .drop("_range", "_i", "_before")
    )


def event_location_mapping(matrix: DataFrame, stations: DataFrame, location: str = "location_raw") -> DataFrame:
    """Unpivot a location x station-code matrix into one row per marked, known code.

    A mark is anything but blank, ``0`` or ``0.0``. A location without a known code keeps
    a single row with NULL codes. Lists per location are bounded by the number of columns.
    """
    codes = [c for c in matrix.columns if c != location]
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("station_code_raw"), F.col(c).cast("string").alias("_mark"))
            for c in codes
        ]
    )
    marks = matrix.select(location, F.inline(cells)).filter(
        F.col("_mark").isNotNull() & ~F.trim("_mark").isin("", "0", "0.0")
    )
    canonical = text.canonical_station_code(F.col("station_code_raw"))
    known = station_groups(stations).filter(F.col("station_abbrev").isNotNull())
    resolved = (
        marks.withColumn("_code", canonical)
        .withColumns({"_canonical": F.col("_code.code"), "_kind": F.col("_code.kind")})
        .join(known, F.col("_canonical") == F.col("station_abbrev"), "left")
    )
    outside = F.col("_canonical").isin(*NON_STATION_CODES)
    supported = F.col("station_abbrev").isNotNull() & ~outside
    unknown = ~supported & ~outside
    lists = resolved.groupBy(location).agg(
        F.count_if(supported).alias("station_mapping_count"),
        F.array_sort(F.collect_list(F.when(outside, F.col("_canonical")))).alias("_outside"),
        F.array_sort(F.collect_list(F.when(unknown, F.col("_canonical")))).alias("_unknown"),
    )
    rows = resolved.filter(supported).select(
        location,
        "station_code_raw",
        "station_abbrev",
        "station_join_key",
        "station_display_name",
        "station_group",
        "is_shared_between_lines",
        "line_count",
        F.when(F.col("_kind") == "alias", "matrix_alias").otherwise("matrix_exact").alias("mapping_confidence"),
    )
    return (
        matrix.select(location)
        .distinct()
        .join(lists, location, "left")
        .join(rows, location, "left")
        .withColumns(
            {
                "location_key": text.match_label(F.col(location)),
                "station_mapping_count": F.coalesce("station_mapping_count", F.lit(0)),
                "non_station_codes_present": text.join_list(F.col("_outside")),
                "unknown_station_codes_present": text.join_list(F.col("_unknown")),
            }
        )
        .drop("_outside", "_unknown")
    )


def event_station_impact(events: DataFrame, mapping: DataFrame) -> DataFrame:
    """Events joined with the stations of their location; events without one are dropped."""
    stations = mapping.filter(F.col("station_abbrev").isNotNull()).select(
        "location_key",
        "station_abbrev",
        "station_join_key",
        "station_display_name",
        "station_group",
        "is_shared_between_lines",
        "station_mapping_count",
        F.col("mapping_confidence").alias("location_mapping_confidence"),
        "non_station_codes_present",
        "unknown_station_codes_present",
    )
    return events.join(stations, "location_key")


def event_station_daily(events: DataFrame, mapping: DataFrame) -> DataFrame:
    """Event measures per day and station.

    Events are first combined per (location, start day, end day); only these combined rows
    meet the station mapping and are spread over their days, so neither a busy location
    nor a long event multiplies raw rows.
    """
    high = F.col("attendance_estimated") >= HIGH_IMPACT_ATTENDANCE
    spans = events.groupBy("location_key", "start_date", "end_date").agg(
        F.count("*").alias("_n"),
        F.coalesce(F.sum("attendance_estimated"), F.lit(0)).alias("_attendance"),
        F.count_if(F.col("attendance_parse_status") != "parsed").alias("_unknown"),
        F.count_if(high).alias("_high"),
    )
    stations = mapping.filter(F.col("station_abbrev").isNotNull()).select(
        "location_key", "station_abbrev", "station_join_key", "station_display_name"
    )
    days = (
        spans.filter("start_date IS NOT NULL AND end_date IS NOT NULL")
        .join(stations, "location_key")
        .withColumn("service_date", F.explode(F.sequence("start_date", "end_date")))
    )
    starting = F.col("service_date") == F.col("start_date")

    def total(measure: str, condition: Column | None = None) -> Column:
        value = F.col(measure) if condition is None else F.when(condition, F.col(measure)).otherwise(0)
        return F.sum(value).cast("long")

    return days.groupBy(
        "service_date", "station_abbrev", "station_join_key", "station_display_name"
    ).agg(
        total("_n").alias("active_event_count"),
        total("_n", starting).alias("starting_event_count"),
        total("_n", F.col("service_date") == F.col("end_date")).alias("ending_event_count"),
        total("_attendance", starting).alias("starting_estimated_attendance_sum"),
        total("_unknown", starting).alias("starting_unknown_attendance_count"),
        total("_high", starting).alias("high_impact_starting_event_count"),
    )


def event_series_daily(station_daily: DataFrame, stations: DataFrame) -> DataFrame:
    """Day-station measures on every line of the station, weighted by one over its lines."""
    keys = ["station_join_key", "station_abbrev", "station_display_name"]
    series = stations.select("linea", "estacion", *keys).distinct()
    lines = series.groupBy("station_join_key").agg(F.countDistinct("linea").alias("station_group_line_count"))
    joined = station_daily.join(series, keys, "left").join(lines, "station_join_key", "left")
    members = F.coalesce(F.col("station_group_line_count"), F.lit(1))
    weight = F.lit(1.0) / members
    columns: dict[str, Column] = {
        "shared_station_group_propagated": members > 1,
        "propagation_rule": F.when(members > 1, "broadcast_shared_station_group_to_member_lines").otherwise(
            "direct_unique_station_group_to_single_line"
        ),
        "deduplication_weight": weight,
    }
    for measure in EVENT_MEASURES:
        columns[f"{measure}_deduplicated"] = F.col(measure) * weight
    return joined.withColumns(columns)


def location_rollup(mapping: DataFrame, by: Sequence[str] = ("location_raw", "location_key")) -> DataFrame:
    """Code lists and number of mapped stations per location."""
    return mapping.groupBy(*by).agg(
        text.unique_join(F.col("station_code_raw")).alias("station_codes_raw"),
        text.unique_join(F.col("station_abbrev")).alias("station_codes_canonical"),
        F.count("station_abbrev").alias("station_mapping_count"),
        text.unique_join(F.col("non_station_codes_present")).alias("non_station_codes_present"),
        text.unique_join(F.col("unknown_station_codes_present")).alias("unknown_station_codes_present"),
    )


def event_mapping_report(events: DataFrame, mapping: DataFrame) -> DataFrame:
    """How each event location was mapped: by exact text, by key, or not at all."""
    counts = events.groupBy("location_raw", "location_key").agg(F.count("event_id").alias("event_count"))
    fields = [
        "station_codes_raw",
        "station_codes_canonical",
        "station_mapping_count",
        "non_station_codes_present",
        "unknown_station_codes_present",
    ]
    exact = location_rollup(mapping).select(
        F.col("location_raw").alias("_raw"),
        F.col("location_key").alias("_key"),
        *[F.col(c).alias(f"_e_{c}") for c in fields],
    )
    by_key = location_rollup(mapping, ["location_key"]).select(
        F.col("location_key").alias("_k"), *[F.col(c).alias(f"_k_{c}") for c in fields]
    )
    trimmed = mapping.select(F.trim("location_raw").alias("_t")).filter("_t IS NOT NULL").distinct()
    report = (
        counts.join(
            exact,
            F.col("location_raw").eqNullSafe(F.col("_raw")) & F.col("location_key").eqNullSafe(F.col("_key")),
            "left",
        )
        .join(by_key, F.col("location_key").eqNullSafe(F.col("_k")), "left")
        .join(trimmed, F.trim("location_raw") == F.col("_t"), "left")
        .withColumns({c: F.coalesce(f"_e_{c}", f"_k_{c}") for c in fields})
        .withColumns(
            {
                "exact_match_found": F.col("_t").isNotNull(),
                "normalized_match_found": F.col("_k").isNotNull(),
            }
        )
    )
    notes = (
        F.when(~F.col("normalized_match_found"), "location_missing_in_mapping_sheet")
        .when(~F.col("exact_match_found"), "normalized_text_match_only")
        .when(F.col("unknown_station_codes_present").isNotNull(), "unknown_station_codes_present")
        .when(F.col("station_mapping_count") > 1, "multi_station_location")
        .when(F.col("station_codes_canonical").isNull(), "no_station_mapping_after_code_filter")
    )
    return report.select(
        "location_raw",
        "location_key",
        "event_count",
        *fields,
        "exact_match_found",
        "normalized_match_found",
        notes.alias("notes"),
    )


def inspect_events(events: DataFrame, mapping: DataFrame) -> DataFrame:
    """Counters over events and their location mapping."""
    raw = mapping.select(F.col("location_raw").alias("_raw")).distinct()
    keys = mapping.select(F.col("location_key").alias("_key")).filter("_key IS NOT NULL").distinct()
    locations = events.groupBy("location_raw", "location_key").agg(F.count("*").alias("_n"))
    hits = locations.join(raw, F.col("location_raw") == F.col("_raw"), "left").join(
        keys, F.col("location_key") == F.col("_key"), "left"
    )
    event_side = hits.agg(
        F.sum("_n").alias("event_rows"),
        F.coalesce(F.sum(F.when(F.col("_raw").isNotNull(), F.col("_n"))), F.lit(0)).alias("exact_location_hits"),
        F.coalesce(F.sum(F.when(F.col("_key").isNotNull(), F.col("_n"))), F.lit(0)).alias("normalized_location_hits"),
    )
    per_location = mapping.groupBy("location_raw").agg(
        F.max("station_mapping_count").alias("_stations"),
        F.max("unknown_station_codes_present").alias("_unknown"),
    )
    mapping_side = per_location.agg(
        F.count_if(F.col("_stations") > 1).alias("multi_station_locations"),
        F.count_if(F.col("_unknown").isNotNull()).alias("locations_with_unknown_codes"),
    )
    both = mapping_side.select(F.struct("*")).scalar()
    return event_side.withColumns(
        {
            "multi_station_locations": both["multi_station_locations"],
            "locations_with_unknown_codes": both["locations_with_unknown_codes"],
        }
    )


# Incidents ------------------------------------------------------------------------------


def _any_keyword(key: Column, keywords: Sequence[str]) -> Column:
    folded = sorted({" ".join(text.plain_fold(k).split()) for k in keywords})
    hit = F.lit(False)
    for word in folded:
        hit = hit | key.contains(word)
    return F.coalesce(hit, F.lit(False))


def incident_scope(incidents: DataFrame, stations: DataFrame, location: str = "location_raw") -> DataFrame:
    """Scope and station or line of each incident from its location text.

    The text rules run once per distinct location; incidents then look theirs up, by whatever
    join the number of locations allows.
    """
    places = incidents.select(location).distinct()
    resolved = location_scope(places, stations, location).withColumnRenamed(location, "_place")
    return incidents.join(resolved, F.col(location).eqNullSafe(F.col("_place")), "left").drop("_place")


def location_scope(incidents: DataFrame, stations: DataFrame, location: str = "location_raw") -> DataFrame:
    """Scope and station or line of each location text.

    The prefix rule is case-sensitive and comes first; label rules compare folded text.
    """
    key = text.match_label(F.col(location))
    prefix = F.nullif(F.regexp_extract(F.col(location), "^([A-Z]{3})\\s*-", 1), F.lit(""))
    groups = station_groups(stations).filter(F.col("station_abbrev").isNotNull())
    lines = stations.groupBy("station_abbrev").agg(
        F.min_by("linea", F.struct("network_order", "linea")).alias("_line")
    )
    known = groups.join(lines, "station_abbrev").select(
        F.col("station_abbrev").alias("_station"),
        F.col("station_join_key").alias("_join_key"),
        F.col("station_display_name").alias("_display"),
        "line_count",
        "_line",
    )
    # The prefix is upper-case by its pattern, so only aliases need to be looked up.
    coded = (
        incidents.withColumns({"location_key": key, "station_prefix_raw": prefix})
        .withColumn("_alias", text.lookup(F.col("station_prefix_raw"), text.STATION_ALIASES))
        .withColumn("_code", F.coalesce("_alias", "station_prefix_raw"))
    )
    joined = coded.join(known, F.col("_code") == F.col("_station"), "left")

    line_value = text.lookup(
        F.col("location_key"), {text.plain_fold(line): line for line in LINE_LOCATIONS}
    )
    at_station = F.col("_station").isNotNull()
    unique_line = F.col("line_count") == 1
    scope = (
        F.when(at_station, "station")
        .when(line_value.isNotNull(), "line")
        .when(_any_keyword(F.col("location_key"), CROSSING_KEYWORDS), "crossing")
        .when(_any_keyword(F.col("location_key"), DEPOT_KEYWORDS), "depot")
        .when(_any_keyword(F.col("location_key"), NETWORK_KEYWORDS), "network")
        .when(F.col(location).rlike("^\\s*\\d+\\s*$"), "rolling_stock_or_asset")
        .otherwise("unknown")
    )
    confidence = (
        F.when(
            at_station,
            F.concat(
                F.lit("station_prefix_"),
                F.when(F.col("_alias").isNotNull(), "alias").otherwise("exact"),
                F.when(unique_line, "_unique_line").otherwise("_shared_station"),
            ),
        )
        .when(F.col("impact_scope") == "line", "line_exact")
        .otherwise(F.concat(F.col("impact_scope"), F.lit("_scope")))
    )
    return (
        joined.withColumn("impact_scope", scope)
        .withColumns(
            {
                "mapped_linea": F.when(at_station & unique_line, F.col("_line")).when(
                    F.col("impact_scope") == "line", line_value
                ),
                "mapped_station_abbrev": F.when(at_station, F.col("_code")),
                "mapped_station_join_key": F.col("_join_key"),
                "mapped_station_display_name": F.col("_display"),
                "mapping_confidence": confidence,
                "mapping_notes": F.when(at_station & ~unique_line, "station_shared_between_lines"),
            }
        )
        .drop("_alias", "_code", "_station", "_join_key", "_display", "line_count", "_line")
    )


def incidents_normalized(incidents: DataFrame, stations: DataFrame) -> DataFrame:
    """Incidents with timestamps, repaired ends, durations, delays and their scope."""
    stamped = incidents.withColumns(
        {
            "incident_start_ts": times.combine_date_time(F.col("origin_date"), F.col("start_clock")),
            "_end": times.combine_date_time(F.col("origin_date"), F.col("end_clock")),
            "delay_minutes": F.bround(times.parse_delay_seconds(F.col("delay_text")) / 60.0, 2),
        }
    )
    timed = stamped.withColumns(
        {
            "incident_end_ts": times.rolled_end(F.col("incident_start_ts"), F.col("_end")),
            "end_ts_correction_applied": times.end_was_rolled(F.col("incident_start_ts"), F.col("_end")),
        }
    ).withColumns(
        {
            "service_date": F.to_date("origin_date"),
            "incident_duration_minutes": times.duration_minutes(
                F.col("incident_start_ts"), F.col("incident_end_ts"), 2
            ),
        }
    )
    return incident_scope(timed.drop("_end"), stations)


def incidents_daily(normalized: DataFrame) -> DataFrame:
    """Incident counts, delays and durations per day, scope, line and station.

    Effects are counted by their raw text first, so that the label rule sees each text once
    per group.
    """
    keys = [
        "service_date",
        "impact_scope",
        "mapped_linea",
        "mapped_station_abbrev",
        "mapped_station_join_key",
        "mapped_station_display_name",
    ]
    per_effect = normalized.groupBy(*keys, "service_affectation").agg(
        F.count("*").alias("_rows"),
        F.count("incident_id").alias("_incidents"),
        F.sum("delay_minutes").alias("_delay"),
        F.max("delay_minutes").alias("_delay_max"),
        F.sum("incident_duration_minutes").alias("_duration"),
        F.max("incident_duration_minutes").alias("_duration_max"),
    )
    labelled = per_effect.withColumn("_effect", text.match_label(F.col("service_affectation")))

    def total(column: str) -> Column:
        return F.coalesce(F.sum(column), F.lit(0.0))

    return labelled.groupBy(*keys).agg(
        F.sum("_incidents").alias("incident_count"),
        total("_delay").alias("delay_minutes_sum"),
        F.max("_delay_max").alias("delay_minutes_max"),
        total("_duration").alias("incident_duration_minutes_sum"),
        F.max("_duration_max").alias("incident_duration_minutes_max"),
        *[
            F.coalesce(F.sum(F.when(F.col("_effect") == label, F.col("_rows"))), F.lit(0)).alias(column)
            for label, column in EFFECT_COLUMNS.items()
        ],
    )


def incident_mapping_report(normalized: DataFrame) -> DataFrame:
    return normalized.groupBy(
        "location_raw",
        "impact_scope",
        "station_prefix_raw",
        "mapped_station_abbrev",
        "mapped_linea",
        "mapping_confidence",
        "mapping_notes",
    ).agg(
        F.count("incident_id").alias("incident_count"),
        F.coalesce(F.sum("delay_minutes"), F.lit(0.0)).alias("delay_minutes_sum"),
        F.max("service_date").alias("latest_service_date"),
    )


def inspect_incidents(normalized: DataFrame) -> DataFrame:
    """Rows per impact scope with their mapped, delayed and repaired counts."""
    return normalized.groupBy("impact_scope").agg(
        F.count("*").alias("row_count"),
        F.count("mapped_station_abbrev").alias("mapped_station_rows"),
        F.count("mapped_linea").alias("mapped_line_rows"),
        F.count("delay_minutes").alias("rows_with_delay"),
        F.count_if("end_ts_correction_applied").alias("corrected_end_rows"),
    )
