"""Scalar normalisation over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ridelake.catalog.registry import define, query
from ridelake.functions import domain, text, times

FOLD_SQL = (
    "trim(regexp_replace(replace(replace(lower(strip_accents({0})), '_', ' '), '-', ' '), '\\s+', ' ', 'g'))"
)
LABEL_SQL = "trim(lower(regexp_replace(strip_accents({0}), '[^0-9A-Za-z]+', ' ', 'g')))"


@query(
    "NRM1_fold_text",
    f"SELECT doc_id, md5({FOLD_SQL.format('text')}) AS folded_hash, "
    f"length({FOLD_SQL.format('text')}) AS folded_length FROM documents",
)
def fold_text(t):
    """Every second document is first garbled as Latin-1; folding must undo that."""
    garbled = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    source = F.when(F.col("doc_id") % 2 == 0, garbled).otherwise(F.col("text"))
    folded = t.documents.select("doc_id", text.fold_text(source).alias("_f"))
    return folded.select(
        "doc_id", F.md5("_f").alias("folded_hash"), F.length("_f").cast("long").alias("folded_length")
    )


@query(
    "NRM2_match_label",
    f"SELECT doc_id, md5({LABEL_SQL.format('text')}) AS label_hash FROM documents",
)
def match_label(t):
    return t.documents.select("doc_id", F.md5(text.match_label(F.col("text"))).alias("label_hash"))


@query(
    "NRM3_snake_columns",
    "SELECT COUNT(*) AS numero_de_eventos, COUNT(DISTINCT user_id) AS usuarios_distintos FROM events",
)
def snake_columns(t):
    totals = t.events.agg(
        F.count("*").alias("Número de Eventos"), F.countDistinct("user_id").alias(" Usuarios--distintos ")
    )
    return text.snake_columns(totals)


@query(
    "NRM4_blank_to_null",
    "SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN NULL ELSE role END AS role, "
    "CASE WHEN turn % 4 = 1 THEN NULL ELSE md5(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) END AS text_hash "
    "FROM conversations",
)
def blank_to_null(t):
    padded = t.conversations.select(
        "conv_id",
        "turn",
        F.when(F.col("turn") % 3 == 0, F.lit(" ​ ")).otherwise(F.concat(F.lit("  "), "role", F.lit("﻿"))).alias("role"),
        F.when(F.col("turn") % 4 == 1, F.lit("\t ")).otherwise(F.col("text")).alias("text"),
    )
    clean = text.blank_to_null(padded)
    return clean.select("conv_id", "turn", "role", F.md5("text").alias("text_hash"))


TYPE_SQL = (
    "CASE tipo_validacion WHEN 'Primera Entrada' THEN 'primera_entrada' "
    "WHEN 'REGULARIZACI?N EN SALIDA' THEN 'regularizacion_en_salida' "
    "WHEN 'Transbordo_Sencillo' THEN 'transbordo_sencillo' "
    "WHEN 'Primera salida' THEN 'primera_salida' ELSE 'desconocida' END"
)
TITLE_SQL = (
    "CASE tipo_titulo WHEN 'Monedero Consorcio' THEN 'Monedero Consorcio' "
    "WHEN 'T?tulo Promocional' THEN 'Título Promocional' WHEN 'M?SMETRO' THEN 'MásMetro' "
    "WHEN 'Billete-ocasional' THEN 'Billete ocasional' END"
)
define("typed", f"SELECT *, {TYPE_SQL} AS tipo, {TITLE_SQL} AS titulo FROM raw")
define(
    "trips",
    "SELECT * FROM typed WHERE titulo IS NOT NULL AND (tipo LIKE '%entrada%' OR "
    "tipo LIKE '%regularizacion%' OR tipo LIKE '%transbordo%')",
)


@query("NRM5_validation_type", "SELECT tipo, COUNT(*) AS n FROM typed GROUP BY tipo")
def validation_type(t):
    kind = text.canonical_validation_type(F.col("tipo_validacion"))
    return t.raw.groupBy(kind.alias("tipo")).agg(F.count("*").alias("n"))


@query("NRM6_ticket_title", "SELECT titulo, COUNT(*) AS n FROM typed GROUP BY titulo")
def ticket_title(t):
    title = text.canonical_title(F.col("tipo_titulo"))
    return t.raw.groupBy(title.alias("titulo")).agg(F.count("*").alias("n"))


@query(
    "NRM7_service_date",
    "SELECT CAST(ts - INTERVAL 210 MINUTE AS DATE)::VARCHAR AS service_date, COUNT(*) AS n FROM events GROUP BY ALL",
)
def service_date(t):
    day = times.service_date(F.col("ts"), 3, 30)
    return t.events.groupBy(day.alias("service_date")).agg(F.count("*").alias("n"))


@query(
    "NRM8_clean_number",
    "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN l_quantity "
    "WHEN l_linenumber = 2 THEN 0.0 WHEN l_linenumber = 3 THEN -l_quantity ELSE l_extendedprice END AS amount "
    "FROM lineitem",
)
def clean_number(t):
    amount = (
        F.when(F.col("l_linenumber") == 1, F.concat(F.lit("EUR "), F.col("l_quantity").cast("string")))
        .when(F.col("l_linenumber") == 2, F.lit("1.234,56"))
        .when(F.col("l_linenumber") == 3, F.concat(F.lit("-"), F.translate(F.col("l_quantity").cast("string"), ".", ",")))
        .otherwise(F.format_string("%.2f", "l_extendedprice"))
    )
    return t.lineitem.select("l_orderkey", "l_linenumber", times.clean_number(amount).alias("amount"))


@query(
    "NRM9_service_time",
    "SELECT event_id, printf('%02d:%02d:%02d', hour(ts), minute(ts), second(ts)) AS clock, "
    "hour(ts) * 60 + minute(ts) + CASE WHEN hour(ts) < 5 THEN 1440 ELSE 0 END AS axis_minutes, "
    "CASE WHEN hour(ts) < 5 THEN 1 ELSE 0 END AS day_offset FROM events",
)
def service_time(t):
    parsed = t.events.select(
        "event_id", times.parse_service_time(F.date_format("ts", "H:mm:ss")).alias("_p")
    )
    return parsed.select(
        "event_id",
        F.col("_p.time").alias("clock"),
        F.col("_p.axis_minutes").cast("long").alias("axis_minutes"),
        F.col("_p.day_offset").alias("day_offset"),
    )


define(
    "attendance",
    "SELECT event_id, CASE WHEN attendance_raw IS NULL THEN 'missing' "
    "WHEN attendance_raw LIKE 'sin%' THEN 'unparseable_text' ELSE 'parsed' END AS status, "
    "CASE WHEN attendance_raw LIKE '%personas' THEN "
    "CAST(regexp_extract(replace(attendance_raw, '.', ''), '(\\d+)', 1) AS BIGINT) END AS value FROM event_rows",
)


@query("NRM10_attendance", "SELECT event_id, status, value FROM attendance")
def attendance(t):
    parsed = t.event_rows.select("event_id", times.parse_attendance(F.col("attendance_raw")).alias("_a"))
    return parsed.select("event_id", F.col("_a.status").alias("status"), F.col("_a.value").alias("value"))


@query(
    "NRM11_delay",
    "SELECT incident_id, CAST(split_part(delay_text, ':', 1) AS INT) * 60 + "
    "CAST(split_part(delay_text, ':', 2) AS INT) AS delay_seconds FROM incident_rows",
)
def delay(t):
    return t.incident_rows.select(
        "incident_id", times.parse_delay_seconds(F.col("delay_text")).alias("delay_seconds")
    )


INCIDENT_TIMES = (
    "SELECT *, origin_date + CAST(split_part(start_clock, ':', 1) AS INT) * INTERVAL 1 HOUR + "
    "CAST(split_part(start_clock, ':', 2) AS INT) * INTERVAL 1 MINUTE AS s, "
    "origin_date + CAST(split_part(end_clock, ':', 1) AS INT) * INTERVAL 1 HOUR + "
    "CAST(split_part(end_clock, ':', 2) AS INT) * INTERVAL 1 MINUTE AS e0 FROM incident_rows"
)
define("incident_times", INCIDENT_TIMES)
define("incident_spans", "SELECT *, CASE WHEN e0 < s THEN e0 + INTERVAL 1 DAY ELSE e0 END AS e FROM incident_times")


@query(
    "NRM12_NRM13_incident_times",
    "SELECT incident_id, strftime(s, '%Y-%m-%d %H:%M:%S') AS start_ts, strftime(e, '%Y-%m-%d %H:%M:%S') AS end_ts, "
    "e0 < s AS corrected FROM incident_spans",
)
def incident_times(t):
    start = times.combine_date_time(F.col("origin_date"), F.col("start_clock"))
    end = times.combine_date_time(F.col("origin_date"), F.col("end_clock"))
    stamped = t.incident_rows.select("incident_id", start.alias("_s"), end.alias("_e"))
    return stamped.select(
        "incident_id",
        F.col("_s").alias("start_ts"),
        times.rolled_end(F.col("_s"), F.col("_e")).alias("end_ts"),
        times.end_was_rolled(F.col("_s"), F.col("_e")).alias("corrected"),
    )


@query(
    "NRM14_duration_minutes",
    "SELECT event_id, date_diff('minute', start_raw, CASE WHEN end_raw < start_raw "
    "THEN end_raw + INTERVAL 1 DAY ELSE end_raw END)::DOUBLE AS duration_minutes FROM event_rows",
)
def duration(t):
    end = times.rolled_end(F.col("start_raw"), F.col("end_raw"))
    return t.event_rows.select(
        "event_id", times.duration_minutes(F.col("start_raw"), end, 0).alias("duration_minutes")
    )


@query(
    "NRM15_station_alias",
    "SELECT code, kind, COUNT(*) AS n FROM (SELECT CASE l_linenumber % 3 WHEN 0 THEN 'PBL' WHEN 1 THEN NULL "
    "ELSE upper(l_returnflag || 'xx') END AS code, CASE l_linenumber % 3 WHEN 0 THEN 'alias' WHEN 1 THEN 'missing' "
    "ELSE 'exact' END AS kind FROM lineitem) GROUP BY ALL",
)
def station_alias(t):
    code = (
        F.when(F.col("l_linenumber") % 3 == 0, " pbi ")
        .when(F.col("l_linenumber") % 3 == 1, " ")
        .otherwise(F.concat("l_returnflag", F.lit("xx")))
    )
    resolved = t.lineitem.select(text.canonical_station_code(code).alias("_c"))
    return resolved.groupBy(F.col("_c.code").alias("code"), F.col("_c.kind").alias("kind")).agg(
        F.count("*").alias("n")
    )


@query(
    "NRM16_fix_station_codes",
    "SELECT linea, estacion, lower(station_abbrev) AS station_abbrev_master_raw, "
    "CASE WHEN station_abbrev = 'NAA' THEN 'ZZA' ELSE station_abbrev END AS station_abbrev FROM stations",
)
def fix_station_codes(t):
    lowered = t.stations.select("linea", "estacion", F.lower("station_abbrev").alias("station_abbrev"))
    return text.fix_station_codes(lowered, {"naa": "zza"})


@query(
    "NRM17_fallback_station_code",
    "SELECT p_partkey, array_to_string(list_transform(string_split(upper(p_name), ' ')[:4], lambda x: x[1]), '') "
    "AS code FROM part WHERE p_name LIKE '% %' UNION ALL "
    "SELECT p_partkey, upper(p_name)[:4] FROM part WHERE p_name NOT LIKE '% %'",
)
def fallback_station_code(t):
    return t.part.select("p_partkey", text.fallback_station_code(F.col("p_name")).alias("code"))


@query("NRM18_series_label", "SELECT series_id, COUNT(*) AS n FROM demand GROUP BY series_id")
def series_label(t):
    shared = F.col("station_abbrev").isin("NAD", "NCD", "NED")
    label = text.series_label(F.col("linea"), F.col("station_abbrev"), shared)
    return t.demand.groupBy(label.alias("series_id")).agg(F.count("*").alias("n"))


@query(
    "NRM19_service_code",
    "SELECT fecha::VARCHAR AS fecha, CASE WHEN trim(archivo_xml_planificado) <> '' "
    "THEN lower(archivo_xml_planificado[1]) END AS code FROM services",
)
def service_code(t):
    return t.services.select("fecha", text.service_code(F.col("archivo_xml_planificado")).alias("code"))


@query(
    "NRM20_join_lists",
    "SELECT user_id, string_agg(DISTINCT event_type, '|' ORDER BY event_type) AS types FROM events GROUP BY user_id",
)
def join_lists(t):
    return t.events.groupBy("user_id").agg(text.unique_join(F.col("event_type")).alias("types"))


WMO_SQL = "CASE {0} " + " ".join(
    f"WHEN {code} THEN '{name}'" for code, name in domain.WEATHER_SUMMARIES.items()
) + " ELSE 'clear_sky' END"


@query(
    "NRM21_weather_summary",
    f"SELECT {WMO_SQL.format('(event_id % 100)')} AS summary, COUNT(*) AS n FROM events GROUP BY ALL",
)
def weather_summary(t):
    summary = domain.weather_code_summary(F.col("event_id") % 100)
    return t.events.groupBy(summary.alias("summary")).agg(F.count("*").alias("n"))


@query(
    "NRM22_weather_flags",
    "SELECT COUNT(*) FILTER (WHERE v >= 1) AS rainy, COUNT(*) FILTER (WHERE v >= 15) AS heavy, "
    "COUNT(*) FILTER (WHERE v >= 30) AS hot, COUNT(*) FILTER (WHERE v <= 8) AS cold, "
    "COUNT(*) FILTER (WHERE v >= 5) AS bad FROM (SELECT CASE WHEN event_id % 17 <> 0 THEN value END AS v FROM events)",
)
def weather_flags(t):
    value = F.when(F.col("event_id") % 17 != 0, F.col("value"))
    flags = domain.weather_flags(value, value, value)
    names = ["rainy", "heavy", "hot", "cold", "bad"]
    return t.events.agg(*[F.count_if(f).alias(n) for n, f in zip(names, flags.values())])


@query(
    "NRM23_alert_level",
    "SELECT level, COUNT(*) AS n FROM (SELECT CASE WHEN event_id % 9 = 0 THEN 'explicita' "
    "WHEN value >= 60 OR event_id % 100 >= 90 THEN 'roja' WHEN value >= 30 OR event_id % 100 >= 70 THEN 'naranja' "
    "WHEN value >= 15 OR event_id % 100 >= 50 THEN 'amarilla' ELSE 'sin_alerta' END AS level FROM events) GROUP BY ALL",
)
def alert_level(t):
    explicit = F.when(F.col("event_id") % 9 == 0, "explicita").otherwise(" ")
    level = domain.alert_level(F.col("value"), (F.col("event_id") % 100).cast("double"), explicit)
    return t.events.groupBy(level.alias("level")).agg(F.count("*").alias("n"))


@query(
    "NRM24_event_type_impact",
    "SELECT CASE category WHEN 'Deportes' THEN 'deportivo' WHEN 'Feria' THEN 'feria/congreso' ELSE 'cultural' END "
    "AS event_type, CASE WHEN coalesce(a.value, 0) >= 15000 THEN 'muy alto' WHEN coalesce(a.value, 0) >= 5000 THEN 'alto' "
    "WHEN coalesce(a.value, 0) >= 1000 THEN 'medio' ELSE 'bajo' END AS impact, COUNT(*) AS n "
    "FROM event_rows JOIN attendance a USING (event_id) GROUP BY ALL",
)
def event_type_impact(t):
    value = times.parse_attendance(F.col("attendance_raw"))["value"]
    return t.event_rows.groupBy(
        domain.event_type(F.col("category")).alias("event_type"), domain.impact_level(value).alias("impact")
    ).agg(F.count("*").alias("n"))


define("order_days", "SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders")
PARTS_SQL = (
    "year(date) AS year, month(date) AS month, day(date) AS day, quarter(date) AS quarter, "
    "weekofyear(date) AS week_of_year, dayofyear(date) AS day_of_year, isodow(date) AS day_of_week, "
    "dayname(date) AS day_of_week_name, isodow(date) >= 6 AS is_weekend, day(date) = 1 AS is_month_start, "
    "last_day(date) = date AS is_month_end, strftime(date, '%Y-%m') AS year_month, "
    "printf('%d-%02d', year(date), weekofyear(date)) AS year_week"
)


@query("NRM25_calendar_parts", f"SELECT date::VARCHAR AS date, {PARTS_SQL} FROM order_days")
def calendar_parts(t):
    days = t.orders.select(F.to_date("o_orderdate").alias("date")).distinct()
    return days.withColumns(times.calendar_parts(F.col("date")))


@query(
    "NRM26_week_label",
    "SELECT week, COUNT(*) AS n FROM (SELECT printf('%d-W%02d', year(m), "
    "CAST(date_diff('day', date_trunc('week', make_date(year(m), 1, 1)), m) / 7 AS INT) + 1) AS week "
    "FROM (SELECT CAST(date_trunc('week', o_orderdate) AS DATE) AS m FROM orders)) GROUP BY week",
)
def week_label(t):
    label = times.week_label(F.to_date("o_orderdate"))
    return t.orders.groupBy(label.alias("week")).agg(F.count("*").alias("n"))


@query(
    "NRM27_weekday_name",
    "SELECT ['Lunes','Martes','Miercoles','Jueves','Viernes','Sabado','Domingo'][isodow(o_orderdate)] AS weekday, "
    "COUNT(*) AS n FROM orders GROUP BY ALL",
)
def weekday_name(t):
    return t.orders.groupBy(times.weekday_name_es(F.to_date("o_orderdate")).alias("weekday")).agg(
        F.count("*").alias("n")
    )


@query(
    "NRM28_flags",
    "SELECT coalesce(x, 0) <> 0 AS as_bool, coalesce(x, 0) > 0 OR l_linenumber - 4 > 0 AS positive_any, COUNT(*) AS n "
    "FROM (SELECT CASE WHEN l_partkey % 5 <> 0 THEN l_suppkey % 3 - 1 END AS x, l_linenumber FROM lineitem) GROUP BY ALL",
)
def flags(t):
    rows = t.lineitem.select(
        F.when(F.col("l_partkey") % 5 != 0, F.col("l_suppkey") % 3 - 1).alias("x"),
        (F.col("l_linenumber") - 4).alias("y"),
    )
    return rows.groupBy(
        domain.as_bool(F.col("x")).alias("as_bool"),
        domain.positive_any(F.col("x"), F.col("y")).alias("positive_any"),
    ).agg(F.count("*").alias("n"))


@query(
    "NRM29_row_hash",
    "SELECT s_suppkey, sha256('{\"s_name\":\"' || s_name || '\",\"s_nationkey\":' || s_nationkey || "
    "',\"s_suppkey\":' || s_suppkey || '}') AS row_hash FROM supplier",
)
def row_hash(t):
    return t.supplier.select("s_suppkey", domain.row_hash("s_suppkey", "s_name", "s_nationkey").alias("row_hash"))


@query(
    "NRM32_relative_improvement",
    "SELECT o_orderkey, round(CASE WHEN r <> 0 THEN (r - o_totalprice) / r END, 6) AS improvement FROM "
    "(SELECT *, CASE WHEN o_orderkey % 8 = 0 THEN 0.0 WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderkey + 1000.0 END AS r FROM orders)",
)
def relative_improvement(t):
    reference = (
        F.when(F.col("o_orderkey") % 8 == 0, 0.0)
        .when(F.col("o_orderkey") % 9 == 0, None)
        .otherwise(F.col("o_orderkey") + 1000.0)
    )
    value = domain.relative_improvement(reference, F.col("o_totalprice"))
    return t.orders.select("o_orderkey", F.round(value, 6).alias("improvement"))
