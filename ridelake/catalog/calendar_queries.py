"""Weather, calendar and operational tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ridelake.catalog import derived
from ridelake.catalog.registry import define, query
from ridelake.catalog.text_queries import PARTS_SQL, WMO_SQL
from ridelake.operators import calendar, operations, quality

define(
    "weather",
    "SELECT date, temp_min_c, temp_max_c, temp_mean_c, precip_mm, rain_hours, wind_max_kmh, wind_mean_kmh, humidity_mean_pct, "
    "pressure_mean_hpa, coalesce(weather_code, 0) AS weather_code FROM (SELECT CAST(ts AS DATE) AS date, MIN(temp) AS temp_min_c, "
    "MAX(temp) AS temp_max_c, AVG(temp) AS temp_mean_c, SUM(precip) AS precip_mm, COUNT(*) FILTER (WHERE precip > 0) AS rain_hours, "
    "MAX(wind) AS wind_max_kmh, AVG(wind) AS wind_mean_kmh, AVG(humidity) AS humidity_mean_pct, AVG(pressure) AS pressure_mean_hpa "
    "FROM readings GROUP BY ALL) LEFT JOIN weather_codes USING (date)",
)
define(
    "holiday_marks",
    "SELECT coalesce(a.d, b.d) AS holiday_date, a.name, b.d IS NOT NULL AS operational FROM "
    "(SELECT holiday_date AS d, MAX(holiday_name) AS name FROM official GROUP BY ALL) a "
    "FULL JOIN (SELECT DISTINCT holiday_date AS d FROM operational) b ON a.d = b.d",
)
define(
    "external0",
    f"SELECT w.*, {PARTS_SQL}, h.holiday_date IS NOT NULL AS is_holiday, coalesce(h.operational, FALSE) AS is_holiday_mmo, "
    "CASE WHEN h.operational THEN 'metro_malaga_operativo' WHEN h.holiday_date IS NOT NULL THEN 'official_calendar' END AS holiday_scope, "
    "CASE WHEN h.name IS NOT NULL THEN h.name WHEN h.operational THEN 'Festivo MMO' END AS holiday_name, "
    "((SELECT MIN(holiday_date) FROM holiday_marks WHERE holiday_date >= w.date) - w.date)::DOUBLE AS days_to_next_holiday, "
    "(w.date - (SELECT MAX(holiday_date) FROM holiday_marks WHERE holiday_date <= w.date))::DOUBLE AS days_since_prev_holiday, "
    "w.precip_mm >= 1 AS is_rainy_day, w.precip_mm >= 15 AS is_heavy_rain_day, w.temp_max_c >= 30 AS is_hot_day, "
    "w.temp_min_c <= 8 AS is_cold_day, w.precip_mm >= 5 AS is_bad_weather_day FROM weather w LEFT JOIN holiday_marks h ON h.holiday_date = w.date",
)
define(
    "external",
    "SELECT *, coalesce(lead(is_holiday) OVER (ORDER BY date), FALSE) AS is_preholiday, coalesce(lag(is_holiday) OVER (ORDER BY date), FALSE) "
    "AS is_postholiday, NOT is_weekend AND NOT is_holiday AND coalesce(days_to_next_holiday = 1 OR days_since_prev_holiday = 1, FALSE) "
    "AS is_bridge_candidate FROM external0",
)

WEATHER_SQL = (
    "date::VARCHAR AS date, round(temp_min_c, 6) AS temp_min_c, round(temp_max_c, 6) AS temp_max_c, round(temp_mean_c, 6) AS temp_mean_c, "
    "round(precip_mm, 6) AS precip_mm, rain_hours, round(wind_max_kmh, 6) AS wind_max_kmh, round(wind_mean_kmh, 6) AS wind_mean_kmh, "
    "round(humidity_mean_pct, 6) AS humidity_mean_pct, round(pressure_mean_hpa, 6) AS pressure_mean_hpa, weather_code"
)


@query("AG10_weather_daily", f"SELECT {WEATHER_SQL}, {WMO_SQL.format('weather_code')} AS weather_summary FROM weather")
def weather_daily(t):
    rows = calendar.weather_daily(t.readings, t.weather_codes)
    flags = [c for c in rows.columns if c.startswith("is_")]
    return derived.rounded(rows.drop(*flags))


@query(
    "TB7_external_daily",
    "SELECT date::VARCHAR AS date, year, day_of_week, day_of_week_name, is_weekend, year_week, weather_code, is_rainy_day, is_heavy_rain_day, "
    "is_hot_day, is_cold_day, is_bad_weather_day, is_holiday, is_holiday_mmo, holiday_scope, holiday_name, days_to_next_holiday, "
    "days_since_prev_holiday, is_preholiday, is_postholiday, is_bridge_candidate FROM external",
)
def external_daily(t):
    return derived.external(t).select(
        "date", "year", "day_of_week", "day_of_week_name", "is_weekend", "year_week", "weather_code", "is_rainy_day",
        "is_heavy_rain_day", "is_hot_day", "is_cold_day", "is_bad_weather_day", "is_holiday", "is_holiday_mmo",
        "holiday_scope", "holiday_name", "days_to_next_holiday", "days_since_prev_holiday", "is_preholiday",
        "is_postholiday", "is_bridge_candidate",
    )


@query(
    "WIN9_WIN10_neighbour_flags",
    "SELECT date::VARCHAR AS date, is_preholiday, is_postholiday, is_bridge_candidate FROM external WHERE is_preholiday OR is_postholiday OR is_bridge_candidate",
)
def neighbour_flags(t):
    flagged = derived.external(t).filter("is_preholiday OR is_postholiday OR is_bridge_candidate")
    return flagged.select("date", "is_preholiday", "is_postholiday", "is_bridge_candidate")


@query(
    "WIN15_semana_santa",
    "SELECT DISTINCT e::VARCHAR AS easter_date FROM (SELECT CAST(unnest(generate_series(date - INTERVAL 4 DAY, date + INTERVAL 4 DAY, INTERVAL 1 DAY)) AS DATE) AS e "
    "FROM external WHERE lower(holiday_name) LIKE '%jueves santo%' UNION ALL SELECT CAST(unnest(generate_series(date - INTERVAL 5 DAY, "
    "date + INTERVAL 3 DAY, INTERVAL 1 DAY)) AS DATE) FROM external WHERE lower(holiday_name) LIKE '%viernes santo%') WHERE e IN (SELECT date FROM external)",
)
def semana_santa(t):
    rows = derived.external(t)
    flagged = calendar.add_easter_flag(rows, "date", "holiday_name").filter("is_semana_santa")
    return flagged.select(F.col("date").alias("easter_date"))


@query(
    "SET2_refresh_calendar",
    "SELECT date::VARCHAR AS date, CASE WHEN year(date) >= 2000 THEN 'run' ELSE 'old' END AS run_id, "
    "CAST(CASE WHEN year(date) >= 2000 THEN 0 ELSE 3 END AS BIGINT) AS events_total_count, is_preholiday, is_bridge_candidate FROM external "
    "WHERE year(date) >= 2000 OR date <= DATE '1999-12-31'",
)
def refresh_calendar(t):
    days = derived.external(t)
    stored = days.filter("date <= DATE '2000-06-30'").withColumns(
        {"run_id": F.lit("old"), "events_total_count": F.lit(3).cast("long")}
    )
    fresh = days.filter("year(date) >= 2000")
    merged = calendar.refresh_calendar(stored, fresh, F.lit("2000-03-31").cast("date"), F.lit("run"))
    return merged.select("date", "run_id", "events_total_count", "is_preholiday", "is_bridge_candidate")


@query(
    "SET7_hybrid_weather",
    "SELECT date::VARCHAR AS date, CASE WHEN date < (SELECT MAX(date) FROM weather) - 30 THEN 'archive' ELSE 'forecast' END AS weather_origin, "
    "round(CASE WHEN date < (SELECT MAX(date) FROM weather) - 30 THEN temp_max_c ELSE temp_max_c + 1 END, 6) AS temp_max_c FROM weather",
)
def hybrid_weather(t):
    archive = calendar.weather_daily(t.readings).select("date", "temp_max_c")
    forecast = archive.withColumn("temp_max_c", F.col("temp_max_c") + 1)
    today = archive.select(F.max("date")).scalar()
    return derived.rounded(calendar.hybrid_weather(archive, forecast, today))


@query(
    "TB8_demand_history",
    "SELECT day::VARCHAR AS day, n, ['Lunes','Martes','Miercoles','Jueves','Viernes','Sabado','Domingo'][isodow(day)] AS weekday, "
    "CAST(SUM(n) OVER (ORDER BY day) AS BIGINT) AS running_total, CAST(SUM(n) OVER (PARTITION BY year(day) ORDER BY day) AS BIGINT) AS year_to_date "
    "FROM daily_orders WHERE day < DATE '2001-06-01'",
)
def demand_history(t):
    from ridelake.plans.builders import demand_history as build

    daily = t.orders.groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n"))
    closed = daily.withColumn("n", F.when(F.col("day") < "2001-06-01", F.col("n")).otherwise(0))
    return build(closed, "day", "n")


# Services -----------------------------------------------------------------------------------

define(
    "service_days",
    "SELECT fecha, servicio, CASE WHEN trim(archivo_xml_planificado) <> '' THEN archivo_xml_planificado END AS planned, archivo_xml_usado AS used, "
    "inicio_serv_comercial || ':00' AS start_t, CAST(inicio_serv_comercial[1:2] AS INT) * 60 + 30 AS start_m, fin_l1_serv_comercial AS t1, "
    "CASE WHEN fin_l2_serv_comercial <> 'x' THEN fin_l2_serv_comercial || ':00' END AS t2, "
    "CAST(fin_l1_serv_comercial[1:2] AS INT) * 60 + 15 AS r1, CASE WHEN fin_l2_serv_comercial <> 'x' THEN "
    "TRY_CAST(fin_l2_serv_comercial[1:2] AS INT) * 60 + 5 END AS r2 FROM services",
)
define(
    "service_axis",
    "SELECT *, r1 + CASE WHEN r1 < 300 THEN 1440 ELSE 0 END AS m1, r2 + CASE WHEN r2 < 300 THEN 1440 ELSE 0 END AS m2 FROM service_days",
)


@query(
    "TB1_services_daily",
    "SELECT fecha::VARCHAR AS service_date, servicio AS service_name_raw, planned AS planned_service_xml_name, used AS used_service_xml_name, "
    "lower(planned[1]) AS planned_service_code, lower(used[1]) AS used_service_code, coalesce(planned <> used, FALSE) AS used_service_override_flag, "
    "start_t AS commercial_start_time, start_m AS commercial_start_minutes, 0 AS commercial_start_day_offset, t1 AS line_1_end_time, m1 AS line_1_end_minutes, "
    "CASE WHEN r1 < 300 THEN 1 WHEN r1 IS NOT NULL THEN 0 END AS line_1_end_day_offset, t2 AS line_2_end_time, m2 AS line_2_end_minutes, "
    "CASE WHEN r2 < 300 THEN 1 WHEN r2 IS NOT NULL THEN 0 END AS line_2_end_day_offset, "
    "CASE WHEN m1 >= m2 OR m2 IS NULL THEN t1 ELSE t2 END AS commercial_end_time_effective, greatest(m1, m2) AS commercial_end_minutes, "
    "CASE WHEN greatest(m1, m2) >= 1440 THEN 1 WHEN greatest(m1, m2) IS NOT NULL THEN 0 END AS commercial_end_day_offset, "
    "CASE WHEN m1 IS NULL AND m2 IS NULL THEN NULL WHEN m2 IS NULL OR m1 >= m2 THEN 'line_1' ELSE 'line_2' END AS commercial_end_source FROM service_axis",
)
def services_daily(t):
    return operations.services_daily(t.services)


@query(
    "TB2_services_line_daily",
    "SELECT target_date::VARCHAR AS service_date, linea, planned AS planned_service_xml_name, servicio AS service_name_raw, "
    "start_m AS commercial_start_minutes, end_m AS line_end_minutes, end_off AS line_end_day_offset FROM line_services",
)
def services_line_daily(t):
    rows = operations.services_line_daily(operations.services_daily(t.services))
    return rows.drop("used_service_xml_name", "commercial_start_time", "line_end_time")


@query(
    "QC8_inspect_services",
    "SELECT COUNT(*) AS row_count, COUNT(planned) AS rows_with_planned, COUNT(used) AS rows_with_used, "
    "COUNT(*) FILTER (WHERE planned IS NOT NULL AND used IS NOT NULL) AS rows_with_both, COUNT(*) FILTER (WHERE planned <> used) AS rows_with_override, "
    "COUNT(*) FILTER (WHERE r1 < 300) AS line_1_overnight_ends, COUNT(*) FILTER (WHERE r2 < 300) AS line_2_overnight_ends FROM service_days",
)
def inspect_services(t):
    return operations.inspect_services(operations.services_daily(t.services))


# Events -------------------------------------------------------------------------------------

define(
    "events_n",
    "SELECT r.event_id, r.start_raw, CASE WHEN end_raw < start_raw THEN end_raw + INTERVAL 1 DAY ELSE end_raw END AS end_ts, "
    "end_raw < start_raw AS corrected, r.location_raw, trim(lower(regexp_replace(r.location_raw, '[^0-9A-Za-z]+', ' ', 'g'))) AS location_key, "
    "a.value AS attendance, a.status FROM event_rows r JOIN attendance a USING (event_id)",
)
define(
    "events_d",
    "SELECT *, CAST(start_raw AS DATE) AS sd, CAST(end_ts AS DATE) AS ed FROM events_n",
)


@query(
    "TB3_events_normalized",
    "SELECT event_id, strftime(end_ts, '%Y-%m-%d %H:%M:%S') AS end_ts, corrected AS end_ts_correction_applied, location_key, "
    "attendance AS attendance_estimated, status AS attendance_parse_status, ed > sd AS is_multi_day_event, "
    "row_number() OVER (ORDER BY start_raw, event_id) + 1 AS source_row_number FROM events_d",
)
def events_normalized(t):
    rows = operations.source_row_numbers(derived.events(t), ["start_ts", "event_id"])
    return rows.select(
        "event_id", "end_ts", "end_ts_correction_applied", "location_key", "attendance_estimated",
        "attendance_parse_status", "is_multi_day_event", "source_row_number",
    )


define(
    "marked",
    "SELECT location_raw, code, CASE WHEN code = 'PBI' THEN 'PBL' ELSE upper(code) END AS canonical FROM marks WHERE mark <> 0",
)
define(
    "station_groups",
    "SELECT station_abbrev, MIN(station_join_key) AS jk, MIN(station_display_name) AS dn, COUNT(DISTINCT linea) AS lines FROM stations GROUP BY ALL",
)
define(
    "location_lists",
    "SELECT location_raw, COUNT(g.station_abbrev) AS n, string_agg(CASE WHEN canonical = 'TYC' THEN canonical END, '|') AS outside, "
    "string_agg(CASE WHEN canonical <> 'TYC' AND g.station_abbrev IS NULL THEN canonical END, '|' ORDER BY canonical) AS unknown "
    "FROM marked LEFT JOIN station_groups g ON g.station_abbrev = canonical GROUP BY location_raw",
)
define(
    "mapping",
    "SELECT l.location_raw, trim(lower(regexp_replace(l.location_raw, '[^0-9A-Za-z]+', ' ', 'g'))) AS location_key, m.code, g.station_abbrev, g.jk, g.dn, g.lines, "
    "coalesce(k.n, 0) AS n, k.outside, k.unknown FROM (SELECT DISTINCT location_raw FROM marks) l LEFT JOIN location_lists k USING (location_raw) "
    "LEFT JOIN (marked m JOIN station_groups g ON g.station_abbrev = m.canonical) ON m.location_raw = l.location_raw",
)


@query(
    "AG7_location_mapping",
    "SELECT location_raw, location_key, code AS station_code_raw, station_abbrev, jk AS station_join_key, lines AS line_count, "
    "n AS station_mapping_count, outside AS non_station_codes_present, unknown AS unknown_station_codes_present FROM mapping",
)
def location_mapping(t):
    return derived.mapping(t).select(
        "location_raw", "location_key", "station_code_raw", "station_abbrev", "station_join_key", "line_count",
        "station_mapping_count", "non_station_codes_present", "unknown_station_codes_present",
    )


@query(
    "AG6_location_rollup",
    "SELECT location_raw, location_key, string_agg(DISTINCT code, '|' ORDER BY code) AS station_codes_raw, "
    "string_agg(DISTINCT station_abbrev, '|' ORDER BY station_abbrev) AS station_codes_canonical, COUNT(station_abbrev) AS station_mapping_count, "
    "MIN(outside) AS non_station_codes_present, MIN(unknown) AS unknown_station_codes_present FROM mapping GROUP BY ALL",
)
def location_rollup(t):
    return operations.location_rollup(derived.mapping(t))


define("event_hits", "SELECT e.*, m.station_abbrev, m.jk, m.dn, m.n FROM events_d e JOIN mapping m USING (location_key) WHERE m.station_abbrev IS NOT NULL")


@query(
    "JN7_event_station_impact",
    "SELECT event_id, station_abbrev, n AS station_mapping_count, attendance AS attendance_estimated FROM event_hits",
)
def event_station_impact(t):
    impact = operations.event_station_impact(derived.events(t), derived.mapping(t))
    return impact.select("event_id", "station_abbrev", "station_mapping_count", "attendance_estimated")


define(
    "event_days",
    "SELECT *, CAST(unnest(generate_series(sd, ed, INTERVAL 1 DAY)) AS DATE) AS service_date FROM event_hits",
)
define(
    "event_daily",
    "SELECT service_date, station_abbrev, jk AS station_join_key, dn AS station_display_name, COUNT(*) AS active_event_count, "
    "COUNT(*) FILTER (WHERE service_date = sd) AS starting_event_count, COUNT(*) FILTER (WHERE service_date = ed) AS ending_event_count, "
    "CAST(coalesce(SUM(attendance) FILTER (WHERE service_date = sd), 0) AS BIGINT) AS starting_estimated_attendance_sum, "
    "COUNT(*) FILTER (WHERE service_date = sd AND status <> 'parsed') AS starting_unknown_attendance_count, "
    "COUNT(*) FILTER (WHERE service_date = sd AND attendance >= 10000) AS high_impact_starting_event_count FROM event_days GROUP BY ALL",
)


@query("AG5_event_station_daily", "SELECT * REPLACE (service_date::VARCHAR AS service_date) FROM event_daily")
def event_station_daily(t):
    return operations.event_station_daily(derived.events(t), derived.mapping(t))


define(
    "event_series",
    "SELECT d.*, s.linea, s.estacion, g.lines FROM event_daily d LEFT JOIN stations s USING (station_join_key, station_abbrev, station_display_name) "
    "LEFT JOIN (SELECT station_join_key, COUNT(DISTINCT linea) AS lines FROM stations GROUP BY ALL) g USING (station_join_key)",
)


@query(
    "JN8_event_series_daily",
    "SELECT service_date::VARCHAR AS service_date, linea, estacion, lines AS station_group_line_count, lines > 1 AS shared_station_group_propagated, "
    "1.0 / lines AS deduplication_weight, active_event_count / lines AS active_event_count_deduplicated, "
    "starting_estimated_attendance_sum / lines AS starting_estimated_attendance_sum_deduplicated FROM event_series",
)
def event_series_daily(t):
    station_daily = operations.event_station_daily(derived.events(t), derived.mapping(t))
    rows = operations.event_series_daily(station_daily, t.stations)
    return rows.select(
        "service_date", "linea", "estacion", "station_group_line_count", "shared_station_group_propagated",
        "deduplication_weight", "active_event_count_deduplicated", "starting_estimated_attendance_sum_deduplicated",
    )


define("event_counts", "SELECT location_raw, location_key, COUNT(event_id) AS event_count FROM events_n GROUP BY ALL")
define(
    "key_lists",
    "SELECT location_key, string_agg(DISTINCT station_abbrev, '|' ORDER BY station_abbrev) AS codes, COUNT(station_abbrev) AS n, MIN(unknown) AS unknown FROM mapping GROUP BY ALL",
)


@query(
    "JN9_mapping_report",
    "SELECT c.location_raw, c.location_key, c.event_count, k.codes AS station_codes_canonical, k.n AS station_mapping_count, "
    "c.location_raw IN (SELECT location_raw FROM mapping) IS TRUE AS exact_match_found, k.location_key IS NOT NULL AS normalized_match_found, "
    "CASE WHEN k.location_key IS NULL THEN 'location_missing_in_mapping_sheet' WHEN c.location_raw NOT IN (SELECT location_raw FROM mapping) "
    "THEN 'normalized_text_match_only' WHEN k.unknown IS NOT NULL THEN 'unknown_station_codes_present' WHEN k.n > 1 THEN 'multi_station_location' "
    "WHEN k.codes IS NULL THEN 'no_station_mapping_after_code_filter' END AS notes FROM event_counts c LEFT JOIN key_lists k USING (location_key)",
)
def mapping_report(t):
    report = operations.event_mapping_report(derived.events(t), derived.mapping(t))
    return report.select(
        "location_raw", "location_key", "event_count", "station_codes_canonical", "station_mapping_count",
        "exact_match_found", "normalized_match_found", "notes",
    )


@query(
    "QC8_inspect_events",
    "SELECT (SELECT COUNT(*) FROM events_n) AS event_rows, (SELECT COUNT(*) FROM events_n WHERE location_raw IN (SELECT location_raw FROM mapping)) "
    "AS exact_location_hits, (SELECT COUNT(*) FROM events_n WHERE location_key IN (SELECT location_key FROM mapping)) AS normalized_location_hits, "
    "(SELECT COUNT(*) FROM (SELECT location_raw FROM mapping GROUP BY location_raw HAVING MAX(n) > 1)) AS multi_station_locations, "
    "(SELECT COUNT(*) FROM (SELECT location_raw FROM mapping GROUP BY location_raw HAVING MAX(unknown) IS NOT NULL)) AS locations_with_unknown_codes",
)
def inspect_events(t):
    return operations.inspect_events(derived.events(t), derived.mapping(t))


@query(
    "TB4_event_totals",
    "SELECT CAST(SUM(active_event_count) AS BIGINT) AS station_active, (SELECT COUNT(*) FROM event_days) AS day_hits FROM event_daily",
)
def event_totals(t):
    """Weighted measures over lines add up to the days of all events at their stations."""
    events, mapping = derived.events(t), derived.mapping(t)
    station_daily = operations.event_station_daily(events, mapping)
    series = operations.event_series_daily(station_daily, t.stations)
    days = F.date_diff("end_date", "start_date") + 1
    hits = operations.event_station_impact(events, mapping).agg(F.sum(days).cast("long"))
    return series.agg(
        F.round(F.sum("active_event_count_deduplicated")).cast("long").alias("station_active"),
    ).withColumn("day_hits", hits.scalar())


# Incidents ----------------------------------------------------------------------------------

define(
    "incident_keys",
    "SELECT *, trim(lower(regexp_replace(strip_accents(location_raw), '[^0-9A-Za-z]+', ' ', 'g'))) AS k, "
    "nullif(regexp_extract(location_raw, '^([A-Z]{3})\\s*-', 1), '') AS prefix, "
    "trim(lower(regexp_replace(strip_accents(service_affectation), '[^0-9A-Za-z]+', ' ', 'g'))) AS effect, "
    "round(CAST(split_part(delay_text, ':', 1) AS INT) + CAST(split_part(delay_text, ':', 2) AS INT) / 60.0, 2) AS delay_minutes, "
    "date_diff('minute', s, e)::DOUBLE AS duration FROM incident_spans",
)
define(
    "incidents_n",
    "SELECT i.*, g.station_abbrev AS mapped_station_abbrev, g.jk AS mapped_station_join_key, CASE WHEN g.station_abbrev IS NOT NULL THEN 'station' "
    "WHEN k IN ('linea 1', 'linea 2') THEN 'line' WHEN k LIKE '%cruce%' THEN 'crossing' WHEN k LIKE '%cocheras%' OR k LIKE '%talleres%' THEN 'depot' "
    "WHEN k LIKE '%linea 1 y 2%' THEN 'network' WHEN regexp_full_match(trim(location_raw), '\\d+') THEN 'rolling_stock_or_asset' ELSE 'unknown' END AS impact_scope, "
    "CASE WHEN g.station_abbrev IS NOT NULL THEN CASE WHEN g.lines = 1 THEN (SELECT MIN(linea) FROM stations s2 WHERE s2.station_abbrev = g.station_abbrev) END "
    "WHEN k IN ('linea 1', 'linea 2') THEN upper(k) END AS mapped_linea, CASE WHEN g.lines > 1 THEN 'station_shared_between_lines' END AS mapping_notes, "
    "g.lines FROM incident_keys i LEFT JOIN station_groups g ON g.station_abbrev = CASE WHEN prefix = 'PBI' THEN 'PBL' ELSE prefix END",
)


def _incidents(t):
    return operations.incidents_normalized(t.incident_rows, t.stations)


@query(
    "JN10_incident_scope",
    "SELECT incident_id, impact_scope, mapped_linea, mapped_station_abbrev, mapping_notes, CASE WHEN impact_scope = 'station' THEN "
    "'station_prefix_exact_' || CASE WHEN lines = 1 THEN 'unique_line' ELSE 'shared_station' END WHEN impact_scope = 'line' THEN 'line_exact' "
    "ELSE impact_scope || '_scope' END AS mapping_confidence FROM incidents_n",
)
def incident_scope(t):
    return _incidents(t).select(
        "incident_id", "impact_scope", "mapped_linea", "mapped_station_abbrev", "mapping_notes", "mapping_confidence"
    )


@query(
    "TB5_incidents_normalized",
    "SELECT incident_id, strftime(s, '%Y-%m-%d %H:%M:%S') AS incident_start_ts, strftime(e, '%Y-%m-%d %H:%M:%S') AS incident_end_ts, "
    "e0 < s AS end_ts_correction_applied, duration AS incident_duration_minutes, impact_scope FROM incidents_n",
)
def incidents_normalized(t):
    return _incidents(t).select(
        "incident_id", "incident_start_ts", "incident_end_ts", "end_ts_correction_applied", "incident_duration_minutes", "impact_scope"
    )


@query(
    "AG8_incidents_daily",
    "SELECT origin_date::VARCHAR AS service_date, impact_scope, mapped_linea, mapped_station_abbrev, COUNT(incident_id) AS incident_count, "
    "round(coalesce(SUM(delay_minutes), 0), 4) AS delay_minutes_sum, round(MAX(delay_minutes), 4) AS delay_minutes_max, "
    "round(coalesce(SUM(duration), 0), 4) AS incident_duration_minutes_sum, MAX(duration) AS incident_duration_minutes_max, "
    "COUNT(*) FILTER (WHERE effect = 'retrasos') AS delay_incident_count, COUNT(*) FILTER (WHERE effect = 'servicio parcial') AS partial_service_incident_count, "
    "COUNT(*) FILTER (WHERE effect = 'paro de la linea') AS line_stop_incident_count, COUNT(*) FILTER (WHERE effect = 'via unica temporal') "
    "AS single_track_incident_count FROM incidents_n GROUP BY origin_date, impact_scope, mapped_linea, mapped_station_abbrev",
)
def incidents_daily(t):
    daily = operations.incidents_daily(_incidents(t))
    return derived.rounded(daily.drop("mapped_station_join_key", "mapped_station_display_name"), 4)


@query(
    "AG9_incident_mapping_report",
    "SELECT location_raw, impact_scope, prefix AS station_prefix_raw, mapped_station_abbrev, mapped_linea, mapping_notes, COUNT(*) AS incident_count, "
    "round(coalesce(SUM(delay_minutes), 0), 4) AS delay_minutes_sum, MAX(origin_date)::VARCHAR AS latest_service_date FROM incidents_n GROUP BY ALL",
)
def incident_mapping_report(t):
    report = operations.incident_mapping_report(_incidents(t))
    return derived.rounded(report.drop("mapping_confidence"), 4)


@query(
    "QC8_inspect_incidents",
    "SELECT impact_scope, COUNT(*) AS row_count, COUNT(mapped_station_abbrev) AS mapped_station_rows, COUNT(mapped_linea) AS mapped_line_rows, "
    "COUNT(delay_minutes) AS rows_with_delay, COUNT(*) FILTER (WHERE e0 < s) AS corrected_end_rows FROM incidents_n GROUP BY ALL",
)
def inspect_incidents(t):
    return operations.inspect_incidents(_incidents(t))


@query(
    "TB6_operational_summary",
    "SELECT 'services_history_daily' AS source_name, COUNT(*) AS row_count, CAST(0 AS BIGINT) AS duplicate_count FROM service_days UNION ALL "
    "SELECT 'services_line_daily', COUNT(*), 0 FROM line_services UNION ALL SELECT 'events_normalized', COUNT(*), 0 FROM events_n UNION ALL "
    "SELECT 'events_station_daily', COUNT(*), 0 FROM event_daily UNION ALL "
    "SELECT 'incidents_normalized', COUNT(*), COUNT(*) - COUNT(DISTINCT incident_id) FROM incidents_n",
)
def operational_summary(t):
    from ridelake.plans.builders import build_operational_datasets

    built = build_operational_datasets(t.services, t.event_rows, t.location_matrix, t.incident_rows, t.stations)
    keys = {
        "services_history_daily": ["service_date"],
        "services_line_daily": ["service_date", "linea"],
        "events_normalized": ["event_id"],
        "events_station_daily": ["service_date", "station_abbrev"],
        "incidents_normalized": ["incident_id"],
    }
    day = {"events_normalized": "start_date"}
    sources = {name: (built[name], key, day.get(name, "service_date"), {}) for name, key in keys.items()}
    return quality.inspection_summary(sources).select("source_name", "row_count", "duplicate_count")
