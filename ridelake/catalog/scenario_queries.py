"""Scenarios: roll-ups, comparison, matching, checks and comments."""

from __future__ import annotations

from pyspark.sql import functions as F

from ridelake.catalog import derived
from ridelake.catalog.registry import define, query
from ridelake.functions import domain
from ridelake.operators import calendar, features, panel, scenario
from ridelake.operators.scale import materialized
from ridelake.plans import builders

# Prediction rows of one execution per horizon; every tenth day lacks its actual.
define(
    "rows_of",
    "SELECT 'H' || horizon_days AS execution_id, target_date, forecast_origin_date, linea, estacion, series_id, baseline_naive_seasonal_weekly AS base, "
    "baseline_naive_simple AS cand, CASE WHEN day(target_date) % 10 <> 0 THEN trip_count_target END AS y_real FROM scored WHERE split_type = 'test'",
)


def _rows(t, prediction):
    rows = derived.scored(t).filter("split_type = 'test'")
    return rows.select(
        F.concat(F.lit("H"), F.col("horizon_days").cast("string")).alias("execution_id"),
        "target_date",
        "forecast_origin_date",
        "linea",
        "estacion",
        "series_id",
        F.col(prediction).alias("y_pred"),
        F.when(F.day("target_date") % 10 != 0, F.col("trip_count_target")).alias("y_real"),
    )


def rollup_sql(column: str, where: str = "") -> str:
    return (
        "SELECT CASE GROUPING(target_date, linea, estacion) WHEN 7 THEN 'network' WHEN 5 THEN 'line' WHEN 3 THEN 'network_date' WHEN 1 THEN 'line_date' ELSE 'station' END AS level, "
        f"execution_id, target_date, linea, estacion, round(SUM({column}), 6) AS y_pred, round(SUM(y_real), 6) AS y_real FROM rows_of {where} GROUP BY GROUPING SETS "
        "((execution_id), (execution_id, linea), (execution_id, target_date), (execution_id, target_date, linea), (execution_id, estacion))"
    )


define("base_rollup", rollup_sql("base"))
define("cand_rollup", rollup_sql("cand"))


@query(
    "AG20_scenario_rollup",
    "SELECT level, execution_id, target_date::VARCHAR AS target_date, linea, estacion, y_pred, y_real, round(abs(y_pred - y_real), 6) AS abs_error, "
    "round(abs(y_pred - y_real) / nullif(y_real, 0), 9) AS pct_error, y_real IS NOT NULL AS real_available FROM base_rollup",
)
def scenario_rollup(t):
    rows = scenario.scenario_rollup(_rows(t, "baseline_naive_seasonal_weekly"))
    return rows.withColumn("pct_error", F.round("pct_error", 9))


# Every execution against itself under the other prediction, and the two against each other.
define(
    "scenario_pairs",
    "SELECT * FROM (VALUES ('H1', 'H1'), ('H7', 'H7'), ('H1', 'H7')) p(base_id, candidate_id)",
)


@query(
    "JN17_compare_scenarios",
    "SELECT p.base_id, p.candidate_id, a.level, a.target_date::VARCHAR AS target_date, a.linea, a.estacion, a.y_pred AS base_y_pred, b.y_pred AS candidate_y_pred, round(b.y_pred - a.y_pred, 6) AS delta_abs, "
    "round(round(b.y_pred - a.y_pred, 6) / nullif(a.y_pred, 0), 9) AS delta_pct FROM scenario_pairs p JOIN base_rollup a ON a.execution_id = p.base_id JOIN cand_rollup b ON b.execution_id = p.candidate_id "
    "AND a.level = b.level AND a.target_date IS NOT DISTINCT FROM b.target_date AND a.linea IS NOT DISTINCT FROM b.linea AND a.estacion IS NOT DISTINCT FROM b.estacion",
)
def compare_scenarios(t):
    base = scenario.scenario_rollup(_rows(t, "baseline_naive_seasonal_weekly"))
    candidate = scenario.scenario_rollup(_rows(t, "baseline_naive_simple"))
    pairs = t.spark.createDataFrame(
        [("H1", "H1"), ("H7", "H7"), ("H1", "H7")], "base_id string, candidate_id string"
    )
    rows = scenario.compare_scenarios(base, candidate, pairs)
    return rows.withColumn("delta_pct", F.round("delta_pct", 9))


@query(
    "JN18_enrich_actuals",
    "SELECT a.execution_id, a.level, a.target_date::VARCHAR AS target_date, a.linea, a.estacion, a.y_pred, CASE WHEN a.level = 'network_date' THEN coalesce(n, a.y_real) WHEN a.level = 'network' THEN coalesce(s.total, a.y_real) "
    "ELSE a.y_real END AS y_real FROM base_rollup a LEFT JOIN daily_orders ON day = a.target_date LEFT JOIN (SELECT execution_id, SUM(coalesce(n, y_real)) AS total FROM base_rollup LEFT JOIN daily_orders ON day = target_date "
    "WHERE level = 'network_date' GROUP BY execution_id) s ON s.execution_id = a.execution_id",
)
def enrich_actuals(t):
    base = scenario.scenario_rollup(_rows(t, "baseline_naive_seasonal_weekly"))
    daily = t.orders.groupBy(F.to_date("o_orderdate").alias("target_date")).agg(
        F.count("*").cast("double").alias("actual")
    )
    return scenario.enrich_actuals(base, daily).select(
        "execution_id", "level", "target_date", "linea", "estacion", "y_pred", "y_real"
    )


@query(
    "AG21_time_buckets",
    "SELECT execution_id, printf('%d-W%02d', year(m), CAST(date_diff('day', date_trunc('week', make_date(year(m), 1, 1)), m) / 7 AS INT) + 1) AS bucket, SUM(base) AS y_pred, SUM(y_real) AS y_real "
    "FROM (SELECT *, CAST(date_trunc('week', target_date) AS DATE) AS m FROM rows_of) GROUP BY ALL",
)
def time_buckets(t):
    return scenario.time_buckets(_rows(t, "baseline_naive_seasonal_weekly"), "week", by=["execution_id"])


@query(
    "AG22_station_ranking",
    "SELECT execution_id, estacion, SUM(base) AS y_pred, SUM(y_real) AS y_real FROM rows_of GROUP BY ALL",
)
def station_ranking(t):
    return scenario.station_ranking(_rows(t, "baseline_naive_seasonal_weekly"), by=["execution_id"])


@query(
    "AG31_collapse_event_dates",
    "SELECT user_id AS event_id, array_to_string(list_sort(list(DISTINCT CAST(ts AS DATE)::VARCHAR)), ',') AS dates, arg_min(event_type, (CAST(ts AS DATE), event_id)) AS first_type FROM events GROUP BY ALL",
)
def collapse_event_dates(t):
    first = t.events.groupBy(F.col("user_id").alias("event_id"), F.to_date("ts").alias("target_date")).agg(
        F.min_by("event_type", "event_id").alias("first_type")
    )
    rows = scenario.collapse_event_dates(first)
    return rows.select(
        "event_id", F.array_join(F.col("selected_dates").cast("array<string>"), ",").alias("dates"), "first_type"
    )


@query(
    "FLT2_filter_scope",
    "SELECT execution_id, COUNT(*) AS n, SUM(base) AS y_pred FROM rows_of WHERE target_date BETWEEN DATE '2001-03-01' AND DATE '2001-06-30' AND linea = 'LINEA 1' GROUP BY ALL",
)
def filter_scope(t):
    rows = _rows(t, "baseline_naive_seasonal_weekly").withColumn("model_variant", F.col("linea"))
    kept = scenario.filter_scope(rows, "2001-03-01", "2001-06-30", variant="LINEA 1")
    return kept.groupBy("execution_id").agg(F.count("*").alias("n"), F.sum("y_pred").alias("y_pred"))


define("scenario_sources", "SELECT service_date AS target_date, series_id, trip_count, day(service_date) AS d FROM demand")
define(
    "best_source",
    "SELECT target_date, series_id, CASE WHEN d % 3 = 0 THEN 'model_inference' WHEN d % 2 = 0 THEN 'historical' ELSE 'precomputed_future_forecast' END AS recomputed, "
    "CASE WHEN d % 2 = 0 THEN 'historical' WHEN d % 3 = 0 THEN 'model_inference' ELSE 'precomputed_future_forecast' END AS plain, trip_count FROM scenario_sources",
)


def _sources(t):
    rows = t.demand.select(
        F.col("service_date").alias("target_date"), "series_id", F.col("trip_count").cast("double").alias("y_pred")
    )
    day = F.day("target_date")
    return {
        "historical": rows.filter(day % 2 == 0),
        "model_inference": rows.filter(day % 3 == 0).withColumn("y_pred", F.col("y_pred") + 1),
        "precomputed_future_forecast": rows.withColumn("y_pred", F.col("y_pred") + 2),
    }


@query(
    "SET4_priority_union",
    "SELECT TRUE AS recompute, recomputed AS prediction_source, COUNT(*) AS n, CAST(SUM(trip_count + CASE recomputed WHEN 'model_inference' THEN 1 WHEN 'historical' THEN 0 ELSE 2 END) AS DOUBLE) AS y_pred "
    "FROM best_source GROUP BY ALL UNION ALL SELECT FALSE, plain, COUNT(*), CAST(SUM(trip_count + CASE plain WHEN 'model_inference' THEN 1 WHEN 'historical' THEN 0 ELSE 2 END) AS DOUBLE) FROM best_source GROUP BY ALL",
)
def priority_union(t):
    parts = []
    for flag in (True, False):
        rows = scenario.priority_union(_sources(t), recompute=flag)
        parts.append(
            rows.groupBy("prediction_source")
            .agg(F.count("*").alias("n"), F.sum("y_pred").alias("y_pred"))
            .withColumn("recompute", F.lit(flag))
        )
    return derived.union_all(parts)


# Event matching -----------------------------------------------------------------------------

define(
    "scenario_events",
    "SELECT event_id, CAST(start_raw AS DATE) AS start_date, CAST(start_raw AS DATE) + CAST(event_id % 3 AS INT) AS end_date, CASE WHEN event_id % 2 = 0 THEN 'alto' ELSE 'bajo' END AS impact, "
    "event_id % 29 = 0 AS deleted, CASE WHEN event_id % 40 = 0 THEN 'all' ELSE 'NATION_' || (event_id % 25) END AS station FROM event_rows",
)


@query(
    "JN19_scenario_event_match",
    "SELECT d.series_id, d.service_date::VARCHAR AS target_date, COUNT(e.event_id)::DOUBLE AS event_active_count, COUNT(e.event_id) FILTER (WHERE e.impact = 'alto')::DOUBLE AS event_high_impact_starting_count "
    "FROM demand d LEFT JOIN scenario_events e ON d.service_date BETWEEN e.start_date AND e.end_date AND NOT e.deleted AND (e.station = 'all' OR e.station = d.estacion) GROUP BY ALL",
)
def scenario_event_match(t):
    station = F.when(F.col("event_id") % 40 == 0, "all").otherwise(
        F.concat(F.lit("NATION_"), (F.col("event_id") % 25).cast("string"))
    )
    start = F.to_date("start_raw")
    events = t.event_rows.select(
        "event_id",
        start.alias("start_date"),
        F.date_add(start, (F.col("event_id") % 3).cast("int")).alias("end_date"),
        F.array().cast("array<date>").alias("selected_dates"),
        F.when(F.col("event_id") % 2 == 0, "alto").otherwise("bajo").alias("impact_level"),
        (F.col("event_id") % 29 == 0).alias("deleted"),
        F.array(station).alias("affected_stations"),
    )
    series = t.demand.select(F.col("service_date").alias("target_date"), "series_id", "station_abbrev", "estacion")
    matched = scenario.event_match(series, events)
    return matched.select("series_id", "target_date", "event_active_count", "event_high_impact_starting_count")


@query(
    "JN20_override_join",
    "SELECT d.series_id, d.service_date::VARCHAR AS target_date, CASE WHEN h.holiday_date IS NOT NULL THEN TRUE ELSE isodow(d.service_date) = 7 END AS is_holiday, "
    "CASE WHEN h.holiday_date IS NOT NULL THEN 'override' ELSE 'automatic' END AS value_origin FROM demand d LEFT JOIN (SELECT DISTINCT holiday_date FROM official) h ON h.holiday_date = d.service_date",
)
def override_join(t):
    rows = t.demand.select(
        "series_id", F.col("service_date").alias("target_date"), (F.weekday("service_date") == 6).alias("is_holiday")
    )
    overrides = t.official_holidays.select(
        F.col("holiday_date").alias("target_date"), F.lit(True).alias("is_holiday")
    ).distinct()
    return scenario.override_join(rows, overrides, ["is_holiday"])


@query(
    "JN21_catalog_enrich",
    "SELECT d.series_id, d.service_date::VARCHAR AS target_date, coalesce(CASE WHEN d.trip_count % 2 = 0 THEN d.linea END, s.linea) AS linea, s.estacion, s.network_order FROM demand d "
    "LEFT JOIN stations s ON s.linea = d.linea AND s.estacion = d.estacion WHERE d.trip_count <> 3",
)
def catalog_enrich(t):
    from ridelake.operators.demand import add_series_id

    catalog = add_series_id(t.stations, t.stations)
    rows = t.demand.select(
        "series_id",
        F.col("service_date").alias("target_date"),
        F.when(F.col("trip_count") % 2 == 0, F.col("linea")).alias("linea"),
        F.when(F.col("trip_count") != 3, F.col("trip_count")).alias("y_pred"),
    )
    return scenario.catalog_enrich(rows, catalog).select("series_id", "target_date", "linea", "estacion", "network_order")


# Checks -------------------------------------------------------------------------------------


@query(
    "PRJ7_PRJ8_scenario_status",
    "SELECT *, CASE WHEN status IN ('what_if', 'derivada') OR has_events OR has_weather THEN 'forecastable_scenario' ELSE 'strict_available' END AS variant FROM "
    "(SELECT execution_id, has_events, has_weather, CASE WHEN origin_type = 'excel_import' AND NOT import_modified THEN 'importada' WHEN origin_type IN ('excel_import', 'derived') THEN 'derivada' "
    "WHEN manual_changes OR accepted_items THEN 'what_if' ELSE 'base' END AS status FROM scenarios)",
)
def scenario_status(t):
    return scenario.scenario_columns(t.scenarios).select("execution_id", "has_events", "has_weather", "status", "variant")


define("scenario_days", "SELECT execution_id, range_start, range_end, CAST(unnest(generate_series(range_start, range_end, INTERVAL 1 DAY)) AS DATE) AS d FROM scenarios")
define(
    "coverages",
    "SELECT execution_id, range_start, range_end, COUNT(*) AS total_days, COUNT(*) FILTER (WHERE d IN (SELECT date FROM order_days)) AS calendar_days, "
    "COUNT(*) FILTER (WHERE d IN (SELECT sd FROM events_d WHERE event_id % 6 = 0)) AS event_days, COUNT(*) FILTER (WHERE d IN (SELECT date FROM weather WHERE rain_hours > 0)) AS weather_days "
    "FROM scenario_days GROUP BY ALL",
)


def _coverage(t):
    days = t.orders.select(F.to_date("o_orderdate").alias("target_date"))
    events = t.event_rows.filter("event_id % 6 = 0").select(F.to_date("start_raw").alias("target_date"))
    weather = calendar.weather_daily(t.readings).filter("rain_hours > 0").select(F.col("date").alias("target_date"))
    return scenario.snapshot_coverage(t.scenarios, days, events, weather)


@query(
    "AG29_snapshot_coverage",
    "SELECT execution_id, range_start::VARCHAR AS range_start, range_end::VARCHAR AS range_end, total_days, calendar_days, event_days, weather_days FROM coverages",
)
def snapshot_coverage(t):
    return _coverage(t)


@query(
    "QC14_range_warnings",
    "SELECT execution_id, 'long_range' AS warning_code FROM coverages WHERE range_end - range_start + 1 > 31 UNION ALL SELECT execution_id, 'missing_events' FROM coverages WHERE event_days < total_days "
    "UNION ALL SELECT execution_id, 'missing_future_weather' FROM coverages WHERE weather_days < total_days UNION ALL SELECT execution_id, 'calendar_only' FROM coverages WHERE calendar_days = total_days "
    "AND event_days = 0 AND weather_days = 0 UNION ALL SELECT execution_id, 'model_horizon_exceeded' FROM coverages WHERE range_end - range_start + 1 > 14",
)
def range_warnings(t):
    return scenario.range_warnings(_coverage(t))


define(
    "scenario_rows",
    "SELECT s.execution_id, s.range_start, s.range_end, d.service_date AS target_date, d.series_id, CASE WHEN d.trip_count <> 2 THEN d.trip_count END AS y_real FROM scenarios s JOIN demand d "
    "ON d.service_date BETWEEN s.range_start AND s.range_end",
)


def _scenario_rows(t):
    days = t.scenarios.select("execution_id", F.explode(F.sequence("range_start", "range_end")).alias("target_date"))
    rows = t.demand.select(
        F.col("service_date").alias("target_date"),
        "series_id",
        F.when(F.col("trip_count") != 2, F.col("trip_count")).alias("y_real"),
        F.date_sub("service_date", 1).alias("forecast_origin_date"),
    )
    return days.join(rows, "target_date")


@query(
    "QC12_prediction_completeness",
    "SELECT s.execution_id, COUNT(r.d) = 0 AS model_predictions_unavailable, COUNT(r.d) > 0 AND COUNT(r.d) <> ANY_VALUE(s.range_end - s.range_start + 1) AS model_prediction_partial, "
    "coalesce(MIN(r.n) < (SELECT COUNT(DISTINCT series_id) FROM demand), FALSE) AS model_series_partial FROM scenarios s LEFT JOIN (SELECT execution_id, target_date AS d, COUNT(DISTINCT series_id) AS n "
    "FROM scenario_rows GROUP BY ALL) r USING (execution_id) GROUP BY s.execution_id",
)
def prediction_completeness(t):
    return scenario.prediction_completeness(_scenario_rows(t), t.scenarios, t.demand.select("series_id").distinct())


@query(
    "QC13_historical_complete",
    "SELECT s.execution_id, COUNT(DISTINCT r.target_date) FILTER (WHERE r.y_real IS NOT NULL) = ANY_VALUE(s.range_end - s.range_start + 1) AS actuals_complete FROM scenarios s LEFT JOIN scenario_rows r USING (execution_id) GROUP BY s.execution_id",
)
def historical_complete(t):
    return scenario.historical_complete(_scenario_rows(t), t.scenarios)


@query(
    "ML7_recursive_horizon",
    "SELECT s.execution_id, range_end - range_start + 1 > 14 AND s.execution_id IN (SELECT execution_id FROM scenario_rows) AS recursive_horizon FROM scenarios s",
)
def recursive_horizon(t):
    return scenario.recursive_horizon_flag(_scenario_rows(t), t.scenarios)


@query(
    "TB12_snapshot_weather",
    "SELECT date::VARCHAR AS date, CASE WHEN precip_mm >= 60 OR wind_max_kmh >= 90 THEN 'roja' WHEN precip_mm >= 30 OR wind_max_kmh >= 70 THEN 'naranja' WHEN precip_mm >= 15 OR wind_max_kmh >= 50 THEN 'amarilla' "
    "ELSE 'sin_alerta' END AS alert_level, CASE WHEN precip_mm < 15 AND wind_max_kmh < 50 THEN 'Sin alerta meteorologica relevante.' ELSE 'Alerta ' || CASE WHEN precip_mm >= 60 OR wind_max_kmh >= 90 THEN 'roja' "
    "WHEN precip_mm >= 30 OR wind_max_kmh >= 70 THEN 'naranja' ELSE 'amarilla' END || ': precipitacion ' || CAST(CAST(round(precip_mm) AS INT) AS VARCHAR) || ' mm, viento ' || CAST(CAST(wind_max_kmh AS INT) AS VARCHAR) || ' km/h.' END AS alert_summary FROM weather",
)
def snapshot_weather(t):
    days = calendar.weather_daily(t.readings).withColumn("precip_mm", F.round("precip_mm"))
    return scenario.external_snapshot_weather(days).select("date", "alert_level", "alert_summary")


@query(
    "TB12_snapshot_events",
    "SELECT s.execution_id, e.event_id, greatest(sd, s.range_start)::VARCHAR AS target_date, CASE o_orderstatus WHEN 'F' THEN 'deportivo' WHEN 'O' THEN 'feria/congreso' ELSE 'cultural' END AS event_type, "
    "CASE WHEN coalesce(attendance, 0) >= 15000 THEN 'muy alto' WHEN coalesce(attendance, 0) >= 5000 THEN 'alto' WHEN coalesce(attendance, 0) >= 1000 THEN 'medio' ELSE 'bajo' END AS impact_level "
    "FROM scenarios s JOIN events_d e ON sd <= s.range_end AND ed >= s.range_start JOIN orders ON o_orderkey = e.event_id",
)
def snapshot_events(t):
    return scenario.external_snapshot_events(derived.events(t), t.scenarios)


@query(
    "TB12_external_snapshot",
    "SELECT execution_id, total_days, calendar_days, event_days, weather_days, calendar_days AS calendar_rows, (SELECT COUNT(*) FROM scenarios s JOIN events_d e ON sd <= s.range_end AND ed >= s.range_start JOIN orders ON o_orderkey = e.event_id "
    "WHERE s.execution_id = c.execution_id) AS events, (total_days > 31)::INT + (event_days < total_days)::INT + (weather_days < total_days)::INT + (calendar_days = total_days AND event_days = 0 AND weather_days = 0)::INT + (total_days > 14)::INT AS warnings "
    "FROM (SELECT execution_id, COUNT(*) AS total_days, COUNT(*) FILTER (WHERE d IN (SELECT CAST(o_orderdate AS DATE) FROM orders)) AS calendar_days, "
    "COUNT(*) FILTER (WHERE d IN (SELECT unnest(generate_series(sd, ed, INTERVAL 1 DAY))::DATE FROM events_d WHERE sd <= ed)) AS event_days, COUNT(*) FILTER (WHERE d IN (SELECT date FROM weather)) AS weather_days FROM scenario_days GROUP BY execution_id) c",
)
def external_snapshot(t):
    """Everything the snapshot knows of an execution, one row each."""
    days = t.orders.select(F.to_date("o_orderdate").alias("date")).distinct()
    built = builders.external_snapshot(days, derived.events(t), calendar.weather_daily(t.readings), t.scenarios)
    counted = {
        name: built[part].groupBy("execution_id").agg(F.count("*").alias(name))
        for name, part in (("calendar_rows", "calendar"), ("events", "events"), ("warnings", "warnings"))
    }
    rows = built["coverage"].select("execution_id", "total_days", "calendar_days", "event_days", "weather_days")
    for name, counts in counted.items():
        rows = rows.join(counts, "execution_id", "left").fillna(0, subset=[name])
    return rows


define(
    "scenario_best",
    "SELECT s.execution_id, b.target_date, st.linea, st.estacion, (trip_count + CASE CASE WHEN s.rec THEN recomputed ELSE plain END WHEN 'model_inference' THEN 1 WHEN 'historical' THEN 0 ELSE 2 END)::DOUBLE AS y_pred, "
    "NULL::DOUBLE AS y_real FROM (SELECT execution_id, range_start, range_end, CASE WHEN origin_type = 'excel_import' THEN import_modified WHEN origin_type = 'derived' THEN TRUE ELSE manual_changes OR accepted_items END AS rec FROM scenarios) s "
    "JOIN best_source b ON b.target_date BETWEEN s.range_start AND s.range_end JOIN (SELECT DISTINCT series_id, linea, estacion FROM demand) k USING (series_id) LEFT JOIN stations st ON st.linea = k.linea AND st.estacion = k.estacion",
)
define("scenario_best_rollup", rollup_sql("y_pred").replace("rows_of", "scenario_best"))
define("day_demand", "SELECT service_date, SUM(trip_count)::DOUBLE AS actual FROM demand GROUP BY service_date")


@query(
    "TB15_run_scenario",
    "SELECT execution_id, level, target_date::VARCHAR AS target_date, linea, estacion, y_pred, y_real, round(abs(y_pred - y_real), 6) AS abs_error FROM (SELECT r.execution_id, level, target_date, linea, estacion, y_pred, "
    "CASE level WHEN 'network_date' THEN actual WHEN 'network' THEN total END AS y_real FROM scenario_best_rollup r LEFT JOIN day_demand ON service_date = target_date LEFT JOIN "
    "(SELECT execution_id, SUM(actual) AS total FROM scenario_best_rollup LEFT JOIN day_demand ON service_date = target_date WHERE level = 'network_date' GROUP BY execution_id) h ON h.execution_id = r.execution_id)",
)
def run_scenario(t):
    """All five levels of every execution, with the history's actuals and the errors."""
    from ridelake.operators.demand import add_series_id

    catalog = add_series_id(t.stations, t.stations)
    sources = {
        name: rows.withColumn("y_real", F.lit(None).cast("double")) for name, rows in _sources(t).items()
    }
    history = t.demand.groupBy(F.col("service_date").alias("target_date")).agg(
        F.sum("trip_count").cast("double").alias("actual")
    )
    built = builders.run_scenarios(t.scenarios, sources, history, catalog)
    return built["aggregates"].select(
        "execution_id", "level", "target_date", "linea", "estacion", "y_pred", "y_real", "abs_error"
    )


@query(
    "ML6_scenario_features",
    "SELECT s.execution_id, b.series_id, s.d::VARCHAR AS target_date, h.y AS target_latest_observed_value, s.d - 1 - h.observed_date AS target_days_since_latest_observation, round(h.m7, 6) AS target_rolling_mean_7, "
    "a.y AS target_lag_7, isodow(s.d) AS calendar_day_of_week FROM (SELECT *, s0.d - 1 AS o FROM scenario_days s0) s CROSS JOIN bounds b ASOF LEFT JOIN serving h ON h.series_id = b.series_id AND s.o >= h.observed_date "
    "LEFT JOIN serving a ON a.series_id = b.series_id AND a.observed_date = s.d - 8 WHERE (s.d, b.series_id) NOT IN (SELECT service_date, series_id FROM demand)",
)
def scenario_features(t):
    """Feature rows of all scenario days and series without a stored prediction."""
    history = t.demand.select(
        "series_id",
        F.col("service_date").alias("observed_date"),
        F.col("trip_count").cast("double").alias("observed_target_value"),
    )
    latest = panel.latest_per_series(
        t.demand.select("series_id", F.col("service_date").alias("target_date"), "linea", "estacion", "station_abbrev")
    ).drop("target_date")
    covered = t.demand.select(F.col("service_date").alias("target_date"), "series_id")
    rows = builders.scenario_feature_rows(t.scenarios, latest, history, 1, covered=covered)
    return derived.rounded(
        rows.select(
            "execution_id", "series_id", "target_date", "target_latest_observed_value", "target_days_since_latest_observation",
            "target_rolling_mean_7", "target_lag_7", "calendar_day_of_week",
        )
    )


# Comments -----------------------------------------------------------------------------------

define(
    "comment_dates",
    "SELECT *, CASE WHEN contains(lc, 'pasado mañana') OR contains(lc, 'pasado manana') THEN reference_date + 2 WHEN contains(lc, 'mañana') OR contains(lc, 'manana') THEN reference_date + 1 "
    "WHEN contains(lc, 'hoy') THEN reference_date ELSE CAST(try_strptime(regexp_extract(lc, '\\b(\\d{1,2}/\\d{1,2}/\\d{4})\\b', 1), '%d/%m/%Y') AS DATE) END AS d FROM (SELECT *, lower(comment) AS lc FROM comments)",
)
define(
    "frames",
    "SELECT frame_id, d, CASE WHEN d IS NOT NULL THEN CASE WHEN contains(lc, 'lluvia') OR contains(lc, 'alerta') OR contains(lc, 'mm') OR contains(lc, 'meteo') THEN 'meteorologia' ELSE 'eventos' END "
    "WHEN contains(lc, 'evento') THEN 'eventos' ELSE 'meteorologia' END AS domain, CASE WHEN d IS NOT NULL THEN CASE WHEN contains(lc, 'otro') THEN 'otro' WHEN contains(lc, 'feria/congreso') THEN 'feria/congreso' "
    "WHEN contains(lc, 'religioso') THEN 'religioso' WHEN contains(lc, 'universitario') THEN 'universitario' WHEN contains(lc, 'cultural') THEN 'cultural' WHEN contains(lc, 'deportiv') THEN 'deportivo' END END AS event_type, "
    "CASE WHEN d IS NOT NULL THEN CASE WHEN contains(lc, 'alto') THEN 'alto' WHEN contains(lc, 'bajo') THEN 'bajo' WHEN contains(lc, 'medio') THEN 'medio' WHEN contains(lc, 'muy alto') THEN 'muy alto' END END AS impact_level, "
    "CASE WHEN d IS NOT NULL AND contains(lc, 'lluvia') THEN TRUE END AS rain, CASE WHEN d IS NOT NULL THEN try_cast(replace(regexp_extract(lc, '(\\d+(?:[,.]\\d+)?)\\s*mm\\b', 1), ',', '.') AS DOUBLE) END AS precip_mm, "
    "CASE WHEN d IS NOT NULL THEN CASE WHEN contains(lc, 'roja') THEN 'roja' WHEN contains(lc, 'naranja') THEN 'naranja' WHEN contains(lc, 'amarilla') THEN 'amarilla' END END AS alert_level FROM comment_dates",
)


def _frames(t):
    found = t.comments.select(
        "frame_id", scenario.extract_scenario_frame(F.col("comment"), F.col("reference_date")).alias("_f")
    )
    return found.select("frame_id", "_f.*")


@query(
    "NRM33_scenario_frames",
    "SELECT frame_id, d::VARCHAR AS range_start, domain, CASE domain WHEN 'eventos' THEN 'crear_evento' ELSE 'modificar_meteorologia' END AS intent, "
    "event_type, impact_level, rain, CASE WHEN d IS NOT NULL AND contains(lower(comment), 'lluvia intensa') THEN TRUE END AS heavy_rain, precip_mm, alert_level, "
    "CASE WHEN d IS NOT NULL AND (contains(lower(comment), 'todas las estaciones') OR contains(lower(comment), 'red completa')) THEN 'all' END AS affected_stations "
    "FROM frames JOIN comments USING (frame_id)",
)
def scenario_frames(t):
    return _frames(t).select(
        "frame_id", "range_start", "domain", "intent", "event_type", "impact_level", "rain", "heavy_rain", "precip_mm", "alert_level",
        F.array_join("affected_stations", ",").alias("affected_stations"),
    )


@query(
    "NRM34_validate_frames",
    "SELECT CASE WHEN d IS NULL THEN 'missing_date' WHEN frame_id % 5 = 0 THEN 'invalid_catalog_value' END AS reject_reason, COUNT(*) AS n FROM frames GROUP BY ALL",
)
def validate_frames(t):
    """Every frame also names a station; each fifth one names a station that does not exist."""
    from ridelake.operators.demand import add_series_id

    catalog = add_series_id(t.stations, t.stations)
    word = F.when(F.col("frame_id") % 5 == 0, "Nowhere").otherwise(
        F.concat(F.lit("Nation_"), (F.col("frame_id") % 25).cast("string"))
    )
    frames = _frames(t).withColumn("affected_stations", F.array(word))
    checked = scenario.validate_frames(frames, catalog)
    return checked.groupBy("reject_reason").agg(F.count("*").alias("n"))


@query(
    "PRJ7_evaluated_status",
    "SELECT execution_id, CASE WHEN NOT origin_type IN ('excel_import', 'derived') AND NOT manual_changes AND NOT accepted_items AND c THEN 'historico_evaluado' WHEN origin_type = 'excel_import' AND NOT import_modified THEN 'importada' "
    "WHEN origin_type IN ('excel_import', 'derived') THEN 'derivada' WHEN manual_changes OR accepted_items THEN 'what_if' ELSE 'base' END AS status FROM scenarios JOIN (SELECT s.execution_id, COUNT(DISTINCT r.target_date) FILTER "
    "(WHERE r.y_real IS NOT NULL) = ANY_VALUE(s.range_end - s.range_start + 1) AS c FROM scenarios s LEFT JOIN scenario_rows r USING (execution_id) GROUP BY s.execution_id) USING (execution_id)",
)
def evaluated_status(t):
    complete = scenario.historical_complete(_scenario_rows(t), t.scenarios)
    joined = scenario.scenario_columns(t.scenarios).join(complete, "execution_id")
    return joined.select(
        "execution_id", domain.evaluated_status(F.col("status"), F.col("actuals_complete")).alias("status")
    )
