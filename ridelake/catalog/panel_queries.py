"""Panel, windows, as-of baselines and training datasets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ridelake.catalog import derived
from ridelake.catalog.registry import define, query
from ridelake.operators import features, panel

define(
    "bounds",
    "SELECT series_id, MIN(service_date) AS lo, MAX(service_date) AS hi, MIN(linea) AS linea, MIN(estacion) AS estacion, "
    "MIN(station_abbrev) AS station_abbrev FROM demand GROUP BY series_id",
)
define(
    "grid",
    "SELECT series_id, linea, estacion, station_abbrev, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS service_date FROM bounds",
)
define(
    "panel",
    "SELECT g.*, CAST(d.trip_count AS DOUBLE) AS y FROM grid g LEFT JOIN demand d USING (series_id, service_date)",
)
define(
    "features",
    "SELECT *, last_value(y IGNORE NULLS) OVER u AS target_latest_observed_value, "
    "service_date - last_value(CASE WHEN y IS NOT NULL THEN service_date END IGNORE NULLS) OVER u AS target_days_since_latest_observation, "
    "lag(y, 1) OVER w AS target_lag_1, lag(y, 7) OVER w AS target_lag_7, lag(y, 14) OVER w AS target_lag_14, lag(y, 28) OVER w AS target_lag_28, "
    "avg(y) OVER w7 AS target_rolling_mean_7, stddev_samp(y) OVER w7 AS target_rolling_std_7, count(y) OVER w7 AS target_observed_count_7, "
    "avg(y) OVER w28 AS target_rolling_mean_28, stddev_samp(y) OVER w28 AS target_rolling_std_28, count(y) OVER w28 AS target_observed_count_28 "
    "FROM panel WINDOW w AS (PARTITION BY series_id ORDER BY service_date), "
    "u AS (PARTITION BY series_id ORDER BY service_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), "
    "w7 AS (PARTITION BY series_id ORDER BY service_date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), "
    "w28 AS (PARTITION BY series_id ORDER BY service_date ROWS BETWEEN 27 PRECEDING AND CURRENT ROW)",
)
define(
    "history",
    "SELECT series_id, service_date AS observed_date, isodow(service_date) AS dow, y AS observed, "
    "avg(y) OVER r AS mean4, count(y) OVER r AS count4 FROM panel WHERE y IS NOT NULL "
    "WINDOW r AS (PARTITION BY series_id, isodow(service_date) ORDER BY service_date ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)",
)
define(
    "labelled",
    "SELECT f.*, h.horizon_days, CAST(f.service_date + h.horizon_days * INTERVAL 1 DAY AS DATE) AS target_date, p.y AS trip_count_target "
    "FROM features f CROSS JOIN (VALUES (1), (7)) AS h(horizon_days) JOIN panel p ON p.series_id = f.series_id "
    "AND p.service_date = CAST(f.service_date + h.horizon_days * INTERVAL 1 DAY AS DATE) WHERE p.y IS NOT NULL",
)
define(
    "origin_rows",
    "SELECT l.*, isodow(l.target_date) AS tdow, l.service_date AS forecast_origin_date, l.target_latest_observed_value AS baseline_naive_simple, "
    "l.service_date - CAST(l.target_days_since_latest_observation AS INT) AS baseline_naive_simple_reference_date, "
    "s.observed AS baseline_naive_seasonal_weekly, s.observed_date AS baseline_naive_seasonal_reference_date, "
    "s.mean4 AS baseline_seasonal_weekday_mean_4, s.count4 AS baseline_seasonal_weekday_mean_4_reference_count "
    "FROM (SELECT *, isodow(target_date) AS tdow0 FROM labelled) l ASOF LEFT JOIN history s "
    "ON l.series_id = s.series_id AND l.tdow0 = s.dow AND l.service_date >= s.observed_date",
)

AUTO_SQL = (
    "target_latest_observed_value, CAST(target_days_since_latest_observation AS BIGINT) AS target_days_since_latest_observation, "
    "target_lag_1, target_lag_7, target_lag_14, target_lag_28, round(target_rolling_mean_7, 6) AS target_rolling_mean_7, "
    "round(target_rolling_std_7, 6) AS target_rolling_std_7, target_observed_count_7, "
    "round(target_rolling_mean_28, 6) AS target_rolling_mean_28, round(target_rolling_std_28, 6) AS target_rolling_std_28, "
    "target_observed_count_28"
)


@query("WIN1_densify", "SELECT series_id, service_date::VARCHAR AS service_date, y AS observed_target_value FROM panel")
def densify(t):
    return panel.densify(t.demand)


@query(
    "WIN2_forward_fill",
    "SELECT series_id, service_date::VARCHAR AS service_date, target_latest_observed_value, "
    "CAST(target_days_since_latest_observation AS BIGINT) AS target_days_since_latest_observation FROM features",
)
def forward_fill(t):
    return panel.forward_fill(panel.densify(t.demand)).drop("observed_target_value")


@query(
    "WIN3_lags",
    "SELECT series_id, service_date::VARCHAR AS service_date, target_lag_1, target_lag_7, target_lag_14, target_lag_28 FROM features",
)
def lags(t):
    return panel.lags(panel.densify(t.demand)).drop("observed_target_value")


@query("WIN4_rolling", f"SELECT series_id, service_date::VARCHAR AS service_date, {AUTO_SQL} FROM features")
def rolling(t):
    rows = derived.panel_features(t).drop("observed_target_value", *derived.ATTRIBUTES)
    return derived.rounded(rows)


@query(
    "WIN5_weekday_mean_4",
    "SELECT series_id, observed_date::VARCHAR AS observed_date, round(mean4, 6) AS weekday_mean_4, count4 AS weekday_mean_4_count FROM history",
)
def weekday_mean(t):
    history = panel.observed_history(panel.densify(t.demand))
    rows = panel.weekday_mean_4(history).drop("observed_day_of_week", "observed_target_value")
    return derived.rounded(rows)


BASELINE_SQL = (
    "SELECT series_id, horizon_days, forecast_origin_date::VARCHAR AS forecast_origin_date, target_date::VARCHAR AS target_date, "
    "trip_count_target, baseline_naive_simple, baseline_naive_simple_reference_date::VARCHAR AS baseline_naive_simple_reference_date, "
    "baseline_naive_seasonal_weekly, baseline_naive_seasonal_reference_date::VARCHAR AS baseline_naive_seasonal_reference_date, "
    "round(baseline_seasonal_weekday_mean_4, 6) AS baseline_seasonal_weekday_mean_4, "
    "baseline_naive_seasonal_reference_date::VARCHAR AS baseline_seasonal_weekday_mean_4_reference_date, "
    "baseline_seasonal_weekday_mean_4_reference_count FROM origin_rows"
)


@query("JN4_WIN6_naive_baselines", BASELINE_SQL)
def naive_baselines(t):
    rows = derived.origins(t).select(
        "series_id", "horizon_days", "forecast_origin_date", "target_date", "trip_count_target", *features.BASELINE_COLUMNS
    )
    return derived.rounded(rows)


@query(
    "JN5_asof_same_weekday",
    "SELECT series_id, horizon_days, forecast_origin_date::VARCHAR AS forecast_origin_date, baseline_naive_seasonal_weekly, "
    "baseline_naive_seasonal_reference_date::VARCHAR AS baseline_naive_seasonal_reference_date, "
    "round(baseline_seasonal_weekday_mean_4, 6) AS baseline_seasonal_weekday_mean_4, "
    "baseline_seasonal_weekday_mean_4_reference_count FROM origin_rows",
)
def asof_same_weekday(t):
    """The general as-of form, on the same rows as the dense form above."""
    dense = panel.densify(t.demand)
    rows = derived.union_all([features.target_join(dense, h) for h in features.HORIZONS]).select(
        "series_id",
        "horizon_days",
        "forecast_origin_date",
        F.weekday("target_date").alias("target_day_of_week"),
    )
    found = panel.asof_same_weekday(rows, panel.observed_history(dense))
    return derived.rounded(
        found.drop("target_day_of_week", "baseline_seasonal_weekday_mean_4_reference_date")
    )


define(
    "runs",
    "SELECT series_id, run, COUNT(*) FILTER (WHERE y IS NULL) AS gap FROM (SELECT *, count(y) OVER (PARTITION BY series_id "
    "ORDER BY service_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM panel) GROUP BY ALL",
)


@query("WIN7_longest_gap", "SELECT series_id, MAX(gap) AS max_gap_days FROM runs GROUP BY series_id")
def longest_gap(t):
    return panel.longest_gap(panel.densify(t.demand))


define(
    "diagnostics",
    "SELECT p.series_id, MIN(service_date) FILTER (WHERE y IS NOT NULL) AS first_observed_date, "
    "MAX(service_date) FILTER (WHERE y IS NOT NULL) AS last_observed_date, COUNT(y) AS observed_days, COUNT(*) AS calendar_span_days, "
    "COUNT(*) - COUNT(y) AS intra_span_missing_days, COUNT(y) / COUNT(*) AS coverage_ratio, ANY_VALUE(m.max_gap_days) AS max_gap_days "
    "FROM panel p JOIN (SELECT series_id, MAX(gap) AS max_gap_days FROM runs GROUP BY series_id) m USING (series_id) GROUP BY p.series_id",
)


@query(
    "AG12_panel_diagnostics",
    "SELECT series_id, first_observed_date::VARCHAR AS first_observed_date, last_observed_date::VARCHAR AS last_observed_date, observed_days, "
    "calendar_span_days, intra_span_missing_days, round(coverage_ratio, 6) AS coverage_ratio, max_gap_days, "
    "first_observed_date - (SELECT MIN(service_date) FROM panel) AS pre_observation_days, "
    "(SELECT MAX(service_date) FROM panel) - last_observed_date AS post_observation_days FROM diagnostics",
)
def panel_diagnostics(t):
    return derived.rounded(panel.panel_diagnostics(panel.densify(t.demand)))


@query(
    "AG13_series_metadata",
    "SELECT series_id, MIN(service_date)::VARCHAR AS first_date, MAX(service_date)::VARCHAR AS last_date, "
    "arg_min(trip_count, service_date) FILTER (WHERE trip_count > 1) AS first_busy FROM demand GROUP BY series_id",
)
def series_metadata(t):
    holed = t.demand.withColumn("first_busy", F.when(F.col("trip_count") > 1, F.col("trip_count")))
    return panel.series_metadata(holed, ["first_busy"])


define("daily_orders", "SELECT CAST(o_orderdate AS DATE) AS day, COUNT(*) AS n FROM orders GROUP BY ALL")


@query(
    "WIN8_cumulative",
    "SELECT day::VARCHAR AS day, CAST(SUM(n) OVER (ORDER BY day) AS BIGINT) AS running_total, "
    "CAST(SUM(n) OVER (PARTITION BY year(day) ORDER BY day) AS BIGINT) AS year_to_date FROM daily_orders",
)
def cumulative(t):
    daily = t.orders.groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n"))
    return panel.cumulative(daily, "day", "n").drop("n")


@query(
    "WIN11_manifest_ids",
    "SELECT dia, CASE WHEN day(dia::DATE) <= 20 THEN day(dia::DATE) * 2 ELSE 40 + day(dia::DATE) - 20 END AS manifest_id "
    "FROM (SELECT DISTINCT dia FROM raw)",
)
def manifest_ids(t):
    """Stored days 1 to 20 keep their number; later days get the next ones."""
    from ridelake.sources.reports import number_manifests

    stored = t.raw.filter("day(CAST(dia AS DATE)) <= 20").select(
        "dia", (F.day(F.to_date("dia")) * 2).alias("_orden_manifest")
    )
    numbered = number_manifests(t.raw.drop("_orden_manifest"), stored)
    return numbered.groupBy("dia").agg(F.max("_orden_manifest").alias("manifest_id"))


@query(
    "WIN12_latest_per_series",
    "SELECT series_id, service_date::VARCHAR AS target_date, trip_count FROM demand QUALIFY row_number() OVER "
    "(PARTITION BY series_id ORDER BY service_date DESC) = 1",
)
def latest_per_series(t):
    rows = t.demand.select("series_id", F.col("service_date").alias("target_date"), "trip_count")
    return panel.latest_per_series(rows)


@query(
    "WIN13_history_dedup",
    "SELECT linea AS series_id, service_date::VARCHAR AS observed_date, arg_max(trip_count, estacion) AS observed_target_value "
    "FROM demand GROUP BY ALL",
)
def history_dedup(t):
    rows = t.demand.select(
        F.col("linea").alias("series_id"),
        F.col("service_date").alias("target_date"),
        F.col("trip_count").alias("trip_count_target"),
        "estacion",
    )
    return panel.history_dedup(rows, "estacion")


define(
    "serving",
    "SELECT series_id, service_date AS observed_date, trip_count::DOUBLE AS y, avg(trip_count) OVER w7 AS m7, stddev_samp(trip_count) OVER w7 AS s7, "
    "count(*) OVER w7 AS c7, avg(trip_count) OVER w28 AS m28, stddev_samp(trip_count) OVER w28 AS s28, count(*) OVER w28 AS c28 FROM demand "
    "WINDOW w7 AS (PARTITION BY series_id ORDER BY service_date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), "
    "w28 AS (PARTITION BY series_id ORDER BY service_date ROWS BETWEEN 27 PRECEDING AND CURRENT ROW)",
)


@query(
    "WIN14_serving_features",
    "SELECT g.series_id, g.service_date::VARCHAR AS forecast_origin_date, h.y AS target_latest_observed_value, "
    "g.service_date - h.observed_date AS target_days_since_latest_observation, round(h.m7, 6) AS target_rolling_mean_7, "
    "round(h.s7, 6) AS target_rolling_std_7, h.c7 AS target_observed_count_7, round(h.m28, 6) AS target_rolling_mean_28, "
    "round(h.s28, 6) AS target_rolling_std_28, h.c28 AS target_observed_count_28, "
    "a.y AS target_lag_1, b.y AS target_lag_7, c.y AS target_lag_14, d.y AS target_lag_28 "
    "FROM grid g ASOF LEFT JOIN serving h ON g.series_id = h.series_id AND g.service_date >= h.observed_date "
    "LEFT JOIN serving a ON a.series_id = g.series_id AND a.observed_date = g.service_date - 1 "
    "LEFT JOIN serving b ON b.series_id = g.series_id AND b.observed_date = g.service_date - 7 "
    "LEFT JOIN serving c ON c.series_id = g.series_id AND c.observed_date = g.service_date - 14 "
    "LEFT JOIN serving d ON d.series_id = g.series_id AND d.observed_date = g.service_date - 28",
)
def serving_features(t):
    history = t.demand.select(
        "series_id",
        F.col("service_date").alias("observed_date"),
        F.col("trip_count").cast("double").alias("observed_target_value"),
    )
    origins = panel.densify(t.demand).select("series_id", F.col("service_date").alias("forecast_origin_date"))
    return derived.rounded(panel.serving_history_features(history, origins))


@query(
    "WIN14_serving_features_days",
    "SELECT series_id, service_date::VARCHAR AS forecast_origin_date, round(target_rolling_mean_7, 6) AS target_rolling_mean_7, "
    "round(target_rolling_std_28, 6) AS target_rolling_std_28, target_observed_count_28, target_lag_7 FROM features",
)
def serving_features_days(t):
    """Calendar-day frames, which must equal the training features on the dense panel."""
    history = t.demand.select(
        "series_id",
        F.col("service_date").alias("observed_date"),
        F.col("trip_count").cast("double").alias("observed_target_value"),
    )
    origins = panel.densify(t.demand).select("series_id", F.col("service_date").alias("forecast_origin_date"))
    found = panel.serving_history_features(history, origins, frame="days")
    return derived.rounded(
        found.select(
            "series_id", "forecast_origin_date", "target_rolling_mean_7", "target_rolling_std_28",
            "target_observed_count_28", "target_lag_7",
        )
    )


@query(
    "WIN19_smoke_rows",
    "SELECT series_id, forecast_origin_date::VARCHAR AS forecast_origin_date, horizon_days FROM origin_rows WHERE horizon_days = 1 AND "
    "forecast_origin_date IN (SELECT DISTINCT forecast_origin_date FROM origin_rows WHERE horizon_days = 1 ORDER BY 1 DESC LIMIT 2) "
    "QUALIFY row_number() OVER (PARTITION BY forecast_origin_date ORDER BY series_id, target_date) <= 5",
)
def smoke_rows(t):
    rows = features.origin_rows(derived.panel_features(t), 1)
    return panel.smoke_rows(rows, 5).select("series_id", "forecast_origin_date", "horizon_days")


# Training datasets --------------------------------------------------------------------------

define(
    "line_services",
    "SELECT fecha AS target_date, linea, CASE WHEN trim(archivo_xml_planificado) <> '' THEN archivo_xml_planificado END AS planned, servicio, "
    "start_m, e + CASE WHEN e < 300 THEN 1440 ELSE 0 END AS end_m, CASE WHEN e < 300 THEN 1 ELSE 0 END AS end_off FROM ("
    "SELECT fecha, archivo_xml_planificado, servicio, CAST(inicio_serv_comercial[1:2] AS INT) * 60 + 30 AS start_m, 'LINEA 1' AS linea, "
    "CAST(fin_l1_serv_comercial[1:2] AS INT) * 60 + 15 AS e FROM services WHERE fin_l1_serv_comercial IS NOT NULL UNION ALL "
    "SELECT fecha, archivo_xml_planificado, servicio, CAST(inicio_serv_comercial[1:2] AS INT) * 60 + 30, 'LINEA 2', "
    "CAST(fin_l2_serv_comercial[1:2] AS INT) * 60 + 5 FROM services WHERE fin_l2_serv_comercial <> 'x')",
)

TRAIN_COMMON = (
    "o.forecast_origin_date::VARCHAR AS forecast_origin_date, o.target_date::VARCHAR AS target_date, o.horizon_days, o.series_id, "
    "o.trip_count_target, o.target_lag_7, round(o.target_rolling_std_28, 6) AS target_rolling_std_28, "
    "o.baseline_naive_seasonal_weekly, x.day_of_week AS calendar_day_of_week, x.is_holiday::INT::DOUBLE AS calendar_is_holiday, "
    "x.days_to_next_holiday AS calendar_days_to_next_holiday"
)


@query(
    "TB10_training_strict",
    f"SELECT {TRAIN_COMMON}, 'strict_available' AS feature_variant FROM origin_rows o LEFT JOIN external x ON x.date = o.target_date "
    "WHERE o.horizon_days = 1",
)
def training_strict(t):
    external = features.external_features(derived.external(t))
    dataset = features.training_dataset(derived.panel_features(t), external, features.STRICT, 1)
    assert "weather_temp_max_c" not in dataset.columns
    return derived.rounded(
        dataset.select(
            "forecast_origin_date", "target_date", "horizon_days", "series_id", "trip_count_target", "target_lag_7",
            "target_rolling_std_28", "baseline_naive_seasonal_weekly", "calendar_day_of_week",
            "calendar_is_holiday", "calendar_days_to_next_holiday", "feature_variant",
        )
    )


@query(
    "TB10_training_scenario",
    f"SELECT {TRAIN_COMMON}, 'forecastable_scenario' AS feature_variant, x.weather_code::VARCHAR AS weather_code, "
    "round(x.temp_mean_c, 6) AS weather_temp_mean_c, x.is_bad_weather_day::INT::DOUBLE AS weather_is_bad_weather_day, "
    "s.end_m - s.start_m AS service_duration_minutes, CASE WHEN s.planned IS NOT NULL THEN 1.0 ELSE 0.0 END AS service_has_planned_xml, "
    "coalesce(s.planned, s.servicio) AS service_planned_code FROM origin_rows o LEFT JOIN external x ON x.date = o.target_date "
    "LEFT JOIN line_services s ON s.target_date = o.target_date AND s.linea = o.linea WHERE o.horizon_days = 7 "
    "AND o.target_date >= DATE '1998-03-08' AND o.series_id NOT IN ('NAD1', 'NCD2')",
)
def training_scenario(t):
    from ridelake.operators import operations

    external = features.external_features(derived.external(t))
    lines = operations.services_line_daily(operations.services_daily(t.services))
    dataset = features.training_dataset(
        derived.panel_features(t),
        external,
        features.SCENARIO,
        7,
        features.SPARSE_EXCLUDED,
        services=features.service_features(lines),
        scenario_start="1998-03-08",
        sparse_series=["NAD1", "NCD2"],
    )
    return derived.rounded(
        dataset.select(
            "forecast_origin_date", "target_date", "horizon_days", "series_id", "trip_count_target", "target_lag_7",
            "target_rolling_std_28", "baseline_naive_seasonal_weekly", "calendar_day_of_week", "calendar_is_holiday",
            "calendar_days_to_next_holiday", "feature_variant", "weather_code", "weather_temp_mean_c",
            "weather_is_bad_weather_day", "service_duration_minutes", "service_has_planned_xml", "service_planned_code",
        )
    )


@query(
    "JN11_PRJ6_event_features",
    "SELECT d.series_id, d.service_date::VARCHAR AS target_date, coalesce(v.n, 0.0) AS event_active_count, "
    "coalesce(v.a, 0.0) AS event_starting_estimated_attendance_sum FROM demand d LEFT JOIN (SELECT service_date, linea, estacion, "
    "active_event_count / lines AS n, starting_estimated_attendance_sum / lines AS a FROM event_series) v USING (service_date, linea, estacion)",
)
def event_features(t):
    from ridelake.operators import operations

    station_daily = operations.event_station_daily(derived.events(t), derived.mapping(t))
    series_daily = operations.event_series_daily(station_daily, t.stations)
    rows = t.demand.select("series_id", F.col("service_date").alias("target_date"), "linea", "estacion")
    joined = features.join_events(rows, features.event_features(series_daily))
    return joined.select("series_id", "target_date", "event_active_count", "event_starting_estimated_attendance_sum")


@query(
    "PRJ5_JN11_service_features",
    "SELECT d.series_id, d.service_date::VARCHAR AS target_date, s.start_m AS service_planned_start_minutes, s.end_m AS service_line_end_minutes, "
    "s.end_off AS service_line_end_day_offset, s.planned IS NOT NULL AS service_has_planned_xml FROM demand d LEFT JOIN line_services s "
    "ON s.target_date = d.service_date AND s.linea = d.linea",
)
def service_features(t):
    from ridelake.operators import operations

    lines = operations.services_line_daily(operations.services_daily(t.services))
    rows = t.demand.select("series_id", F.col("service_date").alias("target_date"), "linea")
    joined = features.join_services(rows, features.service_features(lines))
    return joined.select(
        "series_id", "target_date", "service_planned_start_minutes", "service_line_end_minutes",
        "service_line_end_day_offset", "service_has_planned_xml",
    )


@query(
    "PRJ1_PRJ2_external_features",
    "SELECT date::VARCHAR AS target_date, year AS calendar_year, is_weekend AS calendar_is_weekend, week_of_year AS calendar_week_of_year, "
    "round(temp_max_c, 6) AS weather_temp_max_c, weather_code, is_rainy_day AS weather_is_rainy_day FROM external",
)
def external_features(t):
    rows = features.external_features(derived.external(t))
    return derived.rounded(
        rows.select(
            "target_date", "calendar_year", "calendar_is_weekend", "calendar_week_of_year",
            "weather_temp_max_c", "weather_code", "weather_is_rainy_day",
        )
    )


@query(
    "AG25_catalog_counts",
    "SELECT 'feature_group' AS kind, CASE WHEN l LIKE 'calendar%' THEN 'calendar' ELSE 'autoregressive' END AS name, COUNT(*) AS features FROM "
    "(SELECT unnest(['target_lag_1', 'target_lag_7', 'target_rolling_mean_7', 'calendar_day', 'calendar_month']) AS l, COUNT(*) AS n FROM features) WHERE n > 0 GROUP BY ALL",
)
def catalog_counts(t):
    """Groups of the catalogue's features that the panel or the calendar fills."""
    wanted = ["target_lag_1", "target_lag_7", "target_rolling_mean_7", "calendar_day", "calendar_month"]
    filled = derived.panel_features(t).agg(F.count("*").alias("n")).select(
        F.explode(F.array(*[F.lit(w) for w in wanted])).alias("feature_name"), "n"
    )
    catalog = features.availability_catalog(t.spark).join(filled.filter("n > 0"), "feature_name")
    return features.catalog_counts(catalog).filter("kind = 'feature_group'")


@query(
    "PRJ4_AG25_used_catalog",
    "SELECT CASE WHEN l LIKE '%lag%' OR l LIKE '%rolling%' THEN 'autoregressive' ELSE 'calendar' END AS feature_group, "
    "CAST(SUM(n) AS BIGINT) AS non_null_cells FROM (SELECT 'lag_7' AS l, COUNT(target_lag_7) AS n FROM features "
    "UNION ALL SELECT 'rolling_mean_7', COUNT(target_rolling_mean_7) FROM features "
    "UNION ALL SELECT 'calendar_day', (SELECT COUNT(*) FROM external)) GROUP BY ALL",
)
def used_catalog(t):
    """Non-NULL cells of three features, grouped by what the catalogue says they are."""
    cells = derived.panel_features(t).agg(
        F.count("target_lag_7").alias("target_lag_7"), F.count("target_rolling_mean_7").alias("target_rolling_mean_7")
    ).unpivot([], ["target_lag_7", "target_rolling_mean_7"], "feature_name", "n")
    days = derived.external(t).agg(F.count("day").alias("n")).select(
        F.lit("calendar_day").alias("feature_name"), "n"
    )
    catalog = features.availability_catalog(t.spark)
    return (
        cells.unionByName(days)
        .join(catalog, "feature_name")
        .groupBy("feature_group")
        .agg(F.sum("n").alias("non_null_cells"))
    )


@query(
    "AG26_dataset_stats",
    "SELECT 'strict_available' AS feature_variant, 'all_series' AS series_policy, horizon_days, COUNT(*) AS row_count, "
    "COUNT(DISTINCT series_id) AS series_count, MIN(forecast_origin_date)::VARCHAR AS origin_min, MAX(forecast_origin_date)::VARCHAR AS origin_max, "
    "MIN(target_date)::VARCHAR AS target_min, MAX(target_date)::VARCHAR AS target_max FROM origin_rows GROUP BY horizon_days",
)
def dataset_stats(t):
    rows = derived.origins(t).withColumns(
        {"feature_variant": F.lit(features.STRICT), "series_policy": F.lit(features.ALL_SERIES)}
    )
    return features.dataset_stats(rows)


@query(
    "NRM30_finalize_dtypes",
    "SELECT c_custkey, CAST(c_nationkey AS VARCHAR) AS zone, (c_nationkey % 10 = 3)::INT::DOUBLE AS is_interchange_candidate FROM customer",
)
def finalize_dtypes(t):
    rows = t.customer.select(
        "c_custkey", F.col("c_nationkey").alias("zone"), (F.col("c_nationkey") % 10 == 3).alias("is_interchange_candidate")
    )
    return features.finalize_dtypes(rows)
