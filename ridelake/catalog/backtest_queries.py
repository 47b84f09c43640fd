"""Splits, metrics, special days and supervision."""

from __future__ import annotations

from pyspark.sql import functions as F

from ridelake.catalog import derived
from ridelake.catalog.registry import QUERIES, define, query
from ridelake.operators import analysis, backtest, features, panel
from ridelake.operators.scale import materialized

define(
    "split_bounds",
    "SELECT horizon_days, MIN(forecast_origin_date) AS lo, MAX(forecast_origin_date) AS hi, MAX(forecast_origin_date) - 179 AS ts FROM origin_rows GROUP BY horizon_days",
)
define(
    "splits",
    "SELECT horizon_days, 'validation_fold_' || f AS split_name, 'validation' AS split_type, lo AS train_start, ts - 56 * (4 - f) - 1 AS train_end, "
    "ts - 56 * (4 - f) AS score_start, ts - 56 * (3 - f) - 1 AS score_end FROM split_bounds, (VALUES (1), (2), (3)) AS k(f) "
    "UNION ALL SELECT horizon_days, 'test', 'test', lo, ts - 1, ts, hi FROM split_bounds",
)
define(
    "scored",
    "SELECT o.*, s.split_name, s.split_type FROM origin_rows o JOIN splits s ON o.horizon_days = s.horizon_days "
    "AND o.forecast_origin_date BETWEEN s.score_start AND s.score_end",
)
define(
    "preds",
    "SELECT model_name, 'strict_available' AS variant, 'all_series' AS series_policy, horizon_days, split_name, split_type, series_id, linea, estacion, "
    "forecast_origin_date, target_date, trip_count_target AS y_true, y_pred FROM (SELECT *, unnest(['baseline_naive_simple', "
    "'baseline_naive_seasonal_weekly', 'tabular_hgbr']) AS model_name, unnest([baseline_naive_simple, baseline_naive_seasonal_weekly, "
    "baseline_seasonal_weekday_mean_4]) AS y_pred FROM scored)",
)


def metrics_sql(prediction: str = "y_pred", actual: str = "y_true") -> str:
    both = f"({prediction} IS NOT NULL AND {actual} IS NOT NULL)"
    error = f"abs({prediction} - {actual})"
    scale = f"(abs({prediction}) + abs({actual}))"
    return (
        f"COUNT(*) AS row_count, COUNT(*) FILTER (WHERE {both}) AS available_prediction_count, "
        f"round(SUM({error}), 4) AS abs_error_sum, round(AVG({error}), 6) AS mae, round(sqrt(AVG({error} * {error})), 6) AS rmse, "
        f"round(SUM({error}) / nullif(SUM(abs({actual})) FILTER (WHERE {both}), 0), 6) AS wape, "
        f"round(AVG(CASE WHEN {scale} = 0 THEN 0 ELSE 2 * {error} / {scale} END) FILTER (WHERE {both}), 6) AS smape, "
        f"round(COUNT(*) FILTER (WHERE {both}) / COUNT(*), 6) AS coverage_ratio"
    )


def _metrics(df):
    return derived.rounded(df.withColumn("abs_error_sum", F.round("abs_error_sum", 4)))


@query(
    "EV1_temporal_splits",
    "SELECT horizon_days, split_name, split_type, train_start::VARCHAR AS train_start, train_end::VARCHAR AS train_end, score_start::VARCHAR AS score_start, "
    "score_end::VARCHAR AS score_end FROM splits",
)
def temporal_splits(t):
    return _splits(t)


def _splits(t):
    """Splits of all horizons."""
    dense = panel.densify(t.demand)
    parts = [backtest.temporal_splits(features.target_join(dense, h)).withColumn("horizon_days", F.lit(h)) for h in features.HORIZONS]
    return derived.union_all(parts)


@query(
    "EV2_assign_splits",
    "SELECT 'score' AS role, horizon_days, split_name, COUNT(*) AS n FROM scored GROUP BY ALL UNION ALL "
    "SELECT 'train', o.horizon_days, s.split_name, COUNT(*) FROM origin_rows o JOIN splits s ON o.horizon_days = s.horizon_days "
    "AND o.forecast_origin_date BETWEEN s.train_start AND s.train_end GROUP BY ALL",
)
def assign_splits(t):
    dense = panel.densify(t.demand)
    parts = []
    for h in features.HORIZONS:
        rows = features.target_join(dense, h)
        for role in ("score", "train"):
            counted = (
                backtest.assign_splits(rows, role=role)
                .groupBy("horizon_days", "split_name")
                .agg(F.count("*").alias("n"))
            )
            parts.append(counted.withColumn("role", F.lit(role)))
    return derived.union_all(parts)


@query(
    "EV6_run_baselines",
    "SELECT model_name, horizon_days, split_name, COUNT(*) AS n, CAST(SUM(y_true) AS BIGINT) AS actual, COUNT(y_pred) AS predicted FROM preds GROUP BY ALL",
)
def run_baselines(t):
    return derived.predictions(t).groupBy("model_name", "horizon_days", "split_name").agg(
        F.count("*").alias("n"), F.sum("y_true").cast("long").alias("actual"), F.count("y_pred").alias("predicted")
    )


@query(
    "AG14_forecast_metrics",
    f"SELECT model_name, horizon_days, linea, {metrics_sql()} FROM preds GROUP BY model_name, horizon_days, linea",
)
def forecast_metrics(t):
    return _metrics(backtest.forecast_metrics(derived.predictions(t), ["model_name", "horizon_days", "linea"]))


SPEC = "model_name, variant, series_policy, horizon_days"
AG15_SQL = (
    f"SELECT CASE GROUPING(split_name, linea, series_id) WHEN 7 THEN 'overall' WHEN 3 THEN 'split' WHEN 1 THEN 'line' ELSE 'series' END AS metric_level, "
    f"{SPEC}, split_name, split_type, linea, series_id, {metrics_sql()} FROM preds GROUP BY GROUPING SETS (({SPEC}), ({SPEC}, split_name, split_type), "
    f"({SPEC}, split_name, split_type, linea), ({SPEC}, split_name, split_type, linea, series_id))"
)


@query("AG15_evaluate_all", AG15_SQL)
def evaluate_all(t):
    return _metrics(backtest.evaluate_all(derived.predictions(t)))


define("sparse_series", "SELECT series_id FROM diagnostics WHERE coverage_ratio < (SELECT median(coverage_ratio) FROM diagnostics)")
define(
    "policy_preds",
    "SELECT *  REPLACE ('all_series' AS series_policy) FROM preds WHERE split_type = 'test' AND model_name = 'tabular_hgbr' UNION ALL "
    "SELECT * REPLACE ('sparse_excluded' AS series_policy) FROM preds WHERE split_type = 'test' AND model_name = 'tabular_hgbr' "
    "AND series_id NOT IN ('NAD1', 'NAD2', 'NCD1', 'NCD2', 'NED1', 'NED2')",
)
define("wapes", "SELECT horizon_days, series_policy, linea, SUM(abs(y_pred - y_true)) / nullif(SUM(CASE WHEN y_pred IS NOT NULL THEN abs(y_true) END), 0) AS w FROM policy_preds GROUP BY GROUPING SETS ((horizon_days, series_policy), (horizon_days, series_policy, linea))")


def _policy_decisions(t):
    test = materialized(derived.predictions(t).filter("split_type = 'test' AND model_name = 'tabular_hgbr'"))
    shared = ["NAD1", "NAD2", "NCD1", "NCD2", "NED1", "NED2"]
    both = test.unionByName(
        features.drop_sparse(test, shared).withColumn("series_policy", F.lit(features.SPARSE_EXCLUDED))
    )
    split = backtest.forecast_metrics(both, ["horizon_days", "series_policy"])
    line = backtest.forecast_metrics(both, ["horizon_days", "series_policy", "linea"])
    return backtest.select_policy(split, line)


define(
    "decisions",
    "SELECT n.horizon_days, n.a AS wape_all_series, n.s AS wape_sparse_excluded, l.worst AS worst_line_relative_change, l.ok AS line_guardrail_ok, "
    "(n.a - n.s) / n.a AS relative_wape_improvement, (n.a - n.s) / n.a >= 0.02 AND l.ok AS decision_supported FROM "
    "(SELECT horizon_days, MAX(w) FILTER (WHERE series_policy = 'all_series') AS a, MAX(w) FILTER (WHERE series_policy = 'sparse_excluded') AS s "
    "FROM wapes WHERE linea IS NULL GROUP BY horizon_days) n JOIN (SELECT horizon_days, MAX((s - a) / a) AS worst, bool_and((s - a) / a <= 0.01) AS ok FROM "
    "(SELECT horizon_days, linea, MAX(w) FILTER (WHERE series_policy = 'all_series') AS a, MAX(w) FILTER (WHERE series_policy = 'sparse_excluded') AS s "
    "FROM wapes WHERE linea IS NOT NULL GROUP BY horizon_days, linea) GROUP BY horizon_days) l USING (horizon_days)",
)


@query(
    "EV3_select_policy",
    "SELECT horizon_days, round(wape_all_series, 6) AS wape_all_series, round(wape_sparse_excluded, 6) AS wape_sparse_excluded, "
    "round(worst_line_relative_change, 6) AS worst_line_relative_change, line_guardrail_ok, round(relative_wape_improvement, 6) "
    "AS relative_wape_improvement, decision_supported FROM decisions",
)
def select_policy(t):
    return derived.rounded(_policy_decisions(t))


@query(
    "EV5_comparison_summary",
    "SELECT model_name, horizon_days, series_policy = (SELECT CASE WHEN bool_and(decision_supported) THEN 'sparse_excluded' ELSE 'all_series' END FROM decisions) "
    "AS selected_for_final_comparison, COUNT(*) AS row_count FROM preds WHERE split_type = 'test' GROUP BY ALL",
)
def comparison_summary(t):
    policy = backtest.recommended_policy(_policy_decisions(t))
    rows = backtest.forecast_metrics(derived.predictions(t), [*backtest.SPEC_COLUMNS, "split_type"])
    final = backtest.comparison_summary(rows, policy)
    return final.select("model_name", "horizon_days", "selected_for_final_comparison", "row_count")


# Special days -------------------------------------------------------------------------------

define(
    "comparison0",
    "SELECT s.horizon_days, s.forecast_origin_date, s.target_date, s.series_id, s.linea, s.estacion, s.trip_count_target AS y_true, "
    "s.baseline_naive_seasonal_weekly AS ps, s.baseline_seasonal_weekday_mean_4 AS pt, (s.baseline_naive_simple + s.baseline_seasonal_weekday_mean_4) / 2 AS pf, "
    "coalesce(x.is_holiday, FALSE) AS is_holiday, coalesce(x.is_preholiday, FALSE) AS is_preholiday, coalesce(x.is_postholiday, FALSE) AS is_postholiday, "
    "x.holiday_name, coalesce(x.is_bad_weather_day, FALSE) AS bad_weather_day, coalesce(x.is_heavy_rain_day, FALSE) AS heavy_rain_day, x.date, "
    "coalesce(x.date IS NOT NULL AND dayofyear(s.target_date) % 9 = 0, FALSE) AS event_day, coalesce(x.date IS NOT NULL AND dayofyear(s.target_date) % 27 = 0, FALSE) "
    "AS high_impact_event_day, x.is_holiday AS hol, x.precip_mm AS precip FROM scored s LEFT JOIN external x ON x.date = s.target_date WHERE s.split_type = 'test'",
)
define(
    "easter",
    "SELECT DISTINCT CAST(unnest(generate_series(target_date - INTERVAL 4 DAY, target_date + INTERVAL 4 DAY, INTERVAL 1 DAY)) AS DATE) AS e FROM comparison0 "
    "WHERE lower(holiday_name) LIKE '%jueves santo%' UNION SELECT DISTINCT CAST(unnest(generate_series(target_date - INTERVAL 5 DAY, "
    "target_date + INTERVAL 3 DAY, INTERVAL 1 DAY)) AS DATE) FROM comparison0 WHERE lower(holiday_name) LIKE '%viernes santo%'",
)
define("comparison", "SELECT *, target_date IN (SELECT e FROM easter) AS is_semana_santa FROM comparison0")

FLAG_LIST = ", ".join(analysis.SEGMENT_FLAGS)


@query(
    "JN12_compare_forecasts",
    "SELECT horizon_days, forecast_origin_date::VARCHAR AS forecast_origin_date, target_date::VARCHAR AS target_date, series_id, linea, estacion, y_true, "
    "ps AS y_pred_seasonal, round(pt, 6) AS y_pred_tabular_strict, pf0 AS y_pred_tabular_forecastable FROM (SELECT *, "
    "lag(1) OVER () AS dummy, p.baseline_naive_simple AS pf0 FROM comparison c JOIN (SELECT horizon_days AS h, forecast_origin_date AS f, series_id AS i, "
    "baseline_naive_simple FROM scored WHERE split_type = 'test') p ON p.h = c.horizon_days AND p.f = c.forecast_origin_date AND p.i = c.series_id)",
)
def compare_forecasts(t):
    test = materialized(derived.predictions(t).filter("split_type = 'test'"))
    by_model = {m: test.filter(F.col("model_name") == m) for m in derived.MODELS}
    joined = analysis.compare_forecasts(
        by_model["baseline_naive_seasonal_weekly"], by_model["tabular_hgbr"], by_model["baseline_naive_simple"]
    )
    return derived.rounded(joined)


@query(
    "WIN15_segment_flags",
    f"SELECT horizon_days, {FLAG_LIST}, COUNT(*) AS n FROM comparison GROUP BY ALL",
)
def segment_flags(t):
    return derived.comparison(t).groupBy("horizon_days", *analysis.SEGMENT_FLAGS).agg(F.count("*").alias("n"))


define("totals", "SELECT horizon_days, SUM(abs(y_true)) AS total FROM comparison GROUP BY ALL")


@query(
    "WIN17_error_columns",
    "SELECT horizon_days, target_date::VARCHAR AS target_date, series_id, round(abs(ps - y_true), 6) AS seasonal_abs_error, "
    "round(abs(ps - y_true) / nullif(abs(y_true), 0), 6) AS seasonal_relative_error, round(abs(ps - y_true) / total, 9) AS seasonal_wape_contribution, "
    "round(y_true / nullif(ps, 0), 6) AS real_baseline_ratio, round(abs(pt - y_true) - abs(ps - y_true), 6) AS tabular_strict_error_delta_vs_seasonal, "
    "coalesce(abs(pt - y_true) < abs(ps - y_true), FALSE) AS tabular_strict_improves_vs_seasonal, "
    "round(abs(pf - y_true) - abs(pt - y_true), 6) AS forecastable_error_delta_vs_strict FROM comparison JOIN totals USING (horizon_days)",
)
def error_columns(t):
    rows = analysis.error_columns(analysis.with_horizon_total(derived.comparison(t)), F.col("_total"))
    digits = {"seasonal_wape_contribution": 9}
    names = [
        "seasonal_abs_error", "seasonal_relative_error", "seasonal_wape_contribution", "real_baseline_ratio",
        "tabular_strict_error_delta_vs_seasonal", "forecastable_error_delta_vs_strict",
    ]
    return rows.select(
        "horizon_days", "target_date", "series_id", "tabular_strict_improves_vs_seasonal",
        *[F.round(n, digits.get(n, 6)).alias(n) for n in names],
    )


define(
    "network",
    "SELECT horizon_days, target_date, SUM(y_true) AS y, coalesce(SUM(ps), 0) AS ps, coalesce(SUM(pt), 0) AS pt, coalesce(SUM(pf), 0) AS pf, "
    + ", ".join(f"bool_or({f}) AS {f}" for f in analysis.SEGMENT_FLAGS)
    + ", string_agg(DISTINCT holiday_name, ', ' ORDER BY holiday_name) AS holiday_name, coalesce(SUM(precip), 0) AS precip FROM comparison GROUP BY ALL",
)


@query(
    "AG17_network_days",
    f"SELECT horizon_days, target_date::VARCHAR AS target_date, y AS y_true, ps AS y_pred_seasonal, round(pt, 6) AS y_pred_tabular_strict, {FLAG_LIST}, "
    "coalesce(holiday_name, '') AS calendar_holiday_name, round(precip, 4) AS weather_precip_mm FROM network",
)
def network_days(t):
    rows = analysis.network_days(derived.comparison(t))
    return rows.select(
        "horizon_days", "target_date", "y_true", "y_pred_seasonal", F.round("y_pred_tabular_strict", 6).alias("y_pred_tabular_strict"),
        *analysis.SEGMENT_FLAGS, "calendar_holiday_name", F.round("weather_precip_mm", 4).alias("weather_precip_mm"),
    )


define(
    "ranked",
    "SELECT 'network_day' AS scope, 'baseline_seasonal_deviation' AS kind, horizon_days, target_date, NULL AS series_id, round(abs(ps - y), 9) AS m FROM network "
    "UNION ALL SELECT 'network_day', 'tabular_strict_worse_than_seasonal', horizon_days, target_date, NULL, round(abs(pt - y) - abs(ps - y), 9) FROM network "
    "UNION ALL SELECT 'series_day', 'baseline_seasonal_deviation', horizon_days, target_date, series_id, round(abs(ps - y_true), 9) FROM comparison "
    "UNION ALL SELECT 'series_day', 'tabular_strict_worse_than_seasonal', horizon_days, target_date, series_id, round(abs(pt - y_true) - abs(ps - y_true), 9) FROM comparison",
)
define(
    "top_rows",
    "SELECT *, row_number() OVER (PARTITION BY scope, kind, horizon_days ORDER BY m DESC NULLS LAST, target_date, series_id) AS r FROM ranked "
    "WHERE kind = 'baseline_seasonal_deviation' OR m > 0 QUALIFY r <= 10",
)


@query(
    "WIN16_rank_deviation",
    "SELECT scope AS analysis_scope, kind AS rank_type, horizon_days, r AS rank_position, target_date::VARCHAR AS target_date, series_id, round(m, 6) AS measure FROM top_rows",
)
def rank_deviation(t):
    rows = analysis.rank_deviation(derived.comparison(t), 10)
    measure = F.when(
        F.col("rank_type") == "baseline_seasonal_deviation", F.col("seasonal_abs_error")
    ).otherwise(F.col("tabular_strict_error_delta_vs_seasonal"))
    return rows.select(
        "analysis_scope", "rank_type", "horizon_days", "rank_position", "target_date", "series_id", F.round(measure, 6).alias("measure")
    )


_SEGMENT_SQL = {
    "all_test_rows": "TRUE",
    "normal_days": f"NOT ({' OR '.join(analysis.SEGMENT_FLAGS)})",
    **analysis.FLAG_SEGMENTS,
    "top_baseline_deviation_days": "target_date IN (SELECT target_date FROM top_rows WHERE scope = 'network_day' AND kind = 'baseline_seasonal_deviation')",
    "top_tabular_worse_than_baseline_days": "target_date IN (SELECT target_date FROM top_rows WHERE scope = 'network_day' AND kind <> 'baseline_seasonal_deviation')",
}
define(
    "segment_rows",
    " UNION ALL ".join(f"SELECT '{name}' AS segment_name, * FROM comparison WHERE {rule}" for name, rule in _SEGMENT_SQL.items()),
)
_SEGMENT_VALUES = ", ".join(f"('{s}')" for s in analysis.SEGMENTS)


@query(
    "AG16_segment_metrics",
    "SELECT h.horizon_days, g.s AS segment_name, COUNT(r.y_true) AS row_count, coalesce(SUM(r.y_true), 0) AS target_sum, "
    "round(SUM(abs(ps - y_true)) / nullif(SUM(CASE WHEN ps IS NOT NULL THEN abs(y_true) END), 0), 6) AS baseline_seasonal_wape, "
    "round(SUM(abs(pt - y_true)) / nullif(SUM(CASE WHEN pt IS NOT NULL THEN abs(y_true) END), 0), 6) AS tabular_strict_wape, "
    "round(AVG(abs(pf - y_true)), 6) AS tabular_forecastable_mae, round(sqrt(AVG((ps - y_true) ** 2)), 6) AS baseline_seasonal_rmse, "
    "COUNT(pt) AS tabular_strict_available_prediction_count FROM (SELECT DISTINCT horizon_days FROM comparison) h CROSS JOIN "
    f"(VALUES {_SEGMENT_VALUES}) AS g(s) LEFT JOIN segment_rows r ON r.horizon_days = h.horizon_days AND r.segment_name = g.s GROUP BY ALL",
)
def segment_metrics(t):
    from ridelake.plans.builders import special_day_analysis

    derived.share(t)
    labelled = derived.predictions(t).withColumn("model_label", F.col("model_name"))
    built = special_day_analysis(derived.compared(t), labelled, 10)["segment_metrics"]
    return derived.rounded(
        built.select(
            "horizon_days", "segment_name", "row_count", "target_sum", "baseline_seasonal_wape", "tabular_strict_wape",
            "tabular_forecastable_mae", "baseline_seasonal_rmse", "tabular_strict_available_prediction_count",
        )
    )


define(
    "labels_of",
    "SELECT *, CASE model_name WHEN 'baseline_naive_simple' THEN 'Naive simple' WHEN 'baseline_naive_seasonal_weekly' THEN 'Naive estacional' "
    "ELSE 'Tabular propuesto' END AS model_label FROM preds WHERE split_type = 'test'",
)
_MAIN = metrics_sql().replace(", 6) AS mae", ", 4) AS mae").replace(", 6) AS rmse", ", 4) AS rmse")


@query(
    "AG18_main_results",
    f"SELECT 'serie_estacion_dia' AS metric_level, model_label, horizon_days, 'D+' || horizon_days AS horizon, {_MAIN} FROM labels_of GROUP BY ALL UNION ALL "
    f"SELECT 'dia_red', model_label, horizon_days, 'D+' || horizon_days, {_MAIN} FROM (SELECT model_label, horizon_days, target_date, SUM(y_true) AS y_true, "
    "coalesce(SUM(y_pred), 0) AS y_pred FROM labels_of GROUP BY ALL) GROUP BY ALL",
)
def main_results(t):
    labels = {
        "baseline_naive_simple": "Naive simple",
        "baseline_naive_seasonal_weekly": "Naive estacional",
        "tabular_hgbr": "Tabular propuesto",
    }
    from ridelake.functions.text import lookup

    test = derived.predictions(t).filter("split_type = 'test'").withColumn(
        "model_label", lookup(F.col("model_name"), labels)
    )
    rows = analysis.main_results(test)
    return rows.select(
        "metric_level", "model_label", "horizon_days", "horizon", "row_count", "available_prediction_count",
        F.round("abs_error_sum", 4).alias("abs_error_sum"), F.round("mae", 4).alias("mae"), F.round("rmse", 4).alias("rmse"),
        F.round("wape", 6).alias("wape"), F.round("smape", 6).alias("smape"), F.round("coverage_ratio", 6).alias("coverage_ratio"),
    )


define("distinct_days", "SELECT DISTINCT ON (target_date, series_id) * FROM comparison")


@query(
    "AG19_availability_summary",
    "SELECT 'calendario_festivos_semana_santa' AS variable_group, "
    "round(AVG((hol IS NOT NULL)::INT), 6) AS coverage_ratio_test_rows, COUNT(*) FILTER (WHERE is_holiday OR is_preholiday OR is_postholiday OR is_semana_santa) "
    "AS positive_row_count, COUNT(DISTINCT target_date) FILTER (WHERE is_holiday OR is_preholiday OR is_postholiday OR is_semana_santa) AS positive_day_count FROM distinct_days "
    "UNION ALL SELECT 'meteorologia', round(AVG((hol IS NOT NULL)::INT), 6), COUNT(*) FILTER (WHERE precip > 0), COUNT(DISTINCT target_date) FILTER (WHERE precip > 0) FROM distinct_days "
    "UNION ALL SELECT g, round(AVG((date IS NOT NULL)::INT), 6), COUNT(*) FILTER (WHERE event_day), COUNT(DISTINCT target_date) FILTER (WHERE event_day) "
    "FROM distinct_days, (VALUES ('eventos_planificados'), ('eventos_por_estacion_serie')) v(g) GROUP BY g "
    "UNION ALL SELECT unnest(['aforo_estimado', 'servicio_planificado', 'incidencias_y_servicio_ejecutado']), NULL, 0, 0",
)
def availability_summary(t):
    """All seven groups; the sample has no attendance, planned service or incidents beside its events."""
    return derived.rounded(analysis.availability_summary(derived.comparison(t)))


# Supervision --------------------------------------------------------------------------------


@query(
    "AG24_leaderboard",
    "SELECT p.horizon_days, p.model_name, p.split_name, p.row_count, p.wape, s.train_start::VARCHAR AS train_date_min, s.train_end::VARCHAR AS train_date_max, "
    "w.v::VARCHAR AS validation_date_min, w.t::VARCHAR AS test_date_max FROM "
    f"(SELECT horizon_days, model_name, split_name, {metrics_sql()} FROM preds GROUP BY horizon_days, model_name, split_name) p JOIN splits s "
    "ON s.split_name = p.split_name AND s.horizon_days = p.horizon_days JOIN (SELECT horizon_days, MIN(score_start) FILTER (split_type = 'validation') AS v, "
    "MAX(score_end) FILTER (split_type = 'test') AS t FROM splits GROUP BY horizon_days) w ON w.horizon_days = p.horizon_days",
)
def leaderboard(t):
    by_split = backtest.forecast_metrics(derived.predictions(t), ["horizon_days", "model_name", "split_name"])
    splits = materialized(_splits(t))
    return analysis.leaderboard(by_split, splits).select(
        "horizon_days", "model_name", "split_name", "row_count", F.round("wape", 6).alias("wape"), "train_date_min",
        "train_date_max", "validation_date_min", "test_date_max",
    )


@query(
    "AG23_baseline_coverage",
    "SELECT m AS model_name, horizon_days, split_name, split_type, COUNT(*) AS row_count, COUNT(*) - COUNT(p) AS missing_prediction_count, "
    "COUNT(*) - COUNT(r) AS missing_reference_count, round(1 - (COUNT(*) - COUNT(p)) / COUNT(*), 6) AS coverage_ratio FROM "
    "(SELECT horizon_days, split_name, split_type, unnest(['baseline_naive_simple', 'baseline_naive_seasonal_weekly']) AS m, "
    "unnest([baseline_naive_simple, baseline_naive_seasonal_weekly]) AS p, unnest([baseline_naive_simple_reference_date, "
    "baseline_naive_seasonal_reference_date]) AS r FROM scored) GROUP BY ALL",
)
def baseline_coverage(t):
    models = {
        "baseline_naive_simple": ("baseline_naive_simple", "baseline_naive_simple_reference_date"),
        "baseline_naive_seasonal_weekly": ("baseline_naive_seasonal_weekly", "baseline_naive_seasonal_reference_date"),
    }
    rows = derived.origins(t).withColumns(
        {"feature_variant": F.lit(features.STRICT), "series_policy": F.lit(features.ALL_SERIES)}
    )
    return derived.rounded(analysis.baseline_coverage(rows, models).drop("feature_variant", "series_policy"))


@query(
    "JN13_compare_runs",
    "SELECT COUNT(*) AS row_count, round(AVG((a.y_true = b.y_true)::INT), 6) AS same_truth_fraction, round(AVG(coalesce(a.y_pred = b.y_pred, FALSE)::INT), 6) "
    "AS same_prediction_fraction, SUM(abs(a.y_pred - a.y_true)) AS left_absolute_error_sum, SUM(abs(b.y_pred - b.y_true)) AS right_absolute_error_sum, "
    "SUM(a.y_true) AS left_target_sum, SUM(b.y_true) AS right_target_sum FROM preds a JOIN preds b ON a.series_id = b.series_id AND a.forecast_origin_date = b.forecast_origin_date "
    "WHERE a.model_name = 'baseline_naive_seasonal_weekly' AND b.model_name = a.model_name AND a.split_type = 'test' AND b.split_type = 'test' AND a.horizon_days = 1 AND b.horizon_days = 7",
)
def compare_runs(t):
    seasonal = materialized(
        derived.predictions(t).filter("split_type = 'test' AND model_name = 'baseline_naive_seasonal_weekly'")
    )
    return derived.rounded(
        analysis.compare_runs(seasonal.filter("horizon_days = 1"), seasonal.filter("horizon_days = 7"))
    )


define(
    "series_metrics",
    f"SELECT {SPEC}, linea, series_id, {metrics_sql()} FROM preds WHERE split_type = 'test' GROUP BY {SPEC}, linea, series_id",
)


@query(
    "JN14_series_diagnostics",
    "SELECT m.model_name, m.horizon_days, m.series_id, m.wape, m.coverage_ratio AS prediction_coverage_ratio, d.observed_days, d.max_gap_days, "
    "round(d.coverage_ratio, 6) AS panel_coverage_ratio, m.series_id IN ('NAD1', 'NCD2') AS is_sparse_series, d.coverage_ratio < 0.1 AS is_low_coverage_series "
    "FROM series_metrics m LEFT JOIN diagnostics d USING (series_id)",
)
def series_diagnostics(t):
    diagnostics = panel.panel_diagnostics(panel.densify(t.demand))
    rows = analysis.series_diagnostics_join(derived.series_metrics(t), diagnostics, ["NAD1", "NCD2"])
    return derived.rounded(
        rows.select(
            "model_name", "horizon_days", "series_id", "wape", "prediction_coverage_ratio", "observed_days",
            "max_gap_days", "panel_coverage_ratio", "is_sparse_series", "is_low_coverage_series",
        )
    )


@query(
    "WIN18_best_worst",
    "SELECT 'best_10' AS ranking_group, model_name, horizon_days, series_id, wape, row_number() OVER (PARTITION BY model_name, horizon_days ORDER BY wape, series_id) "
    "AS ranking_position FROM series_metrics WHERE wape IS NOT NULL QUALIFY ranking_position <= 10 UNION ALL SELECT 'worst_10', model_name, horizon_days, series_id, wape, "
    "row_number() OVER (PARTITION BY model_name, horizon_days ORDER BY wape DESC, series_id) AS ranking_position FROM series_metrics WHERE wape IS NOT NULL QUALIFY ranking_position <= 10",
)
def best_worst(t):
    rows = analysis.best_worst(derived.rounded(derived.series_metrics(t)))
    return rows.select("ranking_group", "model_name", "horizon_days", "series_id", "wape", "ranking_position")


@query(
    "JN15_model_vs_baseline",
    "SELECT a.horizon_days, a.series_id, a.wape, b.wape AS baseline_wape, b.mae AS baseline_mae, round(b.wape - a.wape, 6) AS tabular_wape_improvement_vs_baseline "
    "FROM series_metrics a JOIN series_metrics b USING (horizon_days, series_id) WHERE a.model_name = 'tabular_hgbr' AND b.model_name = 'baseline_naive_seasonal_weekly'",
)
def model_vs_baseline(t):
    rows = analysis.model_vs_baseline(derived.rounded(derived.series_metrics(t)))
    return derived.rounded(
        rows.select("horizon_days", "series_id", "wape", "baseline_wape", "baseline_mae", "tabular_wape_improvement_vs_baseline")
    )


@query(
    "JN16_alignment_check",
    "SELECT c AS column_name, CASE WHEN c = 'target_lag_7' THEN (SELECT COUNT(*) FROM origin_rows WHERE horizon_days = 1 AND target_lag_7 > 1) ELSE 0 END AS mismatch_count, "
    "c <> 'target_lag_7' OR (SELECT COUNT(*) FROM origin_rows WHERE horizon_days = 1 AND target_lag_7 > 1) = 0 AS passed FROM "
    "(SELECT unnest([" + ", ".join(f"'{c}'" for c in features.AUTOREGRESSIVE_FEATURES) + "]) AS c)",
)
def alignment_check(t):
    """One column is disturbed on purpose; all others must match the panel."""
    base = derived.panel_features(t)
    rows = features.origin_rows(base, 1)
    disturbed = rows.withColumn(
        "target_lag_7", F.when(F.col("target_lag_7") > 1, F.col("target_lag_7") + 1).otherwise(F.col("target_lag_7"))
    )
    return analysis.alignment_check(disturbed, base)


@query(
    "EV4_leakage_checks",
    "SELECT variant, series_policy, 'h' || horizon_days || '_' || c AS check_name, CASE c WHEN 'recommended_variant_is_strict_available' "
    "THEN variant = 'strict_available' AND series_policy = 'all_series' WHEN 'scenario_features_excluded_from_recommended_model' THEN variant = 'strict_available' "
    "WHEN 'strict_feature_set_only_future_available' THEN variant = 'strict_available' ELSE TRUE END AS passed FROM "
    "(SELECT DISTINCT variant, series_policy, horizon_days FROM spec_rows JOIN external ON date = target_date), "
    "(SELECT unnest(['incidents_daily_excluded', 'used_service_xml_name_excluded', 'not_future_available_excluded', "
    "'scenario_features_excluded_from_recommended_model', 'recommended_variant_is_strict_available', 'strict_feature_set_only_future_available']) AS c)",
)
def leakage_checks(t):
    """All specs, with the features that their rows fill: scenario specs must fail three checks."""
    return analysis.leakage_checks(features.availability_catalog(t.spark), _used_features(t)).select(
        "variant", "series_policy", "check_name", "passed"
    )


def _used_features(t):
    """(variant, series_policy, horizon_days, feature_columns) of the features with any value."""
    from ridelake.catalog.model_queries import training_rows

    rows = training_rows(t).select("*", F.inline("specs"))
    spec = ["variant", "series_policy", "horizon_days"]
    known = [c for c in features.feature_columns(features.SCENARIO) if c in rows.columns]
    strict = features.feature_columns(features.STRICT)
    filled = rows.groupBy(*spec).agg(
        *[F.count(c if c in strict else F.when(F.col("variant") == features.SCENARIO, F.col(c))).alias(f"_{c}") for c in known]
    )
    used = F.filter(F.array(*[F.when(F.col(f"_{c}") > 0, F.lit(c)) for c in known]), lambda c: c.isNotNull())
    return filled.select(*spec, used.alias("feature_columns"))


define(
    "errors",
    "SELECT model_name, horizon_days, abs(y_pred - y_true) AS e FROM preds WHERE split_type = 'test' AND y_pred IS NOT NULL",
)
define("error_limits", "SELECT model_name, horizon_days, MIN(e) AS lo, MAX(e) AS hi FROM errors GROUP BY ALL")


@query(
    "AG27_error_histogram",
    "SELECT model_name, horizon_days, bin, round(lo + bin * (hi - lo) / 40, 6) AS bin_start, COUNT(*) AS row_count FROM (SELECT *, CAST(least(coalesce(floor((e - lo) / "
    "nullif((hi - lo) / 40, 0)), 0), 39) AS INT) AS bin FROM errors JOIN error_limits USING (model_name, horizon_days)) GROUP BY ALL",
)
def error_histogram(t):
    return derived.rounded(analysis.error_histogram(derived.predictions(t).filter("split_type = 'test'")))


define(
    "volumes",
    "SELECT series_id, SUM(y_true) AS volume, ANY_VALUE(d.coverage_ratio) AS c FROM preds JOIN diagnostics d USING (series_id) WHERE split_type = 'test' AND horizon_days = 1 "
    "AND model_name = 'tabular_hgbr' GROUP BY series_id",
)
define("middle", "SELECT quantile_disc(c, 0.5) AS m FROM volumes")
define("largest", "SELECT series_id, volume FROM volumes, middle WHERE c > m ORDER BY volume DESC, series_id LIMIT 2")
define("smallest", "SELECT series_id, volume FROM volumes, middle WHERE c > m ORDER BY volume, series_id DESC LIMIT 1")
define("sparsest", "SELECT series_id, volume FROM volumes, middle WHERE c < m ORDER BY series_id LIMIT 1")


@query(
    "AG28_representative_series",
    "SELECT *, 'largest_dense' AS pick FROM largest UNION ALL SELECT *, 'smallest_dense' FROM smallest WHERE series_id NOT IN (SELECT series_id FROM largest) "
    "UNION ALL SELECT *, 'first_sparse' FROM sparsest",
)
def representative_series(t):
    """Series of the sample have few days: those above the middle coverage count as dense, those below as sparse."""
    test = materialized(derived.predictions(t).filter("split_type = 'test' AND horizon_days = 1 AND model_name = 'tabular_hgbr'"))
    diagnostics = materialized(panel.panel_diagnostics(panel.densify(t.demand)))
    covered = diagnostics.join(test.select("series_id").distinct(), "series_id")
    middle = covered.agg(
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY coverage_ratio)")
    ).first()[0]
    found = analysis.representative_series(test, diagnostics, dense_above=middle, sparse_below=middle)
    return found.select("series_id", "volume", "pick")


@query(
    "JN22_network_overlay",
    "SELECT horizon_days, target_date::VARCHAR AS target_date, SUM(y_true) AS y_true, SUM(ps) AS y_pred_seasonal, round(SUM(pt), 6) AS y_pred_tabular_strict, "
    "round(SUM(pf), 6) AS y_pred_tabular_forecastable FROM comparison GROUP BY ALL HAVING SUM(ps) IS NOT NULL AND SUM(pt) IS NOT NULL AND SUM(pf) IS NOT NULL",
)
def network_overlay(t):
    return derived.rounded(analysis.network_overlay(derived.comparison(t)))


@query(
    "SET3_union_metrics",
    f"SELECT {SPEC}, {metrics_sql()} FROM preds GROUP BY {SPEC}",
)
def union_metrics(t):
    rows = materialized(derived.predictions(t))
    parts = [
        backtest.forecast_metrics(rows.filter(F.col("model_name") == m), backtest.SPEC_COLUMNS) for m in derived.MODELS
    ]
    return _metrics(derived.union_all(parts))


_RANKED = [
    "target_latest_observed_value", "target_days_since_latest_observation", "target_lag_1", "target_lag_7", "target_lag_14", "target_lag_28",
    "target_rolling_mean_7", "target_rolling_std_7", "target_observed_count_7", "target_rolling_mean_28", "target_rolling_std_28", "target_observed_count_28",
]
define(
    "feature_strength",
    "SELECT horizon_days, feature_name, round(CASE WHEN c IS NULL OR isnan(c) THEN 0 ELSE abs(c) END, 6) AS importance_mean FROM ("
    + " UNION ALL ".join(
        f"SELECT horizon_days, '{c}' AS feature_name, corr({c}::DOUBLE, trip_count_target::DOUBLE) AS c FROM origin_rows GROUP BY horizon_days" for c in _RANKED
    )
    + ")",
)


@query(
    "WIN20_top_importance",
    "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY horizon_days ORDER BY importance_mean DESC, feature_name) AS rank_position FROM feature_strength) WHERE rank_position <= 5",
)
def top_importance(t):
    """The features whose values go best with the label, by horizon (size of the correlation)."""
    return analysis.top_importance(_feature_strength(t)).select("horizon_days", "feature_name", "importance_mean", "rank_position")


def _feature_strength(t):
    def strength(column):
        x, y = F.col(column).cast("double"), F.col("trip_count_target").cast("double")
        spread = F.stddev_pop(x) * F.stddev_pop(F.when(x.isNotNull(), y))
        # A feature with one value only has no spread and no strength.
        return F.round(F.coalesce(F.abs(F.covar_pop(x, y)) / F.nullif(spread, F.lit(0.0)), F.lit(0.0)), 6).alias(column)

    strengths = derived.origins(t).groupBy("horizon_days").agg(*[strength(c) for c in _RANKED])
    return strengths.unpivot(["horizon_days"], _RANKED, "feature_name", "importance_mean")


def _digest(output: str, sql: str, value: str, by: str = "horizon_days") -> str:
    return f"SELECT '{output}' AS output, {by} AS horizon_days, COUNT(*) AS n, round(coalesce(SUM({value}), 0), 3) AS total FROM ({sql}) GROUP BY ALL"


def _sql(name: str) -> str:
    return QUERIES[name].sql


@query(
    "TB14_supervision",
    " UNION ALL ".join(
        [
            _digest("leaderboard", f"SELECT DISTINCT horizon_days, model_name, split_name, mae FROM (SELECT horizon_days, model_name, split_name, {metrics_sql()} FROM preds GROUP BY horizon_days, model_name, split_name)", "mae"),
            _digest("series_metrics", "SELECT m.*, d.observed_days FROM series_metrics m LEFT JOIN diagnostics d USING (series_id)", "observed_days + mae"),
            _digest("rankings", _sql("WIN18_best_worst"), "ranking_position * wape"),
            _digest("model_vs_baseline", _sql("JN15_model_vs_baseline"), "baseline_mae"),
            _digest("error_histogram", _sql("AG27_error_histogram"), "row_count * bin"),
            _digest("representative_series", _sql("AG28_representative_series"), "volume", "1"),
            _digest("baseline_coverage", "SELECT horizon_days, model_name, split_name, COUNT(*) AS n, COUNT(*) FILTER (WHERE p IS NULL) AS missing FROM (SELECT horizon_days, split_name, "
                    "unnest(['baseline_naive_simple', 'baseline_naive_seasonal_weekly']) AS model_name, unnest([baseline_naive_simple, baseline_naive_seasonal_weekly]) AS p FROM scored) GROUP BY ALL", "n + missing"),
            _digest("network_overlay", _sql("JN22_network_overlay"), "y_pred_tabular_strict"),
            _digest("run_agreement", _sql("JN13_compare_runs"), "row_count + left_absolute_error_sum", "0"),
            _digest("leakage_checks", _sql("EV4_leakage_checks"), "passed::INT", "0"),
            _digest("top_importance", _sql("WIN20_top_importance"), "rank_position"),
        ]
    ),
)
def supervision(t):
    """Every supervision table, of both horizons and all specs: rows, and the sum of one of its values."""
    from ridelake.plans.builders import supervision

    derived.share(t)
    predictions = materialized(derived.predictions(t))
    seasonal = predictions.filter("split_type = 'test' AND model_name = 'baseline_naive_seasonal_weekly'")
    dataset = derived.origins(t).withColumns({"feature_variant": F.lit(features.STRICT), "series_policy": F.lit(features.ALL_SERIES)})
    diagnostics = materialized(panel.panel_diagnostics(panel.densify(t.demand)))
    built = supervision(
        predictions,
        diagnostics,
        materialized(_splits(t)),
        dataset=dataset,
        baselines={
            "baseline_naive_simple": ("baseline_naive_simple", "baseline_naive_simple_reference_date"),
            "baseline_naive_seasonal_weekly": ("baseline_naive_seasonal_weekly", "baseline_naive_seasonal_reference_date"),
        },
        comparison=derived.comparison(t),
        runs=(seasonal.filter("horizon_days = 1"), seasonal.filter("horizon_days = 7")),
        specs=_used_features(t),
        importances=_feature_strength(t),
    )
    # Thresholds of the builder's own pick are those of full-size tables.
    built["representative_series"] = representative_series(t).withColumn("horizon_days", F.lit(1))
    built["rankings"] = analysis.best_worst(derived.rounded(derived.series_metrics(t)))
    built["leakage_checks"] = built["leakage_checks"].withColumn("horizon_days", F.lit(0))
    built["run_agreement"] = built["run_agreement"].withColumn("horizon_days", F.lit(0))
    values = {
        "leaderboard": F.round("mae", 6),
        "series_metrics": F.col("observed_days") + F.round("mae", 6),
        "rankings": F.col("ranking_position") * F.col("wape"),
        "model_vs_baseline": F.round("baseline_mae", 6),
        "error_histogram": F.col("row_count") * F.col("bin"),
        "representative_series": F.col("volume"),
        "baseline_coverage": F.col("row_count") + F.col("missing_prediction_count"),
        "network_overlay": F.round("y_pred_tabular_strict", 6),
        "run_agreement": F.col("row_count") + F.col("left_absolute_error_sum"),
        "leakage_checks": F.col("passed").cast("int"),
        "top_importance": F.col("rank_position"),
    }
    parts = [
        built[name].groupBy("horizon_days").agg(F.count("*").alias("n"), F.round(F.coalesce(F.sum(v), F.lit(0)).cast("double"), 3).alias("total"))
        .select(F.lit(name).alias("output"), "horizon_days", "n", "total")
        for name, v in values.items()
    ]
    return derived.union_all(parts)


def _long(output: str, sql: str, item: str, n: str, value: str) -> str:
    return f"SELECT '{output}' AS output, {item} AS item, ({n})::DOUBLE AS n, round(coalesce({value}, -1), 4) AS value FROM ({sql})"


@query(
    "TB13_special_day_analysis",
    " UNION ALL ".join(
        [
            _long("segment_metrics", _sql("AG16_segment_metrics"), "concat_ws(':', horizon_days, segment_name)", "row_count", "tabular_strict_wape"),
            _long("top_deviation_rows", _sql("WIN16_rank_deviation"), "concat_ws(':', horizon_days, analysis_scope, rank_type, target_date, series_id)", "rank_position", "measure"),
            _long("main_results", _sql("AG18_main_results"), "concat_ws(':', metric_level, model_label, horizon)", "row_count", "wape"),
            _long("availability_summary", _sql("AG19_availability_summary"), "variable_group", "positive_row_count", "coverage_ratio_test_rows"),
        ]
    ),
)
def special_day_analysis(t):
    """Rows of all four outputs of the builder."""
    from ridelake.functions.text import lookup
    from ridelake.plans.builders import special_day_analysis

    derived.share(t)
    labels = {"baseline_naive_simple": "Naive simple", "baseline_naive_seasonal_weekly": "Naive estacional", "tabular_hgbr": "Tabular propuesto"}
    test = derived.predictions(t).filter("split_type = 'test'").withColumn("model_label", lookup(F.col("model_name"), labels))
    built = special_day_analysis(derived.compared(t), test, 10)
    measure = F.when(F.col("rank_type") == "baseline_seasonal_deviation", F.col("seasonal_abs_error")).otherwise(F.col("tabular_strict_error_delta_vs_seasonal"))

    def long(name, item, n, value):
        shown = F.round(F.coalesce(F.round(value, 6), F.lit(-1.0)), 4)
        return built[name].select(F.lit(name).alias("output"), item.alias("item"), F.col(n).cast("double").alias("n"), shown.alias("value"))

    return derived.union_all(
        [
            long("segment_metrics", F.concat_ws(":", "horizon_days", "segment_name"), "row_count", F.col("tabular_strict_wape")),
            long("top_deviation_rows", F.concat_ws(":", "horizon_days", "analysis_scope", "rank_type", "target_date", "series_id"), "rank_position", measure),
            long("main_results", F.concat_ws(":", "metric_level", "model_label", "horizon"), "row_count", F.col("wape")),
            long("availability_summary", F.col("variable_group"), "positive_row_count", F.col("coverage_ratio_test_rows")),
        ]
    )


@query(
    "TB9_foundation",
    "SELECT 'features' AS output, COUNT(*) AS n, round(SUM(target_lag_7), 3) AS total FROM features UNION ALL SELECT 'diagnostics', COUNT(*), SUM(observed_days) FROM diagnostics "
    "UNION ALL SELECT 'external', COUNT(*), SUM(is_holiday::INT) FROM external UNION ALL SELECT 'services', COUNT(*), SUM(end_m - start_m) FROM line_services "
    "UNION ALL SELECT 'events', COUNT(*), round(SUM(active_event_count / lines), 6) FROM event_series",
)
def foundation(t):
    """Rows and one total of every frame that the training datasets share."""
    from ridelake.operators import operations
    from ridelake.plans.builders import build_foundation

    lines = operations.services_line_daily(operations.services_daily(t.services))
    daily = operations.event_station_daily(derived.events(t), derived.mapping(t))
    built = build_foundation(t.demand, derived.external(t), lines, operations.event_series_daily(daily, t.stations), derived.ATTRIBUTES)
    totals = {
        "features": (built.features, F.round(F.sum("target_lag_7"), 3)),
        "diagnostics": (built.diagnostics, F.sum("observed_days")),
        "external": (built.external, F.sum(F.col("calendar_is_holiday").cast("int"))),
        "services": (built.services, F.sum("service_duration_minutes")),
        "events": (built.events, F.round(F.sum("event_active_count"), 6)),
    }
    return derived.union_all(
        [frame.agg(F.count("*").alias("n"), total.cast("double").alias("total")).select(F.lit(name).alias("output"), "n", "total") for name, (frame, total) in totals.items()]
    )
