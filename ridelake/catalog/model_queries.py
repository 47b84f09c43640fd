"""Tabular models of all specs: fits, back-test, promotion, importance and scenario scores.

Fits have no SQL twin; the first splits of the first trees, the rows that are fitted on and all
that follows from stored predictions have.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ridelake.catalog import derived
from ridelake.catalog.registry import define, query
from ridelake.operators import backtest, features, models, panel
from ridelake.operators.boosting import TreeSettings
from ridelake.operators.scale import materialized
from ridelake.plans import builders
from ridelake.session import shared_folder

SETTINGS = TreeSettings()
SAMPLE_SCENARIO_START = "1996-01-01"
SAMPLE_SPARSE = ["NAD1", "NCD2"]


def training_rows(t):
    """Training rows of all eight specs."""
    external = features.external_features(derived.external(t))
    return materialized(
        features.training_rows(
            derived.panel_features(t), external, scenario_start=SAMPLE_SCENARIO_START, sparse_series=SAMPLE_SPARSE
        )
    )


def _stored(t, rows, specs=None):
    """Models of all splits, written to a store and read again."""
    path = f"{shared_folder(t.spark)}/models-{uuid.uuid4().hex}"
    models.save_models(models.fit_models(rows if specs is None else specs, SETTINGS), path)
    return models.load_models(t.spark, path)


define(
    "spec_rows",
    "SELECT o.*, variant, series_policy FROM origin_rows o, (VALUES ('strict_available'), ('forecastable_scenario')) v(variant), "
    "(VALUES ('all_series'), ('sparse_excluded')) p(series_policy) WHERE (variant = 'strict_available' OR target_date >= DATE '1996-01-01') "
    "AND (series_policy = 'all_series' OR series_id NOT IN ('NAD1', 'NCD2'))",
)
define(
    "spec_splits",
    "SELECT * EXCLUDE (lo, ts), lo AS train_start, coalesce(ts - 56 * (4 - f), ts) - 1 AS train_end, coalesce('validation_fold_' || f, 'test') AS split_name "
    "FROM (SELECT variant, series_policy, horizon_days, MIN(forecast_origin_date) AS lo, MAX(forecast_origin_date) - 179 AS ts FROM spec_rows GROUP BY ALL), "
    "(VALUES (1), (2), (3), (NULL)) AS k(f)",
)
define(
    "fit_rows",
    "SELECT * FROM (SELECT r.*, split_name, row_number() OVER (PARTITION BY r.variant, r.series_policy, r.horizon_days, split_name "
    "ORDER BY md5(series_id || '|' || forecast_origin_date::VARCHAR), series_id, forecast_origin_date) AS i "
    "FROM spec_rows r JOIN spec_splits s ON r.variant = s.variant AND r.series_policy = s.series_policy AND r.horizon_days = s.horizon_days "
    "AND forecast_origin_date BETWEEN train_start AND train_end) WHERE i <= 1000",
)
_MODEL = "variant, series_policy, horizon_days, split_name"


@query(
    "TB10_training_rows_all_specs",
    "SELECT variant, series_policy, horizon_days, COUNT(*) AS row_count, COUNT(DISTINCT series_id) AS series_count, MIN(forecast_origin_date)::VARCHAR AS origin_min, "
    "MAX(target_date)::VARCHAR AS target_max, SUM(trip_count_target) AS target_sum, COUNT(baseline_naive_seasonal_weekly) AS seasonal_count, "
    "round(SUM(target_rolling_mean_28), 4) AS mean_sum, COUNT(x.date) AS calendar_count FROM spec_rows o LEFT JOIN external x ON x.date = o.target_date GROUP BY ALL",
)
def training_rows_all_specs(t):
    """All eight training datasets from one panel pass, told apart by ``specs``."""
    return training_rows(t).select("*", F.inline("specs")).groupBy(*models.SPEC).agg(
        F.count("*").alias("row_count"),
        F.countDistinct("series_id").alias("series_count"),
        F.min("forecast_origin_date").alias("origin_min"),
        F.max("target_date").alias("target_max"),
        F.sum("trip_count_target").alias("target_sum"),
        F.count("baseline_naive_seasonal_weekly").alias("seasonal_count"),
        F.round(F.sum("target_rolling_mean_28"), 4).alias("mean_sum"),
        F.count("calendar_is_weekend").alias("calendar_count"),
    )


@query(
    "ML2_fitting_rows",
    f"SELECT {_MODEL}, COUNT(*) AS row_count, SUM(trip_count_target) AS target_sum, MAX(md5(series_id || '|' || forecast_origin_date::VARCHAR)) AS last_hash, "
    f"MAX(forecast_origin_date)::VARCHAR AS newest FROM fit_rows GROUP BY ALL",
)
def fittingtraining_rows(t):
    """The bounded labelled rows of every spec and split."""
    chosen = models.fitting_rows(training_rows(t), 1000)
    return chosen.groupBy(*models.SPEC, "split_name").agg(
        F.count("*").alias("row_count"),
        F.sum("trip_count_target").alias("target_sum"),
        F.max(models.key_hash(*models.KEY)).alias("last_hash"),
        F.max("forecast_origin_date").alias("newest"),
    )


_SPLIT_FEATURES = [
    "target_lag_1", "target_lag_7", "target_lag_28", "target_latest_observed_value", "target_observed_count_7",
    "target_observed_count_28", "target_rolling_mean_7",
]
_SIDE = "power({n} * mean - {s}, 2) / ({n} * mean + 0.0141275)"
define(
    "split_values",
    f"SELECT {_MODEL}, feature, value, COUNT(*) AS n, SUM(y) AS s FROM (SELECT {_MODEL}, trip_count_target AS y, unnest({_SPLIT_FEATURES}) AS feature, "
    f"unnest([{', '.join(_SPLIT_FEATURES)}]::DOUBLE[]) AS value FROM fit_rows) GROUP BY ALL",
)
define(
    "split_sides",
    f"SELECT v.*, mean, total, whole, SUM(n) OVER w AS ln, SUM(s) OVER w AS ls, coalesce(mn, 0) AS mn, coalesce(ms, 0) AS ms FROM split_values v "
    f"JOIN (SELECT {_MODEL}, COUNT(*) AS total, SUM(trip_count_target) AS whole, avg(trip_count_target) AS mean FROM fit_rows GROUP BY ALL) USING ({_MODEL}) "
    f"LEFT JOIN (SELECT {_MODEL}, feature, n AS mn, s AS ms FROM split_values WHERE value IS NULL) USING ({_MODEL}, feature) "
    f"WHERE value IS NOT NULL WINDOW w AS (PARTITION BY {_MODEL}, feature ORDER BY value)",
)


@query(
    "ML1_first_splits",
    f"SELECT {_MODEL}, total AS n_rows, round(ln(any_value(mean)), 6) AS base, round(MAX(gain), 5) AS gain FROM (SELECT *, "
    f"{_SIDE.format(n='an', s='a')} + {_SIDE.format(n='(total - an)', s='(whole - a)')} AS gain FROM "
    f"(SELECT {_MODEL}, mean, total, whole, ln AS an, ls AS a FROM split_sides UNION ALL SELECT {_MODEL}, mean, total, whole, ln + mn, ls + ms FROM split_sides "
    f"UNION ALL SELECT DISTINCT {_MODEL}, mean, total, whole, c.n, c.s FROM split_sides JOIN (SELECT {_MODEL}, series_id, COUNT(*) AS n, SUM(trip_count_target) AS s "
    f"FROM fit_rows GROUP BY ALL) c USING ({_MODEL})) WHERE an >= 22 AND total - an >= 22) GROUP BY ALL",
)
def first_splits(t):
    """Gain of the first split of every model, over its series and the features of its history."""
    columns = [*models.KEY, "horizon_days", "specs", "trip_count_target", *_SPLIT_FEATURES]
    exact = TreeSettings(iterations=1, depth=1, bins=1_000_000, patience=0)
    nodes = models.fit_models(training_rows(t).select(*columns), exact, limit=1000)
    grown = nodes.groupBy(*models.SPEC, "split_name").agg(
        F.max(F.when(F.col("tree") == -1, F.col("n_rows"))).alias("n_rows"),
        F.round(F.max(F.when(F.col("tree") == -1, F.col("value"))), 6).alias("base"),
        F.round(F.max("gain"), 5).alias("gain"),
    )
    return grown


@query("ML1_ML2_backtest")
def run_backtest(t):
    """Metrics of one spec's model and of the seasonal baseline on the same rows."""
    rows = training_rows(t)
    one = rows.filter("horizon_days = 7").withColumn("specs", models.spec_columns(features.STRICT))
    predictions = materialized(models.run_backtest(_stored(t, one), one))
    own = predictions.select("model_name", "split_name", "split_type", "y_true", "y_pred")
    seasonal = predictions.select(
        F.lit("baseline_naive_seasonal_weekly").alias("model_name"), "split_name", "split_type", "y_true",
        F.col("baseline_naive_seasonal_weekly").alias("y_pred"),
    )
    return backtest.forecast_metrics(own.unionByName(seasonal), ["model_name", "split_name", "split_type"])


@query("ML3_train_all_specs")
def train_all_specs(t):
    """Metrics of all eight training specs on all four splits."""
    rows = training_rows(t)
    predictions = models.run_backtest(_stored(t, rows), rows)
    return backtest.forecast_metrics(predictions, [*backtest.SPEC_COLUMNS, "split_name", "split_type"])


def _promoted(t, rows):
    """Models that the policy decision promotes, read from the store."""
    strict = rows.withColumn("specs", F.filter("specs", lambda s: s["variant"] == features.STRICT))
    stored = _stored(t, strict)
    decision = models.policy_of(materialized(models.run_backtest(stored, strict)))
    return models.promoted_models(stored, materialized(decision))


@query("ML4_permutation_importance")
def permutation_importance(t):
    """Importances of all features of the promoted models on their test rows."""
    rows = training_rows(t)
    promoted = materialized(_promoted(t, rows))
    tested = models.scored_rows(rows).filter("split_type = 'test'")
    specs = F.broadcast(promoted.select(*models.SPEC).distinct())
    return models.permutation_importance(promoted, materialized(tested.join(specs, models.SPEC)))


@query("ML5_smoke_inference")
def smoke_inference(t):
    """Predictions of the newest origins by the promoted models, not clipped."""
    rows = training_rows(t)
    return models.smoke_inference(rows, materialized(_promoted(t, rows)))


@query("ML6_scenario_inference")
def scenario_inference(t):
    """Scored rows of all scenario days and series without a stored prediction."""
    rows = training_rows(t)
    one = rows.filter("horizon_days = 1").withColumn("specs", models.spec_columns(features.STRICT))
    stored = _stored(t, one).filter("split_type = 'test'")
    history = t.demand.select(
        "series_id", F.col("service_date").alias("observed_date"), F.col("trip_count").cast("double").alias("observed_target_value")
    )
    latest = panel.latest_per_series(
        t.demand.select("series_id", F.col("service_date").alias("target_date"), "linea", "estacion", "station_abbrev")
    ).drop("target_date")
    covered = t.demand.select(F.col("service_date").alias("target_date"), "series_id")
    wanted = builders.scenario_feature_rows(t.scenarios, latest, history, 1, covered=covered)
    return models.scenario_inference(stored, wanted)
