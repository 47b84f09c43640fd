"""Composite tables: chains of operators that each yield one lazy plan per output."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridelake.functions import domain, times
from ridelake.operators import (
    analysis,
    backtest,
    calendar,
    demand,
    drift,
    features,
    operations,
    panel,
    scenario,
)
from ridelake.operators.quality import Contract
from ridelake.operators.scale import materialized
from ridelake.sources import writers

# Contracts of the operational outputs.
OPERATIONAL_CONTRACTS = {
    "services_history_daily": Contract("services_history_daily", unique_key=("service_date",)),
    "services_line_daily": Contract("services_line_daily", unique_key=("service_date", "linea")),
    "events_normalized": Contract("events_normalized", unique_key=("event_id",)),
    "events_location_mapping": Contract("events_location_mapping"),
    "events_station_impact": Contract("events_station_impact", unique_key=("event_id", "station_abbrev")),
    "events_station_daily": Contract("events_station_daily", unique_key=("service_date", "station_abbrev")),
    "events_series_daily": Contract("events_series_daily", unique_key=("service_date", "linea", "estacion")),
    "events_mapping_report": Contract("events_mapping_report", grain="report"),
    "incidents_normalized": Contract("incidents_normalized", unique_key=("incident_id",)),
    "incidents_daily": Contract("incidents_daily"),
    "incidents_mapping_report": Contract("incidents_mapping_report", grain="report"),
}


def build_operational_datasets(
    services: DataFrame, events: DataFrame, locations: DataFrame, incidents: DataFrame, stations: DataFrame
) -> dict[str, DataFrame]:
    """All operational tables, by name."""
    daily = operations.services_daily(services)
    normalized = operations.events_normalized(events)
    mapping = operations.event_location_mapping(locations, stations)
    station_daily = operations.event_station_daily(normalized, mapping)
    incident_rows = operations.incidents_normalized(incidents, stations)
    return {
        "services_history_daily": daily,
        "services_line_daily": operations.services_line_daily(daily),
        "events_normalized": normalized,
        "events_location_mapping": mapping,
        "events_station_impact": operations.event_station_impact(normalized, mapping),
        "events_station_daily": station_daily,
        "events_series_daily": operations.event_series_daily(station_daily, stations),
        "events_mapping_report": operations.event_mapping_report(normalized, mapping),
        "incidents_normalized": incident_rows,
        "incidents_daily": operations.incidents_daily(incident_rows),
        "incidents_mapping_report": operations.incident_mapping_report(incident_rows),
    }


def write_operational_datasets(datasets: dict[str, DataFrame], path: str) -> dict[str, str]:
    """Check and write every operational table; returns the paths."""
    return {
        name: writers.write_output(df, path, OPERATIONAL_CONTRACTS[name]) for name, df in datasets.items()
    }


def external_daily(
    hourly: DataFrame,
    codes: DataFrame,
    official_holidays: DataFrame,
    operational_holidays: DataFrame,
    stored: DataFrame | None = None,
    today: Column | None = None,
    run_id: Column | None = None,
) -> DataFrame:
    """Calendar and weather table from hourly readings, merged into the stored one."""
    days = calendar.weather_daily(hourly, codes).withColumns(times.calendar_parts(F.col("date")))
    fresh = calendar.holiday_columns(days, official_holidays, operational_holidays).withColumn(
        "weather_source", F.lit("openmeteo")
    )
    if stored is None:
        return calendar.bridge_flag(calendar.neighbour_flags(fresh))
    return calendar.refresh_calendar(stored, fresh, today, run_id)


def demand_history(daily: DataFrame, day: str, value: str) -> DataFrame:
    """Demand up to the first empty day with weekday names, running and yearly totals."""
    closed = calendar.truncate_at_first_zero(daily, day, value)
    return panel.cumulative(closed, day, value).withColumn("weekday", times.weekday_name_es(F.col(day)))


@dataclass(frozen=True)
class Foundation:
    """Frames shared by all training datasets."""

    features: DataFrame
    diagnostics: DataFrame
    catalog: DataFrame
    external: DataFrame
    services: DataFrame | None
    events: DataFrame | None


def build_foundation(
    model_base: DataFrame,
    external: DataFrame,
    services_line_daily: DataFrame | None = None,
    events_series_daily: DataFrame | None = None,
    attributes: Sequence[str] = tuple(panel.SERIES_ATTRIBUTES),
) -> Foundation:
    present = [a for a in attributes if a in model_base.columns]
    dense = panel.densify(model_base, attributes=present)
    return Foundation(
        features=materialized(panel.panel_features(dense)),
        diagnostics=panel.panel_diagnostics(dense, present),
        catalog=features.availability_catalog(model_base.sparkSession),
        external=features.external_features(external),
        services=None if services_line_daily is None else features.service_features(services_line_daily),
        events=None if events_series_daily is None else features.event_features(events_series_daily),
    )


def training_specs() -> list[tuple[str, str, int]]:
    """All (variant, policy, horizon) triples."""
    return [
        (variant, policy, horizon)
        for variant in (features.STRICT, features.SCENARIO)
        for policy in (features.ALL_SERIES, features.SPARSE_EXCLUDED)
        for horizon in features.HORIZONS
    ]


def training_datasets(
    foundation: Foundation,
    *,
    sparse_series: Sequence[str] = tuple(features.SPARSE_SERIES),
    scenario_start: str = features.SCENARIO_START,
) -> dict[tuple[str, str, int], DataFrame]:
    return {
        spec: features.training_dataset(
            foundation.features,
            foundation.external,
            spec[0],
            spec[2],
            spec[1],
            services=foundation.services,
            events=foundation.events,
            sparse_series=list(sparse_series),
            scenario_start=scenario_start,
        )
        for spec in training_specs()
    }


def special_day_analysis(
    comparison: DataFrame, predictions: DataFrame, top_n: int = 15
) -> dict[str, DataFrame]:
    """Segment metrics, ranked deviations, main results and variable availability.

    ``comparison`` holds the three predictions with context columns; ``predictions`` is
    long with ``model_label``.
    """
    rows = materialized(analysis.add_segment_flags(comparison))
    network = analysis.network_days(rows)
    top_rows = materialized(analysis.rank_deviation(rows, top_n, network))
    listed = top_rows.filter(F.col("analysis_scope") == "network_day")
    segments = analysis.segment_metrics(
        rows,
        deviation_dates=listed.filter("rank_type = 'baseline_seasonal_deviation'"),
        worse_dates=listed.filter("rank_type = 'tabular_strict_worse_than_seasonal'"),
    )
    return {
        "segment_metrics": segments,
        "top_deviation_rows": top_rows,
        "main_results": analysis.main_results(predictions),
        "availability_summary": analysis.availability_summary(rows),
    }


def supervision(
    predictions: DataFrame,
    diagnostics: DataFrame,
    splits: DataFrame,
    *,
    sparse_series: Sequence[str] = tuple(features.SPARSE_SERIES),
    dataset: DataFrame | None = None,
    baselines: Mapping[str, tuple[str, str]] | None = None,
    comparison: DataFrame | None = None,
    runs: tuple[DataFrame, DataFrame] | None = None,
    specs: DataFrame | None = None,
    importances: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Leaderboard, series tables, rankings, comparison and error histogram.

    Further inputs add further outputs: ``dataset`` with ``baselines`` (model -> prediction and
    reference columns) the baselines' coverage, ``comparison`` the network overlay, two ``runs``
    their agreement, ``specs`` the leakage checks, ``importances`` the top features.
    """
    predictions = materialized(predictions)
    test = predictions.filter(F.col("split_type") == "test")
    by_split = backtest.forecast_metrics(predictions, [*backtest.SPEC_COLUMNS, "split_name", "split_type"])
    by_series = backtest.forecast_metrics(test, [*backtest.SPEC_COLUMNS, "linea", "series_id"])
    built = {
        "leaderboard": analysis.leaderboard(by_split, splits),
        "series_metrics": analysis.series_diagnostics_join(by_series, diagnostics, list(sparse_series)),
        "rankings": analysis.best_worst(by_series),
        "model_vs_baseline": analysis.model_vs_baseline(by_series),
        "error_histogram": analysis.error_histogram(test),
        "representative_series": analysis.representative_series(
            test.filter(F.col("horizon_days") == 1).filter("model_name = 'tabular_hgbr'"), diagnostics
        ),
    }
    if dataset is not None:
        built["baseline_coverage"] = analysis.baseline_coverage(dataset, baselines or {})
    if comparison is not None:
        built["network_overlay"] = analysis.network_overlay(comparison)
    if runs is not None:
        built["run_agreement"] = analysis.compare_runs(*runs)
    if specs is not None:
        catalog = features.availability_catalog(predictions.sparkSession)
        built["leakage_checks"] = analysis.leakage_checks(catalog, specs)
    if importances is not None:
        built["top_importance"] = analysis.top_importance(importances)
    return built


def external_snapshot(
    calendar_days: DataFrame, events: DataFrame, weather: DataFrame, scenarios: DataFrame
) -> dict[str, DataFrame]:
    """What is known about each scenario's days, and the warnings that follow from it.

    ``calendar_days`` and ``weather`` have a ``date``; ``events`` are normalised ones. Returns
    the coverage and warnings of each range, its calendar days and its events, and the weather
    days with their alert levels.
    """
    spans = events.filter("start_date <= end_date")
    coverage = scenario.snapshot_coverage(
        scenarios,
        calendar_days.select(F.col("date").alias("target_date")),
        spans.select(F.explode(F.sequence("start_date", "end_date")).alias("target_date")),
        weather.select(F.col("date").alias("target_date")),
    )
    requested = scenarios.select("execution_id", F.explode(F.sequence("range_start", "range_end")).alias("date"))
    return {
        "coverage": coverage,
        "warnings": scenario.range_warnings(coverage),
        "calendar": requested.join(calendar_days, "date"),
        "events": scenario.external_snapshot_events(events, scenarios),
        "weather": scenario.external_snapshot_weather(weather),
    }


def scenario_feature_rows(
    scenarios: DataFrame,
    latest: DataFrame,
    history: DataFrame,
    horizon_days: int,
    *,
    covered: DataFrame | None = None,
    calendar_overrides: DataFrame | None = None,
    events: DataFrame | None = None,
) -> DataFrame:
    """Feature rows of every scenario date and series, minus those already covered.

    Features do not depend on the scenario: they are built once per requested date and
    series, and scenarios then pick their dates by an equi-join. The requested dates, at
    most the days of the calendar, travel as one array.
    """
    requested = scenarios.select(
        "execution_id", F.explode(F.sequence("range_start", "range_end")).alias("target_date")
    )
    dates = requested.agg(F.collect_set("target_date")).scalar()
    wanted = F.col("_dates")
    rows = latest.withColumn("_dates", dates)
    if covered is not None:
        # The days that a series lacks are taken before rows are made of them.
        spans = requested.agg(F.struct(F.min("target_date").alias("lo"), F.max("target_date").alias("hi"))).scalar()
        near = covered.withColumn("_span", spans).filter(F.col("target_date").between(F.col("_span.lo"), F.col("_span.hi")))
        days = near.groupBy("series_id").agg(F.collect_set("target_date").alias("_covered"))
        rows = rows.join(days, "series_id", "left")
        wanted = F.when(F.col("_covered").isNull(), F.col("_dates")).otherwise(F.array_except("_dates", "_covered"))
    rows = rows.withColumn("target_date", F.explode(wanted)).drop("_dates", "_covered")
    rows = rows.withColumn("forecast_origin_date", F.date_sub("target_date", horizon_days))
    rows = panel.serving_history_features(history, rows)
    parts = {f"calendar_{k}": v for k, v in times.calendar_parts(F.col("target_date")).items()}
    rows = rows.withColumns({k: v for k, v in parts.items() if k in features.CALENDAR_NAMES.values()})
    if calendar_overrides is not None:
        changed = [c for c in calendar_overrides.columns if c != "target_date"]
        rows = scenario.override_join(rows, calendar_overrides, changed)
    if events is not None:
        rows = scenario.event_match(rows, events)
    return rows.join(requested, "target_date")


def run_scenarios(
    scenarios: DataFrame,
    sources: dict[str, DataFrame],
    demand_history: DataFrame,
    catalog: DataFrame,
    *,
    coverage: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Predictions, roll-ups, statuses and warnings of all scenarios together.

    ``sources`` are prediction tables by source name, without scenario columns;
    ``demand_history`` has the actual total of each day (``target_date``, ``actual``), which
    replaces the day and network actuals of every execution. ``coverage`` (of an external
    snapshot) adds range warnings; prediction rows with an origin date add the horizon flag.
    """
    status = scenario.scenario_columns(scenarios)
    # Recomputing scenarios and the others prefer different sources.
    best = {
        flag: scenario.priority_union(sources, recompute=flag).withColumn("_recompute", F.lit(flag))
        for flag in (False, True)
    }
    merged = best[False].unionByName(best[True])
    requested = status.select(
        "execution_id",
        F.col("status").isin("what_if", "derivada").alias("_recompute"),
        F.explode(F.sequence("range_start", "range_end")).alias("target_date"),
    )
    rows = scenario.catalog_enrich(requested.join(merged, ["target_date", "_recompute"]).drop("_recompute"), catalog)
    complete = scenario.historical_complete(rows, scenarios)
    final = (
        status.join(complete, "execution_id", "left")
        .withColumn(
            "status",
            domain.evaluated_status(F.col("status"), F.coalesce(F.col("actuals_complete"), F.lit(False))),
        )
    )
    aggregates = scenario.enrich_actuals(scenario.scenario_rollup(rows), demand_history)
    more = {}
    if coverage is not None:
        more["warnings"] = scenario.range_warnings(coverage)
    if "forecast_origin_date" in rows.columns:
        more["recursive_horizon"] = scenario.recursive_horizon_flag(rows, scenarios)
    return more | {
        "scenarios": final,
        "predictions": rows,
        "aggregates": aggregates,
        "completeness": scenario.prediction_completeness(rows, scenarios, catalog),
    }


def monitor_drift(raw: DataFrame, weather: DataFrame, weather_features: list[str]) -> dict[str, DataFrame]:
    """Drift rows per feature and the monitor's global status."""
    from ridelake.operators.quality import monitor_status, nested_status

    checked = drift.drift_monitor(demand.daily_total(raw), weather, weather_features)
    return {"features": checked, "summary": monitor_status(nested_status(checked, "parent"))}
