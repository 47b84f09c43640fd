"""Feature catalogue and training datasets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridelake.operators import panel as panels

STRICT = "strict_available"
SCENARIO = "forecastable_scenario"
ALL_SERIES = "all_series"
SPARSE_EXCLUDED = "sparse_excluded"
HORIZONS = [1, 7]
SCENARIO_START = "2023-03-08"
SPARSE_SERIES = ["GDL2", "PCH2"]

FUTURE = "future_available"
IF_SCENARIO = "future_available_if_forecast_or_scenario"
NEVER = "not_future_available"

# Columns of the calendar and weather table that become features, each
# renamed with the prefix of its group.
CALENDAR_COLUMNS = [
    "year",
    "month",
    "day",
    "quarter",
    "week_of_year",
    "day_of_year",
    "day_of_week",
    "day_of_week_name",
    "is_weekend",
    "is_holiday",
    "holiday_name",
    "holiday_scope",
    "is_holiday_mmo",
    "is_preholiday",
    "is_postholiday",
    "days_to_next_holiday",
    "days_since_prev_holiday",
    "is_bridge_candidate",
    "is_month_start",
    "is_month_end",
]
WEATHER_COLUMNS = [
    "temp_min_c",
    "temp_max_c",
    "temp_mean_c",
    "precip_mm",
    "rain_hours",
    "wind_max_kmh",
    "wind_mean_kmh",
    "humidity_mean_pct",
    "pressure_mean_hpa",
    "weather_code",
    "is_rainy_day",
    "is_heavy_rain_day",
    "is_hot_day",
    "is_cold_day",
    "is_bad_weather_day",
]
CALENDAR_NAMES = {c: f"calendar_{c}" for c in CALENDAR_COLUMNS}
WEATHER_NAMES = {c: c if c.startswith("weather_") else f"weather_{c}" for c in WEATHER_COLUMNS}

# Columns of the training data, by block.
STATIC_FEATURES = [
    "series_id",
    "linea",
    "zone",
    "station_group",
    "network_order",
    "is_interchange_candidate",
]
AUTOREGRESSIVE_FEATURES = [
    "target_latest_observed_value",
    "target_days_since_latest_observation",
    *[f"target_lag_{n}" for n in panels.LAG_DAYS],
    *[
        f"target_{measure}_{n}"
        for n in panels.ROLLING_DAYS
        for measure in ("rolling_mean", "rolling_std", "observed_count")
    ],
]
SERVICE_FEATURES = [
    "service_planned_start_minutes",
    "service_line_end_minutes",
    "service_line_end_day_offset",
    "service_duration_minutes",
    "service_has_planned_xml",
    "service_planned_code",
]
# Feature -> day-series event measure it is taken from.
EVENT_FEATURES = {
    "event_active_count": "active_event_count",
    "event_starting_count": "starting_event_count",
    "event_ending_count": "ending_event_count",
    "event_starting_estimated_attendance_sum": "starting_estimated_attendance_sum",
    "event_starting_unknown_attendance_count": "starting_unknown_attendance_count",
    "event_high_impact_starting_count": "high_impact_starting_event_count",
}
BASELINE_COLUMNS = [
    "baseline_naive_simple",
    "baseline_naive_simple_reference_date",
    "baseline_naive_seasonal_weekly",
    "baseline_naive_seasonal_reference_date",
    "baseline_seasonal_weekday_mean_4",
    "baseline_seasonal_weekday_mean_4_reference_date",
    "baseline_seasonal_weekday_mean_4_reference_count",
]
INCIDENT_FEATURES = [
    "incident_count",
    "delay_minutes_sum",
    "delay_minutes_max",
    "incident_duration_minutes_sum",
    "incident_duration_minutes_max",
    "delay_incident_count",
    "partial_service_incident_count",
    "line_stop_incident_count",
    "single_track_incident_count",
]
EXCLUDED_EVENT_FEATURES = [
    "events_total_count",
    "events_high_impact_count",
    "events_estimated_attendance_sum",
    "events_unknown_attendance_count",
    "events_near_metro_count",
    "events_city_center_count",
    "events_culture_count",
    "events_sports_count",
    "events_congress_count",
    "events_university_count",
    "events_religious_count",
    "events_other_count",
    "events_weighted_impact_sum",
    "max_event_impact_score",
    "has_major_event",
    "has_multiple_major_events",
    "events_geocoded_count",
    "events_unique_venue_count",
]
EXCLUDED_MASTER_FEATURES = [
    "n_validations",
    "first_seen_date",
    "last_seen_date",
    "n_unique_equipment",
    "n_unique_equipment_significant",
    "n_validations_significant_equipment",
    "significant_equipment_validation_share",
    "station_observation_status",
    "observed_span_days",
]

FLAG_FEATURES = [
    "is_interchange_candidate",
    *[CALENDAR_NAMES[c] for c in CALENDAR_COLUMNS if c.startswith("is_")],
    *[WEATHER_NAMES[c] for c in WEATHER_COLUMNS if c.startswith("is_")],
    "service_has_planned_xml",
]
CATEGORICAL_FEATURES = [
    "series_id",
    "linea",
    "zone",
    "station_group",
    "calendar_day_of_week_name",
    "calendar_holiday_name",
    "calendar_holiday_scope",
    "weather_code",
    "service_planned_code",
]
# Identifying columns of a training row.
ID_COLUMNS = [
    "forecast_origin_date",
    "target_date",
    "horizon_days",
    "feature_variant",
    "series_policy",
    "series_id",
    "series_label",
    "linea",
    "estacion",
    "station_abbrev",
    "station_join_key",
    "trip_count_target",
]

# Blocks of the catalogue: features, source, group, class, in strict, in scenario, dtype,
# is a model feature, reason for exclusion.
# The availability catalogue, one entry per block of features.
_BLOCKS = [
    (STATIC_FEATURES, "phase_2a_station_daily_model_base", "static", FUTURE, True, True, "mixed", True, None),
    (list(CALENDAR_NAMES.values()), "external_daily_features", "calendar", FUTURE, True, True, "mixed", True, None),
    (AUTOREGRESSIVE_FEATURES, "phase_2a_station_daily_model_base", "autoregressive", FUTURE, True, True, "numeric", True, None),
    (list(WEATHER_NAMES.values()), "external_daily_features", "weather", IF_SCENARIO, False, True, "mixed", True, None),
    (SERVICE_FEATURES, "services_line_daily", "planned_service", IF_SCENARIO, False, True, "mixed", True, None),
    (list(EVENT_FEATURES), "events_phase2a_series_daily", "planned_events", IF_SCENARIO, False, True, "numeric", True, None),
    (BASELINE_COLUMNS, "phase_2a_station_daily_model_base", "baseline_support", FUTURE, False, False, "mixed", False, "baseline_support_only"),
    (INCIDENT_FEATURES, "incidents_daily", "observed_operations", NEVER, False, False, "numeric", True, "realized_operations_not_available_at_prediction_time"),
    (["used_service_xml_name"], "services_line_daily", "observed_operations", NEVER, False, False, "categorical", True, "real_service_execution_is_not_available_in_future"),
    (EXCLUDED_EVENT_FEATURES, "external_daily_features", "excluded_duplicate_event_signal", IF_SCENARIO, False, False, "numeric", True, "excluded_to_avoid_double_count_with_events_phase2a_series_daily"),
    (EXCLUDED_MASTER_FEATURES, "master_datasets", "excluded_leakage", NEVER, False, False, "mixed", True, "historical_accumulator_or_non_operational_tracing_field"),
]

CATALOG_SCHEMA = (
    "feature_name string, source_dataset string, feature_group string, availability_class string, "
    "included_in_strict_available boolean, included_in_forecastable_scenario boolean, "
    "model_dtype string, is_model_feature boolean, exclusion_reason string"
)


def catalog_rows() -> list[tuple]:
    return [(name, *block[1:]) for block in _BLOCKS for name in block[0]]


def availability_catalog(spark: SparkSession) -> DataFrame:
    """One row per feature: source, group, availability class and inclusion flags."""
    return spark.createDataFrame(catalog_rows(), CATALOG_SCHEMA)


def catalog_counts(catalog: DataFrame) -> DataFrame:
    """Number of features per availability class and per group."""
    by_class = catalog.groupBy(F.col("availability_class").alias("name")).agg(F.count("*").alias("features"))
    by_group = catalog.groupBy(F.col("feature_group").alias("name")).agg(F.count("*").alias("features"))
    return by_class.withColumn("kind", F.lit("availability_class")).unionByName(
        by_group.withColumn("kind", F.lit("feature_group"))
    )


def feature_columns(variant: str) -> list[str]:
    """Alphabetical model features of a variant, straight from the catalogue blocks."""
    included = 4 if variant == STRICT else 5
    return sorted(row[0] for row in catalog_rows() if row[7] and row[included])


def select_features(df: DataFrame, variant: str) -> DataFrame:
    """Id columns, the variant's features and the baseline columns, where present."""
    wanted = dict.fromkeys([*ID_COLUMNS, *feature_columns(variant), *BASELINE_COLUMNS])
    return df.select(*[c for c in wanted if c in df.columns])


def external_features(external: DataFrame) -> DataFrame:
    """Calendar and weather columns under their feature names, keyed by target date."""
    names = {**CALENDAR_NAMES, **WEATHER_NAMES}
    return external.select(
        F.to_date("date").alias("target_date"),
        *[F.col(c).alias(n) for c, n in names.items() if c in external.columns],
    )


def service_features(line_daily: DataFrame) -> DataFrame:
    planned = F.col("planned_service_xml_name")
    return line_daily.select(
        F.to_date("service_date").alias("target_date"),
        "linea",
        F.col("commercial_start_minutes").alias("service_planned_start_minutes"),
        F.col("line_end_minutes").alias("service_line_end_minutes"),
        F.col("line_end_day_offset").alias("service_line_end_day_offset"),
        (F.col("line_end_minutes") - F.col("commercial_start_minutes")).alias("service_duration_minutes"),
        planned.isNotNull().alias("service_has_planned_xml"),
        F.coalesce(planned, F.col("service_name_raw")).alias("service_planned_code"),
    )


def event_features(series_daily: DataFrame) -> DataFrame:
    return series_daily.select(
        F.to_date("service_date").alias("target_date"),
        "linea",
        "estacion",
        *[F.col(f"{m}_deduplicated").alias(f) for f, m in EVENT_FEATURES.items()],
    )


def join_services(rows: DataFrame, services: DataFrame) -> DataFrame:
    joined = rows.join(services, ["target_date", "linea"], "left")
    return joined.withColumn(
        "service_has_planned_xml", F.coalesce("service_has_planned_xml", F.lit(False))
    )


def join_events(rows: DataFrame, events: DataFrame) -> DataFrame:
    joined = rows.join(events, ["target_date", "linea", "estacion"], "left")
    return joined.withColumns(
        {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in EVENT_FEATURES}
    )


def finalize_dtypes(df: DataFrame) -> DataFrame:
    casts: dict[str, Column] = {c: F.col(c).cast("double") for c in FLAG_FEATURES if c in df.columns}
    casts.update({c: F.col(c).cast("string") for c in CATEGORICAL_FEATURES if c in df.columns})
    return df.withColumns(casts)


def drop_sparse(df: DataFrame, sparse: Sequence[str] | DataFrame) -> DataFrame:
    """Drop the listed series (a list, or a frame with ``series_id``)."""
    if isinstance(sparse, DataFrame):
        return df.join(sparse.select("series_id").distinct(), "series_id", "left_anti")
    return df.filter(~F.col("series_id").isin(*sparse)) if sparse else df


def target_join(dense: DataFrame, horizon_days: int) -> DataFrame:
    """Label of each origin: the value observed ``horizon_days`` later.

    On the dense panel that is the value of a fixed number of rows ahead.
    """
    ahead = Window.partitionBy("series_id").orderBy("service_date")
    return (
        dense.withColumn("trip_count_target", F.lead("observed_target_value", horizon_days).over(ahead))
        .filter(F.col("trip_count_target").isNotNull())
        .withColumns(
            {
                "forecast_origin_date": F.col("service_date"),
                "target_date": F.date_add("service_date", horizon_days),
                "horizon_days": F.lit(horizon_days),
            }
        )
    )


def origin_rows(features: DataFrame, *horizons: int) -> DataFrame:
    """Panel features, baselines and label per forecast origin, on the panel's shuffle."""
    rows = panels.naive_baselines(features, horizons)
    return rows.withColumn("target_day_of_week", F.weekday("target_date")).withColumnRenamed(
        "service_date", "forecast_origin_date"
    )


def training_dataset(
    features: DataFrame,
    external: DataFrame,
    variant: str,
    horizon_days: int,
    series_policy: str = ALL_SERIES,
    *,
    services: DataFrame | None = None,
    events: DataFrame | None = None,
    scenario_start: str = SCENARIO_START,
    sparse_series: Sequence[str] | DataFrame = SPARSE_SERIES,
) -> DataFrame:
    """Training rows of one (variant, horizon, policy).

    ``features`` is the dense panel with its window features; ``external``, ``services``
    and ``events`` are prepared by the ``*_features`` functions.
    """
    if variant not in (STRICT, SCENARIO):
        raise ValueError(f"unknown variant {variant}")
    if series_policy not in (ALL_SERIES, SPARSE_EXCLUDED):
        raise ValueError(f"unknown series policy {series_policy}")
    if horizon_days <= 0:
        raise ValueError("the horizon must be positive")
    base = drop_sparse(features, sparse_series) if series_policy == SPARSE_EXCLUDED else features
    rows = origin_rows(base, horizon_days).withColumns(
        {"feature_variant": F.lit(variant), "series_policy": F.lit(series_policy)}
    )
    rows = rows.join(external, "target_date", "left")
    if variant == SCENARIO:
        rows = rows.filter(F.col("target_date") >= F.lit(scenario_start).cast("date"))
        if services is not None:
            rows = join_services(rows, services)
        if events is not None:
            rows = join_events(rows, events)
    return select_features(finalize_dtypes(rows), variant)


def training_rows(
    features: DataFrame,
    external: DataFrame,
    *,
    horizons: Sequence[int] = tuple(HORIZONS),
    services: DataFrame | None = None,
    events: DataFrame | None = None,
    scenario_start: str = SCENARIO_START,
    sparse_series: Sequence[str] | DataFrame = SPARSE_SERIES,
) -> DataFrame:
    """Training rows of all specs at once: one panel pass, and ``specs``, the (variant, policy)
    pairs whose dataset a row belongs to.

    A dataset is the rows whose ``specs`` hold its pair, and :func:`select_features` of them.
    Panel windows are per series, so that leaving a sparse series out changes no other row.
    """
    rows = origin_rows(features, *horizons).join(external, "target_date", "left")
    if services is not None:
        rows = join_services(rows, services)
    if events is not None:
        rows = join_events(rows, events)
    if isinstance(sparse_series, DataFrame):
        listed = sparse_series.select("series_id", F.lit(True).alias("_sparse")).distinct()
        rows = rows.join(listed, "series_id", "left").withColumn("_sparse", F.coalesce("_sparse", F.lit(False)))
    else:
        rows = rows.withColumn("_sparse", F.col("series_id").isin(*sparse_series) if sparse_series else F.lit(False))
    late = F.col("target_date") >= F.lit(scenario_start).cast("date")
    pairs = [
        F.struct(
            F.lit(variant).alias("variant"),
            F.lit(policy).alias("series_policy"),
            ((late if variant == SCENARIO else F.lit(True)) & (~F.col("_sparse") if policy == SPARSE_EXCLUDED else F.lit(True))).alias("held"),
        )
        for variant in (STRICT, SCENARIO)
        for policy in (ALL_SERIES, SPARSE_EXCLUDED)
    ]
    specs = F.transform(
        F.filter(F.array(*pairs), lambda p: p["held"]),
        lambda p: F.struct(p["variant"].alias("variant"), p["series_policy"].alias("series_policy")),
    )
    return finalize_dtypes(rows.withColumn("specs", specs).drop("_sparse"))


def dataset_stats(dataset: DataFrame) -> DataFrame:
    return dataset.groupBy("feature_variant", "series_policy", "horizon_days").agg(
        F.count("*").alias("row_count"),
        F.countDistinct("series_id").alias("series_count"),
        F.min("forecast_origin_date").alias("origin_min"),
        F.max("forecast_origin_date").alias("origin_max"),
        F.min("target_date").alias("target_min"),
        F.max("target_date").alias("target_max"),
    )
