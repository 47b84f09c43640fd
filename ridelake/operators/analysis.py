"""Error analysis of forecasts: special days, rankings, supervision tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridelake.functions import domain
from ridelake.operators import backtest
from ridelake.operators.calendar import add_easter_flag
from ridelake.operators.features import AUTOREGRESSIVE_FEATURES
from ridelake.operators.joins import one_per_slot

EPSILON = 1e-9
PREDICTION_KEYS = ["forecast_origin_date", "target_date", "series_id"]

SEGMENT_FLAGS = [
    "is_holiday",
    "is_preholiday",
    "is_postholiday",
    "is_semana_santa",
    "event_day",
    "high_impact_event_day",
    "bad_weather_day",
    "heavy_rain_day",
]

# Segment -> flag it is made of; the remaining segments are built in ``segment_names``.
FLAG_SEGMENTS = {
    "holidays": "is_holiday",
    "preholidays": "is_preholiday",
    "postholidays": "is_postholiday",
    "semana_santa": "is_semana_santa",
    "event_days": "event_day",
    "high_impact_event_days": "high_impact_event_day",
    "bad_weather_days": "bad_weather_day",
    "heavy_rain_days": "heavy_rain_day",
}
SEGMENTS = [
    "all_test_rows",
    "normal_days",
    *FLAG_SEGMENTS,
    "top_baseline_deviation_days",
    "top_tabular_worse_than_baseline_days",
]

MODEL_PREDICTIONS = {
    "baseline_seasonal": "y_pred_seasonal",
    "tabular_strict": "y_pred_tabular_strict",
    "tabular_forecastable": "y_pred_tabular_forecastable",
}

# Variable group -> columns that must be present, columns that make a row positive.
AVAILABILITY_GROUPS: dict[str, tuple[list[str], list[str]]] = {
    "calendario_festivos_semana_santa": (
        ["calendar_is_holiday", "calendar_is_preholiday", "calendar_is_postholiday"],
        ["calendar_is_holiday", "calendar_is_preholiday", "calendar_is_postholiday", "is_semana_santa"],
    ),
    "eventos_planificados": (
        ["event_active_count", "event_starting_count", "event_ending_count"],
        ["event_active_count", "event_starting_count", "event_ending_count"],
    ),
    "aforo_estimado": (
        ["event_starting_estimated_attendance_sum", "event_starting_unknown_attendance_count"],
        ["event_starting_estimated_attendance_sum", "event_starting_unknown_attendance_count"],
    ),
    "eventos_por_estacion_serie": (
        ["event_active_count", "event_high_impact_starting_count"],
        ["event_active_count", "event_high_impact_starting_count"],
    ),
    "meteorologia": (
        ["weather_is_bad_weather_day", "weather_is_heavy_rain_day", "weather_precip_mm", "weather_rain_hours"],
        ["weather_is_bad_weather_day", "weather_is_heavy_rain_day", "weather_precip_mm", "weather_rain_hours"],
    ),
    "servicio_planificado": (
        ["service_duration_minutes", "service_has_planned_xml", "service_planned_code"],
        ["service_duration_minutes", "service_has_planned_xml"],
    ),
    "incidencias_y_servicio_ejecutado": ([], []),
}


def compare_forecasts(
    seasonal: DataFrame, strict: DataFrame, forecastable: DataFrame, context: DataFrame | None = None
) -> DataFrame:
    """One row per prediction key with the three predictions and the context columns.

    The three prediction tables are stacked and pivoted by one grouped aggregation, which
    is an inner join on all three with a single shuffle. Two rows of one table on one key are
    an error.
    """
    keys = ["horizon_days", *PREDICTION_KEYS]
    stacked = None
    for slot, frame in enumerate((seasonal, strict, forecastable)):
        part = frame.select(*keys, "linea", "estacion", "y_true", "y_pred", F.lit(slot).alias("_slot"))
        stacked = part if stacked is None else stacked.unionByName(part)

    def pick(column: str, slot: int) -> Column:
        return F.max(F.when(F.col("_slot") == slot, F.col(column)))

    joined = (
        stacked.groupBy(*keys)
        .agg(
            F.max("linea").alias("linea"),
            F.max("estacion").alias("estacion"),
            pick("y_true", 0).alias("y_true"),
            pick("y_pred", 0).alias("y_pred_seasonal"),
            pick("y_pred", 1).alias("y_pred_tabular_strict"),
            pick("y_pred", 2).alias("y_pred_tabular_forecastable"),
            *[F.count_if(F.col("_slot") == slot).alias(f"_n{slot}") for slot in range(3)],
        )
        .filter((F.col("_n0") > 0) & (F.col("_n1") > 0) & (F.col("_n2") > 0))
        .filter(one_per_slot(F.greatest("_n0", "_n1", "_n2"), "forecast comparison"))
        .drop("_n0", "_n1", "_n2")
    )
    return joined if context is None else joined.join(context, PREDICTION_KEYS, "left")


def add_segment_flags(rows: DataFrame) -> DataFrame:
    """Special-day flags from whichever context columns are present."""
    def flag(column: str) -> Column:
        return domain.as_bool(F.col(column)) if column in rows.columns else F.lit(False)

    def positive(*columns: str) -> Column:
        present = [F.col(c) for c in columns if c in rows.columns]
        return domain.positive_any(*present) if present else F.lit(False)

    flagged = rows.withColumns(
        {
            "is_holiday": flag("calendar_is_holiday"),
            "is_preholiday": flag("calendar_is_preholiday"),
            "is_postholiday": flag("calendar_is_postholiday"),
            "event_day": positive("event_active_count", "event_starting_count", "event_ending_count"),
            "high_impact_event_day": positive("event_high_impact_starting_count"),
            "bad_weather_day": flag("weather_is_bad_weather_day"),
            "heavy_rain_day": flag("weather_is_heavy_rain_day"),
        }
    )
    if "calendar_holiday_name" in rows.columns:
        return add_easter_flag(flagged)
    return flagged.withColumn("is_semana_santa", F.lit(False))


def network_days(rows: DataFrame) -> DataFrame:
    """Sums per horizon and day, flags of any series, context summed or joined."""
    context = {
        "calendar_holiday_name": "text",
        "calendar_holiday_scope": "text",
        "event_active_count": "sum",
        "event_high_impact_starting_count": "sum",
        "event_starting_estimated_attendance_sum": "sum",
        "weather_precip_mm": "sum",
        "weather_rain_hours": "sum",
    }
    aggregates = [
        F.coalesce(F.sum(c), F.lit(0.0)).alias(c)
        for c in ("y_true", *MODEL_PREDICTIONS.values())
        if c in rows.columns
    ]
    aggregates += [F.bool_or(c).alias(c) for c in SEGMENT_FLAGS if c in rows.columns]
    for column, how in context.items():
        if column not in rows.columns:
            continue
        if how == "sum":
            aggregates.append(F.coalesce(F.sum(column), F.lit(0.0)).alias(column))
        else:
            names = F.array_sort(F.collect_set(F.when(F.trim(column) != "", F.col(column))))
            aggregates.append(F.array_join(names, ", ").alias(column))
    return rows.groupBy("horizon_days", "target_date").agg(*aggregates)


def error_columns(rows: DataFrame, total: Column) -> DataFrame:
    """Absolute, relative and WAPE-share errors of the baseline and both models.

    ``total`` is the WAPE denominator, for example a column of horizon totals.
    """
    y, seasonal = F.col("y_true"), F.col("y_pred_seasonal")
    strict = F.col("y_pred_tabular_strict")
    columns = {
        "seasonal_abs_error": F.abs(seasonal - y),
        "tabular_strict_abs_error": F.abs(strict - y),
        "real_minus_baseline": y - seasonal,
        "real_baseline_ratio": F.when(F.abs(seasonal) > EPSILON, y / seasonal),
    }
    enriched = rows.withColumns(columns)
    enriched = enriched.withColumns(
        {
            "seasonal_relative_error": F.when(F.abs(y) > EPSILON, F.col("seasonal_abs_error") / F.abs(y)),
            "seasonal_wape_contribution": F.col("seasonal_abs_error") / F.nullif(total, F.lit(0.0)),
            "tabular_strict_error_delta_vs_seasonal": F.col("tabular_strict_abs_error") - F.col("seasonal_abs_error"),
            "tabular_strict_improves_vs_seasonal": F.coalesce(
                F.col("tabular_strict_abs_error") < F.col("seasonal_abs_error"), F.lit(False)
            ),
        }
    )
    if "y_pred_tabular_forecastable" in rows.columns:
        forecastable = F.abs(F.col("y_pred_tabular_forecastable") - y)
        enriched = enriched.withColumns(
            {
                "tabular_forecastable_abs_error": forecastable,
                "forecastable_error_delta_vs_strict": forecastable - F.col("tabular_strict_abs_error"),
            }
        )
    return enriched


def with_horizon_total(rows: DataFrame, source: DataFrame | None = None) -> DataFrame:
    """Add ``_total``, the sum of absolute actuals of the row's horizon.

    One row per horizon is broadcast instead of a window over each whole horizon.
    """
    base = rows if source is None else source
    totals = base.groupBy("horizon_days").agg(F.sum(F.abs("y_true")).alias("_total"))
    return rows.join(F.broadcast(totals), "horizon_days", "left")


def rank_deviation(rows: DataFrame, top_n: int, network: DataFrame | None = None) -> DataFrame:
    """Top-n rows per horizon by baseline deviation and by loss against the baseline.

    Ranked at network-day and series-day scope. Ties break by date and series, and a row
    number cut lets every task keep only its own n best rows before the shuffle. ``rows`` is
    read four times: pass a checkpointed frame.
    """
    network_rows = network_days(rows) if network is None else network
    scopes = {
        "network_day": error_columns(with_horizon_total(network_rows, rows), F.col("_total")).withColumn(
            "series_id", F.lit(None).cast("string")
        ),
        "series_day": error_columns(with_horizon_total(rows), F.col("_total")),
    }
    rank_types = {
        "baseline_seasonal_deviation": ("seasonal_abs_error", False),
        "tabular_strict_worse_than_seasonal": ("tabular_strict_error_delta_vs_seasonal", True),
    }
    columns = [
        "horizon_days",
        "target_date",
        "series_id",
        *[c for c in SEGMENT_FLAGS if c in rows.columns],
        "y_true",
        *[c for c in MODEL_PREDICTIONS.values() if c in rows.columns],
        "seasonal_abs_error",
        "seasonal_relative_error",
        "seasonal_wape_contribution",
        "real_baseline_ratio",
        "real_minus_baseline",
        "tabular_strict_abs_error",
        "tabular_strict_error_delta_vs_seasonal",
        "tabular_strict_improves_vs_seasonal",
    ]
    result = None
    for scope, frame in scopes.items():
        for rank_type, (measure, only_positive) in rank_types.items():
            best = Window.partitionBy("horizon_days").orderBy(
                F.col(measure).desc_nulls_last(), "target_date", "series_id"
            )
            part = frame.filter(F.col(measure) > 0) if only_positive else frame
            ranked = (
                part.select(*columns)
                .withColumn("rank_position", F.row_number().over(best))
                .filter(F.col("rank_position") <= top_n)
                .withColumns({"analysis_scope": F.lit(scope), "rank_type": F.lit(rank_type)})
            )
            result = ranked if result is None else result.unionByName(ranked)
    return result


def segment_names(deviation_day: Column, worse_day: Column) -> Column:
    """Names of all segments a row belongs to; the segments overlap."""
    special = F.lit(False)
    for flag in SEGMENT_FLAGS:
        special = special | F.col(flag)
    members = {"all_test_rows": F.lit(True), "normal_days": ~special}
    members.update({name: F.col(flag) for name, flag in FLAG_SEGMENTS.items()})
    members["top_baseline_deviation_days"] = deviation_day
    members["top_tabular_worse_than_baseline_days"] = worse_day
    return F.filter(
        F.array(*[F.when(hit, F.lit(name)) for name, hit in members.items()]), lambda n: n.isNotNull()
    )


def segment_metrics(
    rows: DataFrame, *, deviation_dates: DataFrame | None = None, worse_dates: DataFrame | None = None
) -> DataFrame:
    """Metrics of the baseline and two models per horizon and segment.

    Rows are reduced per combination of segments first; only those few combinations are
    exploded. Segments without rows keep a row of zeros and NULLs.
    """
    marked = rows
    for name, dates in (("_deviation", deviation_dates), ("_worse", worse_dates)):
        if dates is None:
            marked = marked.withColumn(name, F.lit(False))
        else:
            listed = dates.select("target_date").distinct().withColumn(f"{name}_hit", F.lit(True))
            marked = marked.join(listed, "target_date", "left").withColumn(
                name, F.coalesce(f"{name}_hit", F.lit(False))
            )
    parts: list[Column] = [F.coalesce(F.sum("y_true"), F.lit(0.0)).alias("target_sum")]
    names: list[str] = []
    for model, column in MODEL_PREDICTIONS.items():
        for part, source in zip(backtest.metric_parts(column), backtest._PARTS):
            parts.append(part.alias(f"{model}{source}" if source.startswith("_") else f"{model}_{source}"))
            names.append(f"{model}{source}" if source.startswith("_") else f"{model}_{source}")
    combined = (
        marked.withColumn("_segments", segment_names(F.col("_deviation"), F.col("_worse")))
        .groupBy("horizon_days", "_segments")
        .agg(*parts)
    )
    per_segment = (
        combined.withColumn("segment_name", F.explode("_segments"))
        .groupBy("horizon_days", "segment_name")
        .agg(F.sum("target_sum").alias("target_sum"), *[F.sum(n).alias(n) for n in names])
    )
    grid = combined.select("horizon_days").distinct().select(
        "horizon_days", F.explode(F.array(*[F.lit(s) for s in SEGMENTS])).alias("segment_name")
    )
    full = grid.join(per_segment, ["horizon_days", "segment_name"], "left")
    columns: dict[str, Column] = {
        "row_count": F.coalesce(F.col("baseline_seasonal_row_count"), F.lit(0)),
        "target_sum": F.coalesce(F.col("target_sum"), F.lit(0.0)),
    }
    for model in MODEL_PREDICTIONS:
        n = F.nullif(F.col(f"{model}_available_prediction_count"), F.lit(0))
        columns[f"{model}_mae"] = F.col(f"{model}_abs_error_sum") / n
        columns[f"{model}_rmse"] = F.sqrt(F.col(f"{model}_sq_error") / n)
        columns[f"{model}_wape"] = F.col(f"{model}_abs_error_sum") / F.nullif(F.col(f"{model}_abs_true"), F.lit(0.0))
        columns[f"{model}_smape"] = F.col(f"{model}_smape") / n
        columns[f"{model}_available_prediction_count"] = F.coalesce(
            F.col(f"{model}_available_prediction_count"), F.lit(0)
        )
    shown = full.withColumns(columns).withColumns(
        {
            "tabular_strict_relative_wape_improvement_vs_seasonal": domain.relative_improvement(
                F.col("baseline_seasonal_wape"), F.col("tabular_strict_wape"), EPSILON
            ),
            "forecastable_relative_wape_improvement_vs_strict": domain.relative_improvement(
                F.col("tabular_strict_wape"), F.col("tabular_forecastable_wape"), EPSILON
            ),
        }
    )
    return shown.drop(
        *[f"{m}{s}" for m in MODEL_PREDICTIONS for s in ("_sq_error", "_abs_true", "_row_count")]
    )


# Order of the main results table.
LEVEL_ORDER = ["serie_estacion_dia", "dia_red"]
LABEL_ORDER = ["Naive simple", "Naive estacional", "Tabular propuesto", "Tabular forecastable"]


def rank_of(value: Column, order: Sequence[str]) -> Column:
    """Position of a value in a fixed order, for sorting."""
    return F.array_position(F.array(*[F.lit(o) for o in order]), value)


def main_results(predictions: DataFrame) -> DataFrame:
    """Metrics at series-day and network-day grain per model label and horizon, in order."""
    by = ["model_label", "horizon_days"]
    series = backtest.forecast_metrics(predictions, by).withColumn("metric_level", F.lit(LEVEL_ORDER[0]))
    days = predictions.groupBy(*by, "target_date").agg(
        F.coalesce(F.sum("y_true"), F.lit(0.0)).alias("y_true"),
        F.coalesce(F.sum("y_pred"), F.lit(0.0)).alias("y_pred"),
    )
    network = backtest.forecast_metrics(days, by).withColumn("metric_level", F.lit(LEVEL_ORDER[1]))
    both = series.unionByName(network).withColumn(
        "horizon", F.concat(F.lit("D+"), F.col("horizon_days").cast("string"))
    )
    return both.orderBy(
        rank_of(F.col("metric_level"), LEVEL_ORDER),
        "horizon_days",
        rank_of(F.col("model_label"), LABEL_ORDER),
    )


def availability_summary(
    rows: DataFrame, groups: Mapping[str, tuple[Sequence[str], Sequence[str]]] | None = None
) -> DataFrame:
    """Coverage and positive rows and days of each group of external variables.

    Rows are de-duplicated per (date, series), reduced per date, then summed.
    """
    groups = groups or AVAILABILITY_GROUPS
    context = rows.dropDuplicates(["target_date", "series_id"])
    per_day: list[Column] = [F.count("*").alias("_n")]
    finals: list[Column] = []
    for i, (name, (coverage, positive)) in enumerate(groups.items()):
        covered = [F.col(c).isNotNull() for c in coverage if c in rows.columns]
        hits = [F.col(c) for c in positive if c in rows.columns]
        all_covered = covered[0] if covered else F.lit(None).cast("boolean")
        for other in covered[1:]:
            all_covered = all_covered & other
        any_positive = domain.positive_any(*hits) if hits else F.lit(False)
        per_day += [
            F.count_if(all_covered).alias(f"_c{i}"),
            F.count_if(any_positive).alias(f"_p{i}"),
        ]
        ratio = F.sum(f"_c{i}") / F.sum("_n") if covered else F.lit(None).cast("double")
        finals.append(
            F.struct(
                F.lit(name).alias("variable_group"),
                ratio.alias("coverage_ratio_test_rows"),
                F.coalesce(F.sum(f"_p{i}"), F.lit(0)).alias("positive_row_count"),
                F.count_if(F.col(f"_p{i}") > 0).alias("positive_day_count"),
            )
        )
    days = context.groupBy("target_date").agg(*per_day)
    return days.agg(*[f.alias(f"g{i}") for i, f in enumerate(finals)]).select(
        F.inline(F.array(*[F.col(f"g{i}") for i in range(len(finals))]))
    )


# Supervision ------------------------------------------------------------------------------


def leaderboard(split_metrics: DataFrame, splits: DataFrame) -> DataFrame:
    """Split metrics with the train window of the split and the validation and test windows.

    Where the splits are of several horizons, each metric gets those of its own.
    """
    by = [c for c in ("horizon_days",) if c in splits.columns and c in split_metrics.columns]
    windows = splits.groupBy(*by).agg(
        *[
            agg(F.when(F.col("split_type") == kind, F.col(edge))).alias(f"{kind}_date_{label}")
            for kind in ("validation", "test")
            for agg, edge, label in ((F.min, "score_start", "min"), (F.max, "score_end", "max"))
        ]
    )
    train = splits.select(
        *by,
        "split_name",
        F.col("train_start").alias("train_date_min"),
        F.col("train_end").alias("train_date_max"),
    )
    # Few rows: four splits a horizon, and one window.
    joined = split_metrics.join(F.broadcast(train), [*by, "split_name"])
    if by:
        return joined.join(F.broadcast(windows), by)
    names = ["validation_date_min", "validation_date_max", "test_date_min", "test_date_max"]
    window = windows.select(F.struct("*").alias("w")).scalar()
    return joined.withColumn("_w", window).withColumns({n: F.col(f"_w.{n}") for n in names}).drop("_w")


def baseline_coverage(
    dataset: DataFrame, models: Mapping[str, tuple[str, str]]
) -> DataFrame:
    """Rows, missing predictions and missing references per baseline, spec and split.

    ``models`` maps a model to its prediction and reference-date columns.
    """
    spec = ["feature_variant", "series_policy", "horizon_days"]
    scored = backtest.assign_splits(dataset, by=spec)
    by = [*spec, "split_name", "split_type"]
    counted = scored.groupBy(*by).agg(
        F.count("*").alias("row_count"),
        *[F.count_if(F.col(p).isNull()).alias(f"{m}|p") for m, (p, _) in models.items()],
        *[F.count_if(F.col(r).isNull()).alias(f"{m}|r") for m, (_, r) in models.items()],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(m).alias("model_name"),
                F.col(f"{m}|p").alias("missing_prediction_count"),
                F.col(f"{m}|r").alias("missing_reference_count"),
            )
            for m in models
        ]
    )
    return counted.select(*by, "row_count", F.inline(rows)).withColumn(
        "coverage_ratio", 1 - F.col("missing_prediction_count") / F.col("row_count")
    )


def compare_runs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Agreement of two runs on their common (series, origin) rows."""
    keys = ["series_id", "forecast_origin_date"]
    a = left.select(*keys, F.col("y_true").alias("_tl"), F.col("y_pred").alias("_pl"))
    b = right.select(*keys, F.col("y_true").alias("_tr"), F.col("y_pred").alias("_pr"))

    def share(condition: Column) -> Column:
        return F.avg(F.coalesce(condition, F.lit(False)).cast("double"))

    return a.join(b, keys).agg(
        F.count("*").alias("row_count"),
        share(F.col("_tl") == F.col("_tr")).alias("same_truth_fraction"),
        share(F.col("_pl") == F.col("_pr")).alias("same_prediction_fraction"),
        F.sum(F.abs(F.col("_pl") - F.col("_tl"))).alias("left_absolute_error_sum"),
        F.sum(F.abs(F.col("_pr") - F.col("_tr"))).alias("right_absolute_error_sum"),
        F.sum("_tl").alias("left_target_sum"),
        F.sum("_tr").alias("right_target_sum"),
    )


def series_diagnostics_join(
    series_metrics: DataFrame, diagnostics: DataFrame, sparse: Sequence[str] = ()
) -> DataFrame:
    """Series metrics with panel diagnostics and sparse / low-coverage flags."""
    extra = [
        "observed_days",
        "calendar_span_days",
        "intra_span_missing_days",
        "max_gap_days",
    ]
    shared = [c for c in ("series_label", "station_abbrev") if c in diagnostics.columns]
    side = diagnostics.select(
        "series_id",
        *[F.col(c).alias(f"_d_{c}") for c in shared],
        *extra,
        F.col("coverage_ratio").alias("panel_coverage_ratio"),
    )
    renamed = series_metrics.withColumnRenamed("coverage_ratio", "prediction_coverage_ratio")
    joined = renamed.join(side, "series_id", "left")
    for column in shared:
        own = F.col(column) if column in series_metrics.columns else F.lit(None)
        joined = joined.withColumn(column, F.coalesce(own, F.col(f"_d_{column}"))).drop(f"_d_{column}")
    return joined.withColumns(
        {
            "is_sparse_series": F.col("series_id").isin(*sparse) if sparse else F.lit(False),
            "is_low_coverage_series": F.col("panel_coverage_ratio") < 0.1,
        }
    )


def best_worst(series_metrics: DataFrame, n: int = 10) -> DataFrame:
    """The n best and n worst series by WAPE of every spec, with positions; NULLs never rank."""
    spec = [c for c in backtest.SPEC_COLUMNS if c in series_metrics.columns]
    scored = series_metrics.filter(F.col("wape").isNotNull())
    result = None
    for name, order in (("best", F.col("wape").asc()), ("worst", F.col("wape").desc())):
        ranked = Window.partitionBy(*spec).orderBy(order, "series_id")
        part = (
            scored.withColumn("ranking_position", F.row_number().over(ranked))
            .filter(F.col("ranking_position") <= n)
            .withColumn("ranking_group", F.lit(f"{name}_{n}"))
        )
        result = part if result is None else result.unionByName(part)
    return result


def model_vs_baseline(
    series_metrics: DataFrame,
    model: str = "tabular_hgbr",
    baseline: str = "baseline_naive_seasonal_weekly",
) -> DataFrame:
    """Series metrics of a model next to the baseline's, with the WAPE gain."""
    keys = ["variant", "series_policy", "horizon_days", "series_id"]
    measures = ["wape", "mae", "rmse", "smape"]
    base = series_metrics.filter(F.col("model_name") == baseline).select(
        *keys, *[F.col(m).alias(f"baseline_{m}") for m in measures]
    )
    own = series_metrics.filter(F.col("model_name") == model).select(*keys, *measures)
    return own.join(base, keys).withColumn(
        "tabular_wape_improvement_vs_baseline", F.col("baseline_wape") - F.col("wape")
    )


def alignment_check(
    dataset: DataFrame, panel: DataFrame, columns: Sequence[str] = tuple(AUTOREGRESSIVE_FEATURES)
) -> DataFrame:
    """Rows whose autoregressive features differ from the panel at the origin, per column."""
    side = panel.select(
        "series_id",
        F.col("service_date").alias("forecast_origin_date"),
        *[F.col(c).alias(f"_panel_{c}") for c in columns],
    )
    joined = dataset.join(side, ["series_id", "forecast_origin_date"], "left")
    wide = joined.agg(
        *[F.count_if(~F.col(c).eqNullSafe(F.col(f"_panel_{c}"))).alias(c) for c in columns]
    )
    return wide.unpivot([], list(columns), "column_name", "mismatch_count").withColumn(
        "passed", F.col("mismatch_count") == 0
    )


def leakage_checks(
    catalog: DataFrame,
    specs: DataFrame,
    *,
    promoted_variant: str = "strict_available",
    promoted_policy: str = "all_series",
) -> DataFrame:
    """Six checks per promoted spec on the availability of its features.

    ``specs`` has one row per spec: ``horizon_days, variant, series_policy,
    feature_columns`` (array).
    """
    used = specs.select("*", F.explode("feature_columns").alias("feature_name"))
    classed = used.join(catalog.select("feature_name", "availability_class"), "feature_name", "left")
    klass = F.col("availability_class")
    per_spec = classed.groupBy("horizon_days", "variant", "series_policy").agg(
        F.bool_or(F.col("feature_name") == "incident_count").alias("_incident"),
        F.bool_or(F.col("feature_name") == "used_service_xml_name").alias("_used"),
        F.coalesce(F.bool_or(klass == "not_future_available"), F.lit(False)).alias("_never"),
        F.coalesce(
            F.bool_or(klass == "future_available_if_forecast_or_scenario"), F.lit(False)
        ).alias("_scenario"),
        F.coalesce(F.bool_and(klass == "future_available"), F.lit(False)).alias("_only_future"),
        F.array_join(F.array_sort(F.collect_set("availability_class")), ", ").alias("_classes"),
    )
    promoted = (F.col("variant") == promoted_variant) & (F.col("series_policy") == promoted_policy)
    checks = {
        "incidents_daily_excluded": ~F.col("_incident"),
        "used_service_xml_name_excluded": ~F.col("_used"),
        "not_future_available_excluded": ~F.col("_never"),
        "scenario_features_excluded_from_recommended_model": ~F.col("_scenario"),
        "recommended_variant_is_strict_available": promoted,
        "strict_feature_set_only_future_available": F.col("_only_future"),
    }
    prefix = F.concat(F.lit("h"), F.col("horizon_days").cast("string"), F.lit("_"))
    rows = F.array(
        *[
            F.struct(
                F.concat(prefix, F.lit(name)).alias("check_name"),
                passed.alias("passed"),
                F.concat(F.lit("feature classes: "), F.col("_classes")).alias("details"),
            )
            for name, passed in checks.items()
        ]
    )
    return per_spec.select("variant", "series_policy", F.inline(rows))


def error_histogram(predictions: DataFrame, bins: int = 40) -> DataFrame:
    """Equal-width histogram of the absolute error per model and horizon."""
    by = ["model_name", "horizon_days"]
    errors = predictions.select(*by, F.abs(F.col("y_pred") - F.col("y_true")).alias("_e")).filter(
        "_e IS NOT NULL"
    )
    limits = errors.groupBy(*by).agg(F.min("_e").alias("_lo"), F.max("_e").alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    raw = F.floor((F.col("_e") - F.col("_lo")) / F.nullif(width, F.lit(0.0)))
    bucket = F.least(F.coalesce(raw, F.lit(0)), F.lit(bins - 1)).cast("int")
    return (
        # One row per model and horizon.
        errors.join(F.broadcast(limits), by)
        .withColumn("bin", bucket)
        .groupBy(*by, "bin", "_lo", "_hi")
        .agg(F.count("*").alias("row_count"))
        .withColumn("bin_start", F.col("_lo") + F.col("bin") * (F.col("_hi") - F.col("_lo")) / bins)
        .drop("_lo", "_hi")
    )


def representative_series(
    test_predictions: DataFrame, diagnostics: DataFrame, *, dense_above: float = 0.8, sparse_below: float = 0.1
) -> DataFrame:
    """Two largest dense series, the smallest other dense one, and the first sparse one."""
    volume = test_predictions.groupBy("series_id").agg(F.sum("y_true").alias("volume"))
    joined = volume.join(diagnostics.select("series_id", "coverage_ratio"), "series_id")
    dense = joined.filter(F.col("coverage_ratio") > dense_above)
    top = dense.orderBy(F.desc("volume"), "series_id").limit(2)
    # The smallest series is already chosen when there are only one or two dense ones.
    low = (
        dense.orderBy(F.asc("volume"), F.desc("series_id"))
        .limit(1)
        .join(F.broadcast(top.select("series_id")), "series_id", "left_anti")
    )
    sparse = joined.filter(F.col("coverage_ratio") < sparse_below).orderBy("series_id").limit(1)
    return (
        top.withColumn("pick", F.lit("largest_dense"))
        .unionByName(low.withColumn("pick", F.lit("smallest_dense")))
        .unionByName(sparse.withColumn("pick", F.lit("first_sparse")))
    )


def network_overlay(rows: DataFrame) -> DataFrame:
    """Actual and all predictions summed per day; days without one of them are dropped."""
    summed = rows.groupBy("horizon_days", "target_date").agg(
        F.sum("y_true").alias("y_true"),
        *[F.sum(c).alias(c) for c in MODEL_PREDICTIONS.values()],
    )
    return summed.dropna(subset=["y_true", *MODEL_PREDICTIONS.values()])


def top_importance(importances: DataFrame, n: int = 5) -> DataFrame:
    ranked = Window.partitionBy("horizon_days").orderBy(F.desc("importance_mean"), "feature_name")
    return importances.withColumn("rank_position", F.row_number().over(ranked)).filter(
        F.col("rank_position") <= n
    )
