"""Temporal splits, forecast metrics and policy selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TEST_DAYS = 180
FOLD_DAYS = 56
FOLDS = 3
MIN_HISTORY_DAYS = 365
POLICY_GAIN = 0.02
LINE_GUARDRAIL = 0.01

BASELINE_MODELS = {
    "baseline_naive_simple": "baseline_naive_simple",
    "baseline_naive_seasonal_weekly": "baseline_naive_seasonal_weekly",
}
SPEC_COLUMNS = ["model_name", "variant", "series_policy", "horizon_days"]


def _split_structs(first: Column, last: Column) -> Column:
    """Three validation folds right before the test window, as an array of structs."""
    test_start = F.date_sub(last, TEST_DAYS - 1)

    def split(name: str, kind: str, start: Column, end: Column) -> Column:
        return F.struct(
            F.lit(name).alias("split_name"),
            F.lit(kind).alias("split_type"),
            first.alias("train_start"),
            F.date_sub(start, 1).alias("train_end"),
            start.alias("score_start"),
            end.alias("score_end"),
        )

    folds = [
        split(
            f"validation_fold_{i + 1}",
            "validation",
            F.date_sub(test_start, FOLD_DAYS * (FOLDS - i)),
            F.date_sub(test_start, FOLD_DAYS * (FOLDS - i - 1) + 1),
        )
        for i in range(FOLDS)
    ]
    return F.array(*folds, split("test", "test", test_start, last))


def temporal_splits(frame: DataFrame, origin: str = "forecast_origin_date") -> DataFrame:
    """The four splits of a frame, one row each; fails at run time on too short a history."""
    bounds = frame.agg(F.min(origin).alias("lo"), F.max(origin).alias("hi"))
    history = F.datediff("hi", "lo") - (TEST_DAYS - 1) - FOLD_DAYS * FOLDS
    usable = F.when(
        history < MIN_HISTORY_DAYS, F.raise_error(F.lit("not enough history for the splits"))
    ).otherwise(F.col("lo"))
    return bounds.select(F.inline(_split_structs(usable.cast("date"), F.col("hi"))))


def assign_splits(
    frame: DataFrame,
    origin: str = "forecast_origin_date",
    *,
    by: Sequence[str] = (),
    role: str = "score",
) -> DataFrame:
    """Rows with every split in which they are scored (or, by ``role``, trained).

    The dates come from the frame's origin range, one range per ``by`` group (for example
    per horizon). Matching splits are exploded per row, so rows meet no split table.
    """
    edges = F.struct(F.min(origin).alias("lo"), F.max(origin).alias("hi"))
    if by:
        bounds = frame.groupBy(*by).agg(edges.alias("_bounds"))
        # One row per training spec: a shuffle on the few spec keys would put whole specs in
        # single tasks.
        dated = frame.join(F.broadcast(bounds), list(by))
    else:
        dated = frame.withColumn("_bounds", frame.select(edges).scalar())
    splits = _split_structs(F.col("_bounds.lo"), F.col("_bounds.hi"))
    hits = F.filter(
        splits,
        lambda s: (F.col(origin) >= s[f"{role}_start"]) & (F.col(origin) <= s[f"{role}_end"]),
    )
    return dated.withColumn("_split", F.explode(hits)).select(
        *frame.columns,
        F.col("_split.split_name").alias("split_name"),
        F.col("_split.split_type").alias("split_type"),
    )


def run_baselines(rows: DataFrame, models: dict[str, str] = BASELINE_MODELS) -> DataFrame:
    """Predictions of the baselines in long form (``model_name, y_pred, y_true``)."""
    keep = [c for c in rows.columns if c not in {*models.values(), "trip_count_target"}]
    predictions = F.array(
        *[
            F.struct(F.lit(name).alias("model_name"), F.col(column).cast("double").alias("y_pred"))
            for name, column in models.items()
        ]
    )
    return rows.select(
        *keep, F.col("trip_count_target").cast("double").alias("y_true"), F.inline(predictions)
    )


# Additive parts of every metric: they can be summed again at any coarser grain.
_PARTS = [
    "row_count",
    "available_prediction_count",
    "abs_error_sum",
    "_sq_error",
    "_abs_true",
    "_smape",
]


def metric_parts(prediction: str = "y_pred", actual: str = "y_true") -> list[Column]:
    y, p = F.col(actual), F.col(prediction)
    both = y.isNotNull() & p.isNotNull()
    error = F.abs(p - y)
    scale = F.abs(y) + F.abs(p)
    smape = F.when(scale == 0, 0.0).otherwise(2 * error / scale)
    return [
        F.count("*").alias("row_count"),
        F.count_if(both).alias("available_prediction_count"),
        F.sum(error).alias("abs_error_sum"),
        F.sum(error * error).alias("_sq_error"),
        F.sum(F.when(both, F.abs(y))).alias("_abs_true"),
        F.sum(F.when(both, smape)).alias("_smape"),
    ]


def _finish_metrics(parts: DataFrame) -> DataFrame:
    n = F.nullif(F.col("available_prediction_count"), F.lit(0))
    return parts.withColumns(
        {
            "coverage_ratio": F.col("available_prediction_count") / F.nullif(F.col("row_count"), F.lit(0)),
            "mae": F.col("abs_error_sum") / n,
            "rmse": F.sqrt(F.col("_sq_error") / n),
            "wape": F.col("abs_error_sum") / F.nullif(F.col("_abs_true"), F.lit(0.0)),
            "smape": F.col("_smape") / n,
        }
    ).drop("_sq_error", "_abs_true", "_smape")


def forecast_metrics(
    predictions: DataFrame,
    by: Sequence[str],
    prediction: str = "y_pred",
    actual: str = "y_true",
) -> DataFrame:
    """Coverage, MAE, RMSE, WAPE and sMAPE per group; NULL keys form a group."""
    return _finish_metrics(predictions.groupBy(*by).agg(*metric_parts(prediction, actual)))


def evaluate_all(predictions: DataFrame, series_columns: Sequence[str] = ("series_id",)) -> DataFrame:
    """Metrics at overall, split, line and series grain in one pass over the predictions.

    Predictions are reduced to additive parts at the finest grain first; the grouping sets
    then expand only those.
    """
    spec = SPEC_COLUMNS
    split = [*spec, "split_name", "split_type"]
    line = [*split, "linea"]
    series = [*line, *series_columns]
    finest = predictions.groupBy(*series).agg(*metric_parts())
    level = F.grouping_id(*series)
    width = len(series)

    def gid(columns: Sequence[str]) -> int:
        return 2 ** (width - len(columns)) - 1

    rolled = finest.groupingSets([spec, split, line, series], *series).agg(
        *[F.sum(p).alias(p) for p in _PARTS], level.alias("_level")
    )
    name = (
        F.when(F.col("_level") == gid(spec), "overall")
        .when(F.col("_level") == gid(split), "split")
        .when(F.col("_level") == gid(line), "line")
        .otherwise("series")
    )
    return _finish_metrics(rolled.withColumn("metric_level", name)).drop("_level")


def select_policy(
    split_metrics: DataFrame,
    line_metrics: DataFrame,
    *,
    gain: float = POLICY_GAIN,
    guardrail: float = LINE_GUARDRAIL,
) -> DataFrame:
    """Per horizon, whether excluding sparse series is worth it and hurts no line.

    Both inputs are test metrics of one model and variant with ``series_policy``,
    ``horizon_days`` and ``wape``.
    """
    def wape(policy: str) -> Column:
        return F.max(F.when(F.col("series_policy") == policy, F.col("wape")))

    network = split_metrics.groupBy("horizon_days").agg(
        wape("all_series").alias("wape_all_series"),
        wape("sparse_excluded").alias("wape_sparse_excluded"),
    )
    per_line = line_metrics.groupBy("horizon_days", "linea").agg(
        wape("all_series").alias("_all"), wape("sparse_excluded").alias("_sparse")
    )
    change = F.coalesce((F.col("_sparse") - F.col("_all")) / F.nullif(F.col("_all"), F.lit(0.0)), F.lit(0.0))
    lines = per_line.groupBy("horizon_days").agg(
        F.max(change).alias("worst_line_relative_change"),
        (F.bool_and(change <= guardrail) & (F.count("_all") > 0) & (F.count("_sparse") > 0)).alias(
            "line_guardrail_ok"
        ),
    )
    improvement = F.when(
        F.col("wape_all_series") != 0,
        (F.col("wape_all_series") - F.col("wape_sparse_excluded")) / F.col("wape_all_series"),
    ).otherwise(F.lit(0.0))
    supported = (F.col("relative_wape_improvement") >= gain) & F.col("line_guardrail_ok")
    return (
        network.join(lines, "horizon_days", "left")
        .withColumn("relative_wape_improvement", improvement)
        .withColumn("decision_supported", F.coalesce(supported, F.lit(False)))
    )


def recommended_policy(decisions: DataFrame) -> DataFrame:
    """One row: exclude sparse series only if every horizon supports it."""
    every = F.coalesce(F.bool_and("decision_supported"), F.lit(False))
    return decisions.agg(
        F.when(every, "sparse_excluded").otherwise("all_series").alias("recommended_series_policy"),
        F.count("*").alias("horizons"),
    )


def comparison_summary(split_metrics: DataFrame, policy: DataFrame | str) -> DataFrame:
    """Test rows, flagged where they belong to the final comparison (both variants)."""
    chosen = (
        F.lit(policy)
        if isinstance(policy, str)
        else policy.select("recommended_series_policy").scalar()
    )
    variants = F.col("variant").isin("strict_available", "forecastable_scenario")
    return split_metrics.filter(F.col("split_type") == "test").withColumn(
        "selected_for_final_comparison", variants & (F.col("series_policy") == chosen)
    )
