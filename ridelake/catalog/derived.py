"""Intermediate frames shared by many queries: panel, origins, predictions, comparison."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridelake.catalog.roles import Tables
from ridelake.functions import times
from ridelake.operators import analysis, backtest, calendar, features, operations, panel
from ridelake.operators.scale import materialized

ATTRIBUTES = ["linea", "estacion", "station_abbrev"]


def dense(t: Tables) -> DataFrame:
    return panel.densify(t.demand, attributes=ATTRIBUTES)


def share(t: Tables) -> None:
    """Checkpoint the origin rows once, for a query that reads them through many branches."""
    t.kept["origins"] = materialized(origins(t))


def panel_features(t: Tables) -> DataFrame:
    return panel.panel_features(dense(t))


def origins(t: Tables) -> DataFrame:
    """Origin rows of both horizons."""
    if "origins" in t.kept:
        return t.kept["origins"]
    return features.origin_rows(panel_features(t), *features.HORIZONS)


def external(t: Tables) -> DataFrame:
    """Calendar and weather table of the sample days."""
    days = calendar.weather_daily(t.readings, t.weather_codes).withColumns(
        times.calendar_parts(F.col("date"))
    )
    marked = calendar.holiday_columns(days, t.official_holidays, t.operational_holidays)
    return calendar.bridge_flag(calendar.neighbour_flags(marked)).withColumn(
        "weather_source", F.lit("openmeteo")
    )


MODELS = {
    "baseline_naive_simple": "baseline_naive_simple",
    "baseline_naive_seasonal_weekly": "baseline_naive_seasonal_weekly",
    "tabular_hgbr": "baseline_seasonal_weekday_mean_4",
}


def scored(t: Tables) -> DataFrame:
    """Origin rows of every split they are scored in, split per horizon."""
    return backtest.assign_splits(origins(t), by=["horizon_days"])


def predictions(t: Tables) -> DataFrame:
    """Long predictions; the weekday mean plays the part of the tabular model."""
    rows = scored(t).withColumns(
        {"variant": F.lit(features.STRICT), "series_policy": F.lit(features.ALL_SERIES)}
    )
    keep = [
        "variant", "series_policy", "horizon_days", "split_name", "split_type", "series_id", "linea",
        "estacion", "station_abbrev", "forecast_origin_date", "target_date", "trip_count_target",
    ]
    return backtest.run_baselines(rows.select(*keep, *MODELS.values()), MODELS)


def test_context(t: Tables) -> DataFrame:
    """Calendar, weather and synthetic event context per target date."""
    context = features.external_features(external(t))
    return context.withColumns(
        {
            "event_active_count": F.when(F.dayofyear("target_date") % 9 == 0, 1.0).otherwise(0.0),
            "event_high_impact_starting_count": F.when(F.dayofyear("target_date") % 27 == 0, 1.0).otherwise(0.0),
        }
    )


def compared(t: Tables) -> DataFrame:
    """Test rows with the seasonal baseline, two stand-in models and context."""
    rows = scored(t).filter("split_type = 'test'").select(
        "horizon_days", "forecast_origin_date", "target_date", "series_id", "linea", "estacion",
        F.col("trip_count_target").alias("y_true"),
        F.col("baseline_naive_seasonal_weekly").alias("y_pred_seasonal"),
        F.col("baseline_seasonal_weekday_mean_4").alias("y_pred_tabular_strict"),
        ((F.col("baseline_naive_simple") + F.col("baseline_seasonal_weekday_mean_4")) / 2).alias(
            "y_pred_tabular_forecastable"
        ),
    )
    return rows.join(test_context(t), "target_date", "left")


def comparison(t: Tables) -> DataFrame:
    """The compared rows with their segment flags."""
    return analysis.add_segment_flags(materialized(compared(t)))


def events(t: Tables) -> DataFrame:
    return operations.events_normalized(t.event_rows)


def mapping(t: Tables) -> DataFrame:
    return operations.event_location_mapping(t.location_matrix, t.stations)


def series_metrics(t: Tables) -> DataFrame:
    test = predictions(t).filter("split_type = 'test'")
    return backtest.forecast_metrics(test, [*backtest.SPEC_COLUMNS, "linea", "series_id"])


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison."""
    doubles = [f.name for f in df.schema.fields if f.dataType.typeName() == "double"]
    return df.withColumns({c: F.round(c, digits) for c in doubles})


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)
