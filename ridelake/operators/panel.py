"""Gap-preserving daily panel and its window features.

Every window of this module partitions by the series (or by the series and something
more), so one shuffle on the series key serves the whole feature set. A series has at most
one row per day, which bounds every window partition by the number of days.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridelake.operators.joins import asof_join

LAG_DAYS = [1, 7, 14, 28]
ROLLING_DAYS = [7, 28]

SERIES_ATTRIBUTES = [
    "series_label",
    "linea",
    "estacion",
    "station_abbrev",
    "station_join_key",
    "network_order",
    "zone",
    "station_group",
    "is_interchange_candidate",
]


def _series(*more: str) -> Window:
    return Window.partitionBy("series_id", *more).orderBy("service_date")


def densify(
    series: DataFrame, value: str = "trip_count", attributes: Sequence[str] = ()
) -> DataFrame:
    """One row per day between the first and last observation of each series.

    Missing days carry a NULL value. Each observed row is stretched to the day before the
    next observation, so no calendar has to be joined. Attributes are the first non-NULL
    ones of the series by date.
    """
    whole = _series().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # NaN means missing in the inputs this table is read from.
    clean = F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double"))
    spread = series.select(
        "series_id",
        "service_date",
        clean.alias("_value"),
        *[F.first(a, ignorenulls=True).over(whole).alias(a) for a in attributes],
        F.coalesce(
            F.date_sub(F.lead("service_date").over(_series()), 1), F.col("service_date")
        ).alias("_until"),
    )
    days = spread.withColumn("_day", F.explode(F.sequence("service_date", "_until")))
    return days.select(
        "series_id",
        F.col("_day").alias("service_date"),
        *attributes,
        F.when(F.col("_day") == F.col("service_date"), F.col("_value")).alias("observed_target_value"),
    )


def forward_fill(panel: DataFrame) -> DataFrame:
    """Latest observed value on or before each day and its age in days."""
    upto = _series().rowsBetween(Window.unboundedPreceding, 0)
    seen = F.when(F.col("observed_target_value").isNotNull(), F.col("service_date"))
    return panel.withColumns(
        {
            "target_latest_observed_value": F.last("observed_target_value", True).over(upto),
            "_latest_date": F.last(seen, True).over(upto),
        }
    ).withColumns(
        {"target_days_since_latest_observation": F.datediff("service_date", "_latest_date")}
    ).drop("_latest_date")


def lags(panel: DataFrame, days: Sequence[int] = LAG_DAYS) -> DataFrame:
    return panel.withColumns(
        {f"target_lag_{n}": F.lag("observed_target_value", n).over(_series()) for n in days}
    )


def rolling(panel: DataFrame, windows: Sequence[int] = ROLLING_DAYS) -> DataFrame:
    """Mean, sample deviation and count of the observed values of the last n days.

    The frame includes the day itself; the label always lies after it.
    """
    columns: dict[str, Column] = {}
    for n in windows:
        frame = _series().rowsBetween(-(n - 1), 0)
        columns[f"target_rolling_mean_{n}"] = F.avg("observed_target_value").over(frame)
        columns[f"target_rolling_std_{n}"] = F.stddev_samp("observed_target_value").over(frame)
        columns[f"target_observed_count_{n}"] = F.count("observed_target_value").over(frame)
    return panel.withColumns(columns)


def panel_features(panel: DataFrame) -> DataFrame:
    """All autoregressive features of the dense panel."""
    return rolling(lags(forward_fill(panel)))


def weekday_mean_4(history: DataFrame) -> DataFrame:
    """Mean and count of the last four observed values of the series on that weekday.

    ``history`` holds observed rows only.
    """
    same_day = (
        Window.partitionBy("series_id", "observed_day_of_week")
        .orderBy("observed_date")
        .rowsBetween(-3, 0)
    )
    return history.withColumns(
        {
            "weekday_mean_4": F.avg("observed_target_value").over(same_day),
            "weekday_mean_4_count": F.count("observed_target_value").over(same_day),
        }
    )


def observed_history(panel: DataFrame) -> DataFrame:
    return panel.filter(F.col("observed_target_value").isNotNull()).select(
        "series_id",
        F.col("service_date").alias("observed_date"),
        F.weekday("service_date").alias("observed_day_of_week"),
        "observed_target_value",
    )


def asof_same_weekday(rows: DataFrame, history: DataFrame) -> DataFrame:
    """Last value observed on the target's weekday on or before the forecast origin.

    General form for any set of (series, origin, target) rows; on the dense panel
    ``naive_baselines`` gets the same columns without a union.
    """
    enriched = weekday_mean_4(history).select(
        "series_id",
        F.col("observed_day_of_week").alias("target_day_of_week"),
        F.col("observed_date").alias("baseline_naive_seasonal_reference_date"),
        F.col("observed_target_value").alias("baseline_naive_seasonal_weekly"),
        F.col("weekday_mean_4").alias("baseline_seasonal_weekday_mean_4"),
        F.col("weekday_mean_4_count").alias("baseline_seasonal_weekday_mean_4_reference_count"),
    )
    return asof_join(
        rows,
        enriched,
        ["series_id", "target_day_of_week"],
        "forecast_origin_date",
        "baseline_naive_seasonal_reference_date",
        [
            "baseline_naive_seasonal_weekly",
            "baseline_naive_seasonal_reference_date",
            "baseline_seasonal_weekday_mean_4",
            "baseline_seasonal_weekday_mean_4_reference_count",
        ],
    ).withColumn(
        "baseline_seasonal_weekday_mean_4_reference_date",
        F.col("baseline_naive_seasonal_reference_date"),
    )


def naive_baselines(panel: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """Label and naive, seasonal and weekday-mean baselines per origin and horizon.

    ``panel`` is dense and forward-filled; rows without a label are dropped. On a dense
    panel the newest day with the target's weekday is a fixed number of rows back, so the
    as-of search is a fill along each weekday followed by a lag. All horizons are taken
    from one pass over the windows and exploded afterwards.
    """
    by_weekday = _series("_dow").rowsBetween(Window.unboundedPreceding, 0)
    recent = (
        Window.partitionBy("series_id", "_dow", "_seen").orderBy("service_date").rowsBetween(-3, 0)
    )
    value = F.col("observed_target_value")
    marked = panel.withColumns({"_dow": F.weekday("service_date"), "_seen": value.isNotNull()})
    hits = marked.withColumn(
        "_hit",
        F.when(
            F.col("_seen"),
            F.struct(
                value.alias("value"),
                F.col("service_date").alias("day"),
                F.avg(value).over(recent).alias("mean"),
                F.count(value).over(recent).alias("n"),
            ),
        ),
    )
    filled = hits.withColumn("_hit", F.last("_hit", True).over(by_weekday))
    shifted: dict[str, Column] = {}
    for h in horizons:
        back = -h % 7
        shifted[f"_hit_{h}"] = F.lag("_hit", back).over(_series()) if back else F.col("_hit")
        shifted[f"_label_{h}"] = F.lead(value, h).over(_series())
    naive = F.col("target_latest_observed_value")
    naive_day = F.date_sub("service_date", F.col("target_days_since_latest_observation"))
    per_horizon = F.array(
        *[
            F.struct(
                F.lit(h).alias("horizon_days"),
                F.date_add("service_date", h).alias("target_date"),
                F.col(f"_label_{h}").alias("trip_count_target"),
                F.col(f"_hit_{h}.value").alias("baseline_naive_seasonal_weekly"),
                F.col(f"_hit_{h}.day").alias("baseline_naive_seasonal_reference_date"),
                F.col(f"_hit_{h}.mean").alias("baseline_seasonal_weekday_mean_4"),
                F.col(f"_hit_{h}.day").alias("baseline_seasonal_weekday_mean_4_reference_date"),
                F.col(f"_hit_{h}.n").alias("baseline_seasonal_weekday_mean_4_reference_count"),
            )
            for h in horizons
        ]
    )
    labelled = F.filter(per_horizon, lambda s: s["trip_count_target"].isNotNull())
    return (
        filled.withColumns(shifted)
        .withColumn("_h", F.explode(labelled))
        .select(
            *panel.columns,
            naive.alias("baseline_naive_simple"),
            F.when(naive.isNotNull(), naive_day).alias("baseline_naive_simple_reference_date"),
            "_h.*",
        )
    )


def longest_gap(panel: DataFrame) -> DataFrame:
    """Longest run of missing days per series."""
    upto = _series().rowsBetween(Window.unboundedPreceding, 0)
    runs = panel.withColumn("_run", F.count("observed_target_value").over(upto))
    per_run = runs.groupBy("series_id", "_run").agg(
        F.count_if(F.col("observed_target_value").isNull()).alias("_gap")
    )
    return per_run.groupBy("series_id").agg(F.max("_gap").alias("max_gap_days"))


def panel_diagnostics(panel: DataFrame, attributes: Sequence[str] = ()) -> DataFrame:
    """Observation span, missing days, coverage and longest gap per series."""
    bounds = panel.select(F.struct(F.min("service_date").alias("lo"), F.max("service_date").alias("hi")))
    upto = _series().rowsBetween(Window.unboundedPreceding, 0)
    seen = F.col("observed_target_value").isNotNull()
    day = F.when(seen, F.col("service_date"))
    per_run = (
        panel.withColumn("_run", F.count("observed_target_value").over(upto))
        .groupBy("series_id", "_run")
        .agg(
            *[F.first(a, ignorenulls=True).alias(a) for a in attributes],
            F.min(day).alias("_first"),
            F.max(day).alias("_last"),
            F.count_if(seen).alias("_seen"),
            F.count("*").alias("_days"),
        )
    )
    per_series = per_run.groupBy("series_id").agg(
        *[F.first(a, ignorenulls=True).alias(a) for a in attributes],
        F.min("_first").alias("first_observed_date"),
        F.max("_last").alias("last_observed_date"),
        F.sum("_seen").alias("observed_days"),
        F.sum("_days").alias("calendar_span_days"),
        F.max(F.col("_days") - F.col("_seen")).alias("max_gap_days"),
    )
    edge = bounds.scalar()
    return per_series.withColumns(
        {
            "pre_observation_days": F.datediff("first_observed_date", edge["lo"]),
            "post_observation_days": F.datediff(edge["hi"], "last_observed_date"),
            "intra_span_missing_days": F.col("calendar_span_days") - F.col("observed_days"),
            "coverage_ratio": F.col("observed_days") / F.col("calendar_span_days"),
        }
    )


def series_metadata(series: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """First non-NULL attributes by date and the observed date range per series."""
    return series.groupBy("series_id").agg(
        *[
            F.min_by(a, F.when(F.col(a).isNotNull(), F.col("service_date"))).alias(a)
            for a in attributes
        ],
        F.min("service_date").alias("first_date"),
        F.max("service_date").alias("last_date"),
    )


def latest_per_series(rows: DataFrame, date: str = "target_date") -> DataFrame:
    """The row of the newest date of each series, as a mergeable aggregate.

    Of rows with one date, the smallest horizon wins, then the newest origin.
    """
    rest = [c for c in rows.columns if c != "series_id"]
    order = [F.col(date)]
    if "horizon_days" in rows.columns:
        order.append(-F.col("horizon_days"))
    if "forecast_origin_date" in rows.columns:
        order.append(F.col("forecast_origin_date"))
    newest = rows.filter(F.col("series_id").isNotNull()).groupBy("series_id").agg(
        F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    )
    return newest.select("series_id", "_row.*")


def history_dedup(rows: DataFrame, order: str) -> DataFrame:
    """Last non-NULL target of every (series, date), by ``order``."""
    return (
        rows.filter(F.col("trip_count_target").isNotNull())
        .groupBy("series_id", F.col("target_date").alias("observed_date"))
        .agg(F.max_by("trip_count_target", order).alias("observed_target_value"))
    )


def serving_history_features(
    history: DataFrame,
    origins: DataFrame,
    *,
    lag_days: Sequence[int] = LAG_DAYS,
    windows: Sequence[int] = ROLLING_DAYS,
    frame: str = "observations",
) -> DataFrame:
    """History features at forecast origins that need not be observed days.

    With ``frame="observations"`` a window is the last n observed rows and with ``"days"``
    the last n calendar days; lags are always by date.
    """
    ordered = Window.partitionBy("series_id").orderBy("observed_date")
    columns: dict[str, Column] = {}
    for n in windows:
        if frame == "observations":
            span = ordered.rowsBetween(-(n - 1), 0)
            columns[f"target_rolling_mean_{n}"] = F.avg("observed_target_value").over(span)
            columns[f"target_rolling_std_{n}"] = F.stddev_samp("observed_target_value").over(span)
            columns[f"target_observed_count_{n}"] = F.count("observed_target_value").over(span)
    rolled = history.withColumns(columns) if columns else history
    hit = rolled.withColumnRenamed("observed_target_value", "target_latest_observed_value")
    values = ["target_latest_observed_value", "observed_date", *columns]
    at_origin = asof_join(
        origins, hit, ["series_id"], "forecast_origin_date", "observed_date", values
    ).withColumn(
        "target_days_since_latest_observation", F.datediff("forecast_origin_date", "observed_date")
    ).drop("observed_date")
    if frame == "days":
        # One window over origins and history together, in day units.
        for n in windows:
            recent = Window.partitionBy("series_id").orderBy("_n").rangeBetween(-(n - 1), 0)
            both = at_origin.withColumns(
                {"_n": F.unix_date("forecast_origin_date"), "_y": F.lit(None).cast("double"), "_o": F.lit(True)}
            ).unionByName(
                history.select(
                    "series_id",
                    F.unix_date("observed_date").alias("_n"),
                    F.col("observed_target_value").cast("double").alias("_y"),
                    F.lit(False).alias("_o"),
                ),
                allowMissingColumns=True,
            )
            at_origin = (
                both.withColumns(
                    {
                        f"target_rolling_mean_{n}": F.avg("_y").over(recent),
                        f"target_rolling_std_{n}": F.stddev_samp("_y").over(recent),
                        f"target_observed_count_{n}": F.count("_y").over(recent),
                    }
                )
                .filter("_o")
                .drop("_n", "_y", "_o")
            )
    # A lag is the value observed exactly n days before the origin: one equi-join for all.
    wanted = history.select(
        F.col("series_id").alias("_s"),
        F.explode(F.array(*[F.lit(n) for n in lag_days])).alias("_lag"),
        "observed_date",
        "observed_target_value",
    ).withColumn("_origin", F.date_add("observed_date", F.col("_lag")))
    lagged = wanted.groupBy("_s", "_origin").agg(
        *[
            F.max(F.when(F.col("_lag") == n, F.col("observed_target_value"))).alias(f"target_lag_{n}")
            for n in lag_days
        ]
    )
    condition = (F.col("series_id") == F.col("_s")) & (F.col("forecast_origin_date") == F.col("_origin"))
    return at_origin.join(lagged, condition, "left").drop("_s", "_origin")


def cumulative(daily: DataFrame, day: str, value: str) -> DataFrame:
    """Running total and year-to-date total of a daily series; NULL counts as zero.

    ``daily`` has one row per day, so the running total orders as many rows as there are
    calendar days.
    """
    amount = F.coalesce(F.col(value), F.lit(0))
    upto = Window.orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    in_year = Window.partitionBy("_y").orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    return (
        daily.withColumn("_y", F.year(day))
        .withColumns({"year_to_date": F.sum(amount).over(in_year), "running_total": F.sum(amount).over(upto)})
        .drop("_y")
    )


def smoke_rows(rows: DataFrame, per_origin: int, dates: DataFrame | None = None) -> DataFrame:
    """First rows by series of the two newest origins, or the rows of requested dates."""
    if dates is not None:
        return rows.join(dates.select("target_date").distinct(), "target_date", "left_semi")
    newest = (
        rows.select("forecast_origin_date").distinct().orderBy(F.desc("forecast_origin_date")).limit(2)
    )
    ranked = Window.partitionBy("forecast_origin_date").orderBy("series_id", "target_date")
    # ``newest`` has two rows.
    return (
        rows.join(F.broadcast(newest), "forecast_origin_date", "left_semi")
        .withColumn("_i", F.row_number().over(ranked))
        .filter(F.col("_i") <= per_origin)
        .drop("_i")
    )
