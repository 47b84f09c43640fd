"""Daily weather and calendar features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridelake.functions import domain, times
from ridelake.functions.text import strip_accents
from ridelake.operators.joins import nearest_holiday

EXTENSION_RUN_ID = "auto_calendar_extension_missing_external_context"

# Event measures of the calendar table that default to zero.
EVENT_COUNT_COLUMNS = [
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
    "events_geocoded_count",
    "events_unique_venue_count",
]
EVENT_FLAG_COLUMNS = ["has_major_event", "has_multiple_major_events"]

# Scopes of a holiday.
OPERATIONAL_SCOPE = "metro_malaga_operativo"
OFFICIAL_SCOPE = "official_calendar"
OPERATIONAL_NAME = "Festivo MMO"

# Neutral flags of a day without any external context.
NEUTRAL_FLAGS = [
    "is_holiday",
    "is_holiday_mmo",
    "is_preholiday",
    "is_postholiday",
    "is_bridge_candidate",
    "is_rainy_day",
    "is_heavy_rain_day",
    "is_hot_day",
    "is_cold_day",
    "is_bad_weather_day",
    *EVENT_FLAG_COLUMNS,
]

EASTER_WORDS = (
    "semana santa|jueves santo|viernes santo|domingo de ramos|lunes santo|martes santo|miercoles santo"
)


def weather_daily(hourly: DataFrame, codes: DataFrame | None = None, ts: str = "ts") -> DataFrame:
    """Daily weather out of hourly readings, with the daily weather code (0 if missing)."""
    daily = hourly.groupBy(F.to_date(ts).alias("date")).agg(
        F.min("temp").alias("temp_min_c"),
        F.max("temp").alias("temp_max_c"),
        F.avg("temp").alias("temp_mean_c"),
        F.coalesce(F.sum("precip"), F.lit(0.0)).alias("precip_mm"),
        F.count_if(F.col("precip") > 0).cast("int").alias("rain_hours"),
        F.max("wind").alias("wind_max_kmh"),
        F.avg("wind").alias("wind_mean_kmh"),
        F.avg("humidity").alias("humidity_mean_pct"),
        F.avg("pressure").alias("pressure_mean_hpa"),
    )
    if codes is None:
        coded = daily.withColumn("weather_code", F.lit(0).cast("long"))
    else:
        coded = daily.join(codes.select("date", "weather_code"), "date", "left").withColumn(
            "weather_code", F.coalesce(F.col("weather_code").cast("long"), F.lit(0))
        )
    flags = domain.weather_flags(F.col("precip_mm"), F.col("temp_max_c"), F.col("temp_min_c"))
    return coded.withColumns(
        {"weather_summary": domain.weather_code_summary(F.col("weather_code")), **flags}
    )


def holiday_columns(
    days: DataFrame, official: DataFrame, operational: DataFrame, date: str = "date"
) -> DataFrame:
    """Holiday flag, scope, name and distances from an official and an operational calendar.

    ``official`` has ``holiday_date, holiday_name`` and ``operational`` ``holiday_date``.
    """
    named = official.groupBy("holiday_date").agg(F.max("holiday_name").alias("_official"))
    marked = operational.select("holiday_date").distinct().withColumn("_operational", F.lit(True))
    both = named.join(marked, "holiday_date", "full_outer").select(
        F.col("holiday_date").alias(date), "_official", "_operational", F.lit(True).alias("_holiday")
    )
    joined = days.join(both, date, "left")
    is_operational = F.coalesce(F.col("_operational"), F.lit(False))
    is_holiday = F.coalesce(F.col("_holiday"), F.lit(False))
    flagged = joined.withColumns(
        {
            "is_holiday": is_holiday,
            "is_holiday_mmo": is_operational,
            "holiday_scope": F.when(is_operational, OPERATIONAL_SCOPE).when(is_holiday, OFFICIAL_SCOPE),
            "holiday_name": F.coalesce("_official", F.when(is_operational, OPERATIONAL_NAME)),
        }
    ).drop("_official", "_operational", "_holiday")
    return nearest_holiday(flagged, date, both.select(F.col(date).alias("_day")), "_day")


def neighbour_flags(days: DataFrame, date: str = "date") -> DataFrame:
    """Pre- and post-holiday flags from the next and previous row of the calendar.

    Neighbours are rows, not dates. The calendar has one row per day (some 37 000 in a
    century), which bounds the ordering whatever the size of the readings behind it.
    """
    by_day = Window.orderBy(date)
    return days.withColumns(
        {
            "is_preholiday": F.lead("is_holiday", 1, False).over(by_day),
            "is_postholiday": F.lag("is_holiday", 1, False).over(by_day),
        }
    )


def bridge_flag(days: DataFrame) -> DataFrame:
    near = (F.col("days_to_next_holiday") == 1) | (F.col("days_since_prev_holiday") == 1)
    bridge = ~F.col("is_weekend") & ~F.col("is_holiday") & F.coalesce(near, F.lit(False))
    return days.withColumn("is_bridge_candidate", bridge)


def refresh_calendar(
    stored: DataFrame, fresh: DataFrame, today: Column, run_id: Column
) -> DataFrame:
    """Stored calendar up to today without the days that were fetched again, plus those.

    Event measures default to zero, the run id marks new rows, the columns keep the stored
    types and the neighbour flags are recomputed over the result.
    """
    kept = stored.filter(F.col("date") <= today).join(fresh.select("date"), "date", "left_anti")
    merged = kept.unionByName(fresh, allowMissingColumns=True)
    fills = {
        c: F.coalesce(F.col(c), F.lit(0).cast(merged.schema[c].dataType))
        for c in EVENT_COUNT_COLUMNS + EVENT_FLAG_COLUMNS
        if c in merged.columns
    }
    fills["run_id"] = F.coalesce(F.nullif(F.col("run_id"), F.lit("")), run_id)
    flagged = bridge_flag(neighbour_flags(merged.withColumns(fills)))
    return flagged.select(*[F.col(f.name).cast(f.dataType) for f in stored.schema.fields])


def extend_calendar(external: DataFrame, required: DataFrame, date: str = "date") -> DataFrame:
    """Add a neutral calendar row for every required date the table does not cover.

    Flags are false, event measures zero, weather NULL, and the run id marks the origin.
    """
    missing = required.select(F.col(date)).distinct().join(external.select(date), date, "left_anti")
    columns: dict[str, Column] = dict(times.calendar_parts(F.col(date)))
    columns.update({c: F.lit(False) for c in NEUTRAL_FLAGS})
    columns.update({c: F.lit(0) for c in EVENT_COUNT_COLUMNS})
    columns.update({"holiday_name": F.lit(""), "holiday_scope": F.lit("")})
    columns.update({"weather_source": F.lit("unavailable"), "weather_summary": F.lit("unavailable")})
    columns["run_id"] = F.lit(EXTENSION_RUN_ID)
    present = {c: v for c, v in columns.items() if c in external.columns}
    added = missing.withColumns(
        {c: v.cast(external.schema[c].dataType) for c, v in present.items()}
    )
    return external.unionByName(added, allowMissingColumns=True)


def hybrid_weather(
    archive: DataFrame, forecast: DataFrame, today: Column, archive_days: int = 30
) -> DataFrame:
    """Archive readings for days older than the archive delay, forecast for the rest."""
    split = F.date_sub(today, archive_days)
    old = archive.filter(F.col("date") < split).withColumn("weather_origin", F.lit("archive"))
    new = forecast.filter(F.col("date") >= split).withColumn("weather_origin", F.lit("forecast"))
    return old.unionByName(new)


def easter_dates(days: DataFrame, date: str, name: str) -> DataFrame:
    """Distinct days of the weeks around Maundy Thursday and Good Friday."""
    folded = strip_accents(F.lower(F.coalesce(F.col(name), F.lit(""))))
    thursday = F.when(
        folded.contains("jueves santo"), F.sequence(F.date_sub(date, 4), F.date_add(date, 4))
    )
    friday = F.when(
        folded.contains("viernes santo"), F.sequence(F.date_sub(date, 5), F.date_add(date, 3))
    )
    none = F.array().cast("array<date>")
    spans = F.concat(F.coalesce(thursday, none), F.coalesce(friday, none))
    named = days.filter(folded.rlike("jueves santo|viernes santo")).select(date, name).distinct()
    return named.select(F.explode(spans).alias("easter_date")).distinct()


def add_easter_flag(rows: DataFrame, date: str = "target_date", name: str = "calendar_holiday_name") -> DataFrame:
    """``is_semana_santa``: near an Easter holiday of the table, or named as such."""
    folded = strip_accents(F.lower(F.coalesce(F.col(name), F.lit(""))))
    marked = easter_dates(rows, date, name).withColumn("_easter", F.lit(True))
    flag = F.coalesce(F.col("_easter"), F.lit(False)) | folded.rlike(EASTER_WORDS)
    return (
        rows.join(marked, rows[date] == marked["easter_date"], "left")
        .withColumn("is_semana_santa", flag)
        .drop("easter_date", "_easter")
    )


def truncate_at_first_zero(df: DataFrame, order: str, value: str) -> DataFrame:
    """Rows before the first row, by ``order``, whose value is zero or missing."""
    first_zero = df.filter(F.coalesce(F.col(value), F.lit(0)) == 0).select(F.min(order)).scalar()
    return df.filter(first_zero.isNull() | (F.col(order) < first_zero))


def filter_weekdays(
    df: DataFrame, day: str, weekdays: Sequence[int] = (), dates: DataFrame | None = None
) -> DataFrame:
    """Weekday (Sunday = 0) and date multi-select; an empty selection selects all."""
    kept = df.filter((F.dayofweek(day) - 1).isin(*weekdays)) if weekdays else df
    if dates is None:
        return kept
    listed = dates.select(F.col(dates.columns[0]).alias(day)).distinct()
    return kept.join(listed, day, "left_semi")


def filter_overlap(df: DataFrame, start: str, end: str, range_start: Column, range_end: Column) -> DataFrame:
    return df.filter((F.col(start) <= range_end) & (F.col(end) >= range_start))
