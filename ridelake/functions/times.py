"""Dates, service days, clock times and numbers as Spark column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridelake.functions.text import clean_blank

MINUTES_PER_DAY = 1440

# Clock times before this minute belong to the previous service day.
SERVICE_ROLLOVER_MINUTES = 300

# Names of the weekdays, Monday first.
WEEKDAYS_ES = ["Lunes", "Martes", "Miercoles", "Jueves", "Viernes", "Sabado", "Domingo"]

# Format of a report's timestamps, seconds being optional. One pattern with an
# optional part is much cheaper than trying two, because a failed parse costs an exception.
REPORT_TIMESTAMP_FORMAT = "dd-MM-yyyy HH:mm[:ss]"


def service_date(ts: Column, boundary_hour: int = 0, boundary_minute: int = 0) -> Column:
    """Local day of an event after moving the day boundary to the given time."""
    if not boundary_hour and not boundary_minute:
        return F.to_date(ts)
    shift = F.make_interval(hours=F.lit(boundary_hour), mins=F.lit(boundary_minute))
    return F.to_date(ts - shift)


def clean_number(text: Column) -> Column:
    """Number out of free text; anything unreadable is 0.0.

    Two decimal separators (``1.234,56``) stay unreadable on purpose.
    """
    dotted = F.translate(F.coalesce(text, F.lit("0")), ",", ".")
    digits = F.nullif(F.regexp_replace(dotted, "[^\\d.\\-]", ""), F.lit(""))
    return F.coalesce(digits.try_cast("double"), F.lit(0.0))


def parse_clock(text: Column) -> Column:
    """Minutes after midnight of ``H:mm[:ss]`` or of a timestamp text, NULL if unreadable."""
    clean = clean_blank(text)
    parts = F.regexp_extract(clean, "(\\d{1,2}:\\d{2}(?::\\d{2})?)$", 1)
    hour = F.split_part(parts, F.lit(":"), F.lit(1)).try_cast("int")
    minute = F.split_part(parts, F.lit(":"), F.lit(2)).try_cast("int")
    return F.when((hour < 24) & (minute < 60), hour * 60 + minute)


def parse_service_time(text: Column, rollover_minutes: int = SERVICE_ROLLOVER_MINUTES) -> Column:
    """Struct ``(time, axis_minutes, day_offset)`` on the axis of the service day.

    A clock time before the rollover belongs to the night of the previous service day,
    so it lies beyond 24 h on that day's axis.
    """
    minutes = parse_clock(text)
    seconds = F.regexp_extract(clean_blank(text), "\\d{1,2}:\\d{2}:(\\d{2})$", 1)
    offset = F.when(minutes.isNull(), None).when(minutes < rollover_minutes, 1).otherwise(0)
    shown = F.when(
        minutes.isNotNull(),
        F.format_string(
            "%02d:%02d:%02d",
            (minutes / 60).cast("int"),
            minutes % 60,
            F.coalesce(seconds.try_cast("int"), F.lit(0)),
        ),
    )
    return F.struct(
        shown.alias("time"),
        (minutes + offset * MINUTES_PER_DAY).alias("axis_minutes"),
        offset.alias("day_offset"),
    )


def add_service_time(
    df: DataFrame, column: str, prefix: str, rollover_minutes: int = SERVICE_ROLLOVER_MINUTES
) -> DataFrame:
    """``parse_service_time`` as three plain columns ``<prefix>_time/_minutes/_day_offset``.

    Built in small steps: fields of a struct would be inlined, with the whole parse
    repeated for each, when several times of a row are needed.
    """
    clock, hour, minute, second, base = (f"_{prefix}_{x}" for x in ("clock", "h", "m", "s", "base"))
    pattern = "(\\d{1,2}:\\d{2}(?::\\d{2})?)$"

    def part(i: int) -> Column:
        return F.split_part(F.col(clock), F.lit(":"), F.lit(i)).try_cast("int")

    valid = (F.col(hour) < 24) & (F.col(minute) < 60)
    offset = F.when(F.col(base) < rollover_minutes, 1).when(F.col(base).isNotNull(), 0)
    shown = F.format_string("%02d:%02d:%02d", hour, minute, F.coalesce(F.col(second), F.lit(0)))
    return (
        df.withColumn(clock, F.regexp_extract(clean_blank(F.col(column)), pattern, 1))
        .withColumns({hour: part(1), minute: part(2), second: part(3)})
        .withColumn(base, F.when(valid, F.col(hour) * 60 + F.col(minute)))
        .withColumns(
            {
                f"{prefix}_time": F.when(F.col(base).isNotNull(), shown),
                f"{prefix}_day_offset": offset,
            }
        )
        .withColumn(f"{prefix}_minutes", F.col(base) + F.col(f"{prefix}_day_offset") * MINUTES_PER_DAY)
        .drop(clock, hour, minute, second, base)
    )


def parse_attendance(text: Column) -> Column:
    """Struct ``(value, status)`` with the first run of digits of an attendance text."""
    clean = clean_blank(text)
    digits = F.regexp_extract(F.translate(clean, ". ", ""), "(\\d+)", 1)
    value = digits.try_cast("long")
    status = (
        F.when(clean.isNull(), "missing").when(value.isNull(), "unparseable_text").otherwise("parsed")
    )
    return F.struct(value.alias("value"), status.alias("status"))


def parse_delay_seconds(text: Column) -> Column:
    """Seconds of ``mm:ss`` text, NULL for any other shape."""
    parts = F.split(clean_blank(text), ":")
    minutes = F.get(parts, F.lit(0)).try_cast("int")
    seconds = F.get(parts, F.lit(1)).try_cast("int")
    return F.when(F.size(parts) == 2, minutes * 60 + seconds)


def combine_date_time(day: Column, clock: Column) -> Column:
    """Timestamp of a date and a clock text, NULL if the clock is unreadable."""
    both = F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit(" "), F.trim(clock))
    return F.try_to_timestamp(both, F.lit("yyyy-MM-dd HH:mm[:ss]"))


def rolled_end(start: Column, end: Column) -> Column:
    """End moved one day ahead when it lies before its start."""
    return F.when(end < start, end + F.expr("INTERVAL 1 DAY")).otherwise(end)


def end_was_rolled(start: Column, end: Column) -> Column:
    return F.coalesce(end < start, F.lit(False))


def duration_minutes(start: Column, end: Column, digits: int) -> Column:
    """Minutes between two timestamps, rounded half to even."""
    seconds = F.timestamp_diff("SECOND", start, end)
    return F.bround(seconds / 60.0, digits)


def weekday_number(day: Column, zero_based: bool = False) -> Column:
    """1 to 7 from Monday, or 0 to 6."""
    base = F.weekday(day)
    return base if zero_based else base + 1


def calendar_parts(day: Column, zero_based_weekday: bool = False) -> dict[str, Column]:
    """Calendar columns of a date, by name.

    ``year_week`` pairs the calendar year with the ISO week on purpose: 2024-12-30 is
    ``2024-01``.
    """
    return {
        "year": F.year(day),
        "month": F.month(day),
        "day": F.dayofmonth(day),
        "quarter": F.quarter(day),
        "week_of_year": F.weekofyear(day),
        "day_of_year": F.dayofyear(day),
        "day_of_week": weekday_number(day, zero_based_weekday),
        "day_of_week_name": F.date_format(day, "EEEE"),
        "is_weekend": F.weekday(day) >= 5,
        "is_month_start": F.dayofmonth(day) == 1,
        "is_month_end": F.last_day(day) == day,
        "year_month": F.date_format(day, "yyyy-MM"),
        "year_week": F.concat(F.year(day).cast("string"), F.lit("-"), F.lpad(F.weekofyear(day).cast("string"), 2, "0")),
    }


def week_label(day: Column) -> Column:
    """``YYYY-Www`` by Mondays: the year is that of the Monday, and week 1 starts at the
    Monday on or before 1 January of that year (not ISO)."""
    monday = F.date_sub(day, F.weekday(day))
    first = F.make_date(F.year(monday), F.lit(1), F.lit(1))
    first_monday = F.date_sub(first, F.weekday(first))
    week = (F.datediff(monday, first_monday) / 7).cast("int") + 1
    return F.concat(F.year(monday).cast("string"), F.lit("-W"), F.lpad(week.cast("string"), 2, "0"))


def weekday_name_es(day: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in WEEKDAYS_ES]), F.weekday(day) + 1)


def parse_report_timestamp(text: Column) -> Column:
    return F.try_to_timestamp(text, F.lit(REPORT_TIMESTAMP_FORMAT))
