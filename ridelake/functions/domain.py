"""Weather, event and scenario rules as Spark column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weather interpretation code -> summary.
WEATHER_SUMMARIES = {
    0: "clear_sky",
    1: "mainly_clear",
    2: "partly_cloudy",
    3: "overcast",
    45: "fog",
    48: "fog",
    51: "drizzle_light",
    53: "drizzle_moderate",
    55: "drizzle_dense",
    61: "rain_slight",
    63: "rain_moderate",
    65: "rain_heavy",
    71: "snow_light",
    73: "snow_moderate",
    75: "snow_heavy",
    80: "rain_slight",
    81: "rain_moderate",
    82: "rain_heavy",
    95: "thunderstorm",
    96: "thunderstorm",
    99: "thunderstorm",
}

# Alert level by rain (mm) or wind (km/h), strongest first.
ALERT_THRESHOLDS = [("roja", 60, 90), ("naranja", 30, 70), ("amarilla", 15, 50)]
NO_ALERT = "sin_alerta"

# Words in an event category -> event type, in order of precedence.
EVENT_TYPE_WORDS = [
    ("deport", "deportivo"),
    ("congreso", "feria/congreso"),
    ("feria", "feria/congreso"),
    ("relig", "religioso"),
    ("univers", "universitario"),
]

# Attendance floor of each impact level, highest first.
IMPACT_FLOORS = [("muy alto", 15000), ("alto", 5000), ("medio", 1000)]


def weather_code_summary(code: Column) -> Column:
    pairs = [F.lit(item) for pair in WEATHER_SUMMARIES.items() for item in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), code.cast("int")), F.lit("clear_sky"))


def weather_flags(precip_mm: Column, temp_max: Column, temp_min: Column) -> dict[str, Column]:
    """Flags by threshold; a missing reading never raises a flag."""
    def flag(condition: Column) -> Column:
        return F.coalesce(condition, F.lit(False))

    return {
        "is_rainy_day": flag(precip_mm >= 1.0),
        "is_heavy_rain_day": flag(precip_mm >= 15.0),
        "is_hot_day": flag(temp_max >= 30.0),
        "is_cold_day": flag(temp_min <= 8.0),
        "is_bad_weather_day": flag(precip_mm >= 5.0),
    }


def alert_level(precip_mm: Column, wind_kmh: Column, explicit: Column | None = None) -> Column:
    """Explicit level if given, else the strongest level whose rain or wind floor is met."""
    rain = F.coalesce(precip_mm, F.lit(0.0))
    wind = F.coalesce(wind_kmh, F.lit(0.0))
    level = F.lit(NO_ALERT)
    for name, rain_floor, wind_floor in reversed(ALERT_THRESHOLDS):
        level = F.when((rain >= rain_floor) | (wind >= wind_floor), name).otherwise(level)
    if explicit is None:
        return level
    return F.coalesce(F.nullif(F.trim(explicit), F.lit("")), level)


def _plain_number(value: Column) -> Column:
    """Six significant digits without trailing zeros."""
    digits = F.greatest(F.lit(0), 5 - F.floor(F.log10(F.greatest(F.abs(value), F.lit(1e-9)))))
    scaled = F.round(value * F.pow(F.lit(10.0), digits)) / F.pow(F.lit(10.0), digits)
    text = F.format_string("%.6f", scaled)
    shown = F.regexp_replace(F.regexp_replace(text, "0+$", ""), "\\.$", "")
    return F.when(value.isNotNull(), shown)


def alert_summary(level: Column, precip_mm: Column, wind_kmh: Column) -> Column:
    """Sentence about an alert; its words are fixed values of the report."""
    pieces = F.concat_ws(
        ", ",
        F.concat(F.lit("precipitacion "), _plain_number(precip_mm), F.lit(" mm")),
        F.concat(F.lit("viento "), _plain_number(wind_kmh), F.lit(" km/h")),
    )
    shown = F.when(pieces == "", F.lit("condiciones adversas")).otherwise(pieces)
    return F.when(level == NO_ALERT, "Sin alerta meteorologica relevante.").otherwise(
        F.concat(F.lit("Alerta "), level, F.lit(": "), shown, F.lit("."))
    )


def event_type(category: Column) -> Column:
    text = F.lower(F.coalesce(category, F.lit("")))
    kind = F.when(text == "", "otro").otherwise("cultural")
    for word, name in reversed(EVENT_TYPE_WORDS):
        kind = F.when(text.contains(word), name).otherwise(kind)
    return kind


def impact_level(attendance: Column) -> Column:
    value = F.coalesce(attendance.cast("double"), F.lit(0.0))
    level = F.lit("bajo")
    for name, floor in reversed(IMPACT_FLOORS):
        level = F.when(value >= floor, name).otherwise(level)
    return level


def as_bool(value: Column) -> Column:
    """True for a non-zero number or a true flag; NULL is false."""
    return F.coalesce(value.cast("double") != 0, F.lit(False))


def positive_any(*values: Column) -> Column:
    """True when any value is above zero; unreadable and NULL count as zero."""
    checks = [F.coalesce(v.cast("double") > 0, F.lit(False)) for v in values]
    result = checks[0]
    for check in checks[1:]:
        result = result | check
    return result


def relative_improvement(reference: Column, candidate: Column, epsilon: float = 1e-9) -> Column:
    return F.when(F.abs(reference) > epsilon, (reference - candidate) / reference)


def row_hash(*names: str) -> Column:
    """SHA-256 of the key-sorted JSON of the named columns; NULLs are kept as keys."""
    ordered = F.struct(*[F.col(n) for n in sorted(names)])
    return F.sha2(F.to_json(ordered, {"ignoreNullFields": "false"}), 256)


def scenario_status(
    origin_type: Column, manual_changes: Column, accepted_items: Column, import_modified: Column
) -> Column:
    return (
        F.when((origin_type == "excel_import") & ~import_modified, "importada")
        .when(origin_type == "excel_import", "derivada")
        .when(origin_type == "derived", "derivada")
        .when(manual_changes | accepted_items, "what_if")
        .otherwise("base")
    )


def evaluated_status(status: Column, actuals_complete: Column) -> Column:
    return F.when((status == "base") & actuals_complete, "historico_evaluado").otherwise(status)


def scenario_variant(status: Column, has_events: Column, has_weather: Column) -> Column:
    contextual = status.isin("what_if", "derivada") | has_events | has_weather
    return F.when(contextual, "forecastable_scenario").otherwise("strict_available")
