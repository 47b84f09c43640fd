"""What-if scenarios: context, overrides, roll-ups, comparison and checks.

Every function takes any number of scenarios at once; ``execution_id`` is one more key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridelake.functions import domain, text, times
from ridelake.operators.joins import one_per_slot

LONG_RANGE_DAYS = 31
REASONABLE_HORIZON_DAYS = 14
BASELINE_VARIANT_PREFIX = "baseline"

# Order of prediction sources, best first, without and with recomputation.
SOURCE_ORDER = ["historical", "model_inference", "precomputed_future_forecast"]
RECOMPUTE_ORDER = ["model_inference", "historical", "precomputed_future_forecast"]

LEVELS = ["network", "line", "network_date", "line_date", "station"]


def filter_scope(
    rows: DataFrame,
    start: str,
    end: str,
    *,
    variant: str | None = None,
    model_name: str | None = None,
    date: str = "target_date",
) -> DataFrame:
    """Rows of an inclusive date range, a model variant and a model."""
    kept = rows.filter(F.col(date).between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    column = next((c for c in ("model_variant", "variant") if c in rows.columns), None)
    if variant is not None and column:
        kept = kept.filter(F.col(column) == variant)
    if model_name is not None and "model_name" in rows.columns:
        kept = kept.filter(F.col("model_name") == model_name)
    return kept


def scenario_rollup(rows: DataFrame, by: Sequence[str] = ("execution_id",)) -> DataFrame:
    """Prediction and actual sums at five levels; the station level merges lines.

    Rows are summed per (date, line, station) first, so the grouping sets expand sums and
    not raw rows. Actuals stay NULL where a level has none.
    """
    by = [c for c in by if c in rows.columns]
    keys = ["target_date", "linea", "estacion"]
    finest = rows.groupBy(*by, *keys).agg(F.sum("y_pred").alias("_p"), F.sum("y_real").alias("_r"))
    sets = [by, [*by, "linea"], [*by, "target_date"], [*by, "target_date", "linea"], [*by, "estacion"]]
    bits = F.grouping_id(*by, *keys)
    level = (
        F.when(F.col("_gid") == 7, "network")
        .when(F.col("_gid") == 5, "line")
        .when(F.col("_gid") == 3, "network_date")
        .when(F.col("_gid") == 1, "line_date")
        .otherwise("station")
    )
    rolled = finest.groupingSets(sets, *by, *keys).agg(
        F.round(F.sum("_p"), 6).alias("y_pred"), F.round(F.sum("_r"), 6).alias("y_real"), bits.alias("_gid")
    )
    abs_error = F.round(F.abs(F.col("y_pred") - F.col("y_real")), 6)
    return (
        rolled.withColumn("level", level)
        .withColumn("abs_error", abs_error)
        .withColumns(
            {
                "pct_error": F.round(F.col("abs_error") / F.nullif(F.col("y_real"), F.lit(0.0)), 12),
                "real_available": F.col("y_real").isNotNull(),
            }
        )
        .drop("_gid")
    )


def compare_scenarios(base: DataFrame, candidate: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Differences of two roll-ups on their common (level, date, line, station) keys.

    ``pairs`` names the executions to compare (``base_id``, ``candidate_id``, one row per
    pair); without it every execution is compared with itself in the other roll-up. The keys
    hold NULLs: both sides are stacked and paired by one grouped aggregation, which treats
    NULL keys as equal. Two rows of one side on one key are an error.
    """
    keys = ["base_id", "candidate_id", "level", "target_date", "linea", "estacion"]

    def side(frame: DataFrame, own: str, other: str, slot: int) -> DataFrame:
        if pairs is None:
            execution = F.col("execution_id") if "execution_id" in frame.columns else F.lit(None).cast("string")
            named = frame.withColumns({own: execution, other: execution})
        else:
            named = frame.withColumnRenamed("execution_id", own).join(pairs.select(own, other), own)
        return named.select(*keys, "y_pred", F.lit(slot).alias("_slot"))

    stacked = side(base, "base_id", "candidate_id", 0).unionByName(side(candidate, "candidate_id", "base_id", 1))

    def pick(slot: int) -> Column:
        return F.max(F.when(F.col("_slot") == slot, F.col("y_pred")))

    paired = stacked.groupBy(*keys).agg(
        pick(0).alias("base_y_pred"),
        pick(1).alias("candidate_y_pred"),
        F.count_if(F.col("_slot") == 0).alias("_a"),
        F.count_if(F.col("_slot") == 1).alias("_b"),
    )
    once = one_per_slot(F.greatest("_a", "_b"), "scenario comparison")
    delta = F.round(F.col("candidate_y_pred") - F.col("base_y_pred"), 6)
    return (
        paired.filter((F.col("_a") > 0) & (F.col("_b") > 0) & once)
        .drop("_a", "_b")
        .withColumn("delta_abs", delta)
        .withColumn("delta_pct", F.round(F.col("delta_abs") / F.nullif(F.col("base_y_pred"), F.lit(0.0)), 12))
    )


def enrich_actuals(aggregates: DataFrame, demand: DataFrame) -> DataFrame:
    """Replace day actuals by the demand history and recompute each execution's network total.

    ``demand`` has one row per ``target_date`` with ``actual``.
    """
    day_level = F.col("level") == "network_date"
    joined = aggregates.join(demand.select("target_date", "actual"), "target_date", "left").withColumn(
        "y_real", F.when(day_level, F.coalesce("actual", "y_real")).otherwise(F.col("y_real"))
    )
    totals = (
        joined.filter(day_level)
        .groupBy(F.col("execution_id").alias("_execution"))
        .agg(F.round(F.sum("y_real"), 6).alias("_total"))
    )
    renewed = joined.join(totals, F.col("execution_id").eqNullSafe(F.col("_execution")), "left").withColumn(
        "y_real", F.when(F.col("level") == "network", F.coalesce("_total", "y_real")).otherwise(F.col("y_real"))
    )
    return renewed.withColumns(
        {
            "abs_error": F.round(F.abs(F.col("y_pred") - F.col("y_real")), 6),
            "real_available": F.col("y_real").isNotNull(),
        }
    ).withColumn(
        "pct_error", F.round(F.col("abs_error") / F.nullif(F.col("y_real"), F.lit(0.0)), 12)
    ).drop("actual", "_execution", "_total")


def time_buckets(
    rows: DataFrame, grain: str = "day", date: str = "target_date", by: Sequence[str] = ()
) -> DataFrame:
    """Prediction and actual sums per day or per Monday week; actual NULL if there is none."""
    label = times.week_label(F.col(date)) if grain == "week" else F.date_format(date, "yyyy-MM-dd")
    return rows.groupBy(*by, label.alias("bucket")).agg(
        F.sum("y_pred").alias("y_pred"), F.sum("y_real").alias("y_real")
    )


def station_ranking(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Prediction and actual sums per station, the largest predictions first."""
    return (
        rows.groupBy(*by, "estacion")
        .agg(F.sum("y_pred").alias("y_pred"), F.sum("y_real").alias("y_real"))
        .orderBy(*by, F.desc("y_pred"), "estacion")
    )


def priority_union(sources: dict[str, DataFrame], *, recompute: bool = False) -> DataFrame:
    """One row per (date, series) from the best source that has it.

    The winner is a minimum over a priority, so sources are merged on the map side too.
    """
    order = RECOMPUTE_ORDER if recompute else SOURCE_ORDER
    stacked = None
    for priority, name in enumerate(n for n in order if n in sources):
        part = sources[name].withColumns({"prediction_source": F.lit(name), "_priority": F.lit(priority)})
        stacked = part if stacked is None else stacked.unionByName(part, allowMissingColumns=True)
    rest = [c for c in stacked.columns if c not in ("target_date", "series_id", "_priority")]
    best = stacked.groupBy("target_date", "series_id").agg(
        F.min_by(F.struct(*rest), "_priority").alias("_row")
    )
    return best.select("target_date", "series_id", "_row.*").withColumn(
        "is_fallback", F.col("prediction_source") == SOURCE_ORDER[-1]
    )


def event_match(series: DataFrame, events: DataFrame) -> DataFrame:
    """Active and high-impact events per (date, series).

    An event is active on its selected dates, or between its start and end, and touches a
    station by id, code or name, or all of them. Events are exploded to (date, station
    word) rows, so the match is an equi-join and not a comparison of all pairs.
    """
    span = F.sequence("start_date", F.coalesce("end_date", "start_date"))
    days = F.when(F.size("selected_dates") > 0, F.col("selected_dates")).otherwise(span)
    spread = (
        events.filter(~F.coalesce(F.col("deleted"), F.lit(False)))
        .select(
            "event_id",
            F.col("impact_level").isin("alto", "muy alto").alias("_high"),
            "affected_stations",
            F.explode(F.array_distinct(days)).alias("target_date"),
        )
    )
    everywhere = F.array_contains("affected_stations", "all")
    network = (
        spread.filter(everywhere)
        .groupBy("target_date")
        .agg(F.count("*").alias("_all_n"), F.count_if("_high").alias("_all_high"))
    )
    words = (
        spread.filter(~everywhere)
        .select("target_date", "event_id", "_high", F.explode("affected_stations").alias("_word"))
        .distinct()
    )
    keyed = series.select(
        "target_date", "series_id", F.explode(F.array_distinct(F.array("series_id", "station_abbrev", "estacion"))).alias("_word")
    )
    local = (
        keyed.join(words, ["target_date", "_word"])
        .select("target_date", "series_id", "event_id", "_high")
        .distinct()
        .groupBy("target_date", "series_id")
        .agg(F.count("*").alias("_n"), F.count_if("_high").alias("_n_high"))
    )
    def both(a: str, b: str) -> Column:
        return (F.coalesce(F.col(a), F.lit(0)) + F.coalesce(F.col(b), F.lit(0))).cast("double")

    joined = series.join(network, "target_date", "left").join(local, ["target_date", "series_id"], "left")
    return joined.withColumns(
        {
            "event_active_count": both("_all_n", "_n"),
            "event_starting_count": both("_all_n", "_n"),
            "event_ending_count": F.lit(0.0),
            "event_starting_estimated_attendance_sum": F.lit(0.0),
            "event_starting_unknown_attendance_count": both("_all_n", "_n"),
            "event_high_impact_starting_count": both("_all_high", "_n_high"),
        }
    ).drop("_all_n", "_all_high", "_n", "_n_high")


def override_join(rows: DataFrame, overrides: DataFrame, columns: Sequence[str], date: str = "target_date") -> DataFrame:
    """Per-date overrides win over automatic values, with a provenance column."""
    side = overrides.select(date, *[F.col(c).alias(f"_o_{c}") for c in columns], F.lit(True).alias("_hit"))
    joined = rows.join(side, date, "left")
    return joined.withColumns(
        {
            **{c: F.coalesce(f"_o_{c}", c) for c in columns},
            "value_origin": F.when(F.col("_hit"), "override").otherwise("automatic"),
        }
    ).drop("_hit", *[f"_o_{c}" for c in columns])


def catalog_enrich(predictions: DataFrame, catalog: DataFrame) -> DataFrame:
    """Fill missing line, station, code and order from the station catalogue.

    Rows without a prediction are dropped.
    """
    columns = ["linea", "estacion", "station_abbrev", "network_order"]
    side = catalog.select("series_id", *[F.col(c).alias(f"_c_{c}") for c in columns])
    kept = predictions.filter(F.col("y_pred").isNotNull()).join(side, "series_id", "left")
    return kept.withColumns(
        {
            c: F.coalesce(F.col(c), F.col(f"_c_{c}")) if c in predictions.columns else F.col(f"_c_{c}")
            for c in columns
        }
    ).drop(*[f"_c_{c}" for c in columns])


def collapse_event_dates(rows: DataFrame) -> DataFrame:
    """One row per event with its sorted distinct dates and first attributes by date."""
    return rows.groupBy("event_id").agg(
        F.array_sort(F.collect_set("target_date")).alias("selected_dates"),
        *[
            F.min_by(c, F.col("target_date")).alias(c)
            for c in rows.columns
            if c not in ("event_id", "target_date")
        ],
    )


def scenario_columns(scenarios: DataFrame) -> DataFrame:
    """Status and model variant of each scenario."""
    status = domain.scenario_status(
        F.col("origin_type"), F.col("manual_changes"), F.col("accepted_items"), F.col("import_modified")
    )
    base = scenarios.withColumn("status", status)
    variant = domain.scenario_variant(F.col("status"), F.col("has_events"), F.col("has_weather"))
    return base.withColumn("variant", variant)


# Context snapshot and checks ---------------------------------------------------------------


def snapshot_coverage(
    scenarios: DataFrame, calendar: DataFrame, events: DataFrame, weather: DataFrame
) -> DataFrame:
    """Distinct days with calendar, event and weather context per scenario range.

    Each scenario is spread over its days and met by one equi-join per source; sources are
    reduced to their distinct days before.
    """
    days = scenarios.select(
        "execution_id", "range_start", "range_end",
        F.explode(F.sequence("range_start", "range_end")).alias("target_date"),
    )
    for name, frame in (("calendar", calendar), ("event", events), ("weather", weather)):
        known = frame.select("target_date").distinct().withColumn(f"_{name}", F.lit(True))
        days = days.join(known, "target_date", "left")
    return days.groupBy("execution_id", "range_start", "range_end").agg(
        F.count("*").alias("total_days"),
        F.count("_calendar").alias("calendar_days"),
        F.count("_event").alias("event_days"),
        F.count("_weather").alias("weather_days"),
    )


def range_warnings(
    coverage: DataFrame,
    long_range_days: int = LONG_RANGE_DAYS,
    horizon_days: int = REASONABLE_HORIZON_DAYS,
) -> DataFrame:
    """Warning codes per scenario from its range and coverage."""
    span = F.datediff("range_end", "range_start") + 1
    rules = {
        "long_range": span > long_range_days,
        "missing_events": F.col("event_days") < F.col("total_days"),
        "missing_future_weather": F.col("weather_days") < F.col("total_days"),
        "calendar_only": (F.col("calendar_days") == F.col("total_days"))
        & (F.col("event_days") == 0)
        & (F.col("weather_days") == 0),
        "model_horizon_exceeded": span > horizon_days,
    }
    codes = F.filter(
        F.array(*[F.when(hit, F.lit(code)) for code, hit in rules.items()]), lambda c: c.isNotNull()
    )
    return coverage.select("execution_id", F.explode(codes).alias("warning_code"))


def prediction_completeness(rows: DataFrame, scenarios: DataFrame, catalog: DataFrame) -> DataFrame:
    """Flags per scenario: no rows, dates other than the range, days with too few series."""
    expected = catalog.select(F.countDistinct("series_id")).scalar()
    per_day = rows.groupBy("execution_id", "target_date").agg(
        F.countDistinct("series_id").alias("_series")
    )
    in_range = F.col("target_date").between(F.col("range_start"), F.col("range_end"))
    return (
        scenarios.select("execution_id", "range_start", "range_end")
        .join(per_day, "execution_id", "left")
        .groupBy("execution_id", "range_start", "range_end")
        .agg(
            F.count_if(in_range).alias("_inside"),
            F.count("target_date").alias("_days"),
            F.min("_series").alias("_fewest"),
        )
        .withColumns(
            {
                "model_predictions_unavailable": F.col("_days") == 0,
                "model_prediction_partial": (F.col("_days") > 0)
                & (
                    (F.col("_inside") != F.datediff("range_end", "range_start") + 1)
                    | (F.col("_days") != F.col("_inside"))
                ),
                "model_series_partial": F.coalesce(F.col("_fewest") < expected, F.lit(False)),
            }
        )
        .drop("_inside", "_days", "_fewest", "range_start", "range_end")
    )


def historical_complete(rows: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Whether every expected date of a scenario has an actual."""
    known = rows.filter(F.col("y_real").isNotNull()).select("execution_id", "target_date").distinct()
    in_range = F.col("target_date").between(F.col("range_start"), F.col("range_end"))
    return (
        scenarios.select("execution_id", "range_start", "range_end")
        .join(known, "execution_id", "left")
        .groupBy("execution_id", "range_start", "range_end")
        .agg(F.count_if(in_range).alias("_inside"))
        .select(
            "execution_id",
            (F.col("_inside") == F.datediff("range_end", "range_start") + 1).alias("actuals_complete"),
        )
    )


def recursive_horizon_flag(rows: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Ranges beyond two weeks that are predicted from one-day-ahead rows."""
    nearest = rows.groupBy("execution_id").agg(
        F.min(F.datediff("target_date", "forecast_origin_date")).alias("_nearest")
    )
    span = F.datediff("range_end", "range_start") + 1
    return scenarios.join(nearest, "execution_id", "left").select(
        "execution_id",
        F.coalesce((span > REASONABLE_HORIZON_DAYS) & (F.col("_nearest") <= 1), F.lit(False)).alias(
            "recursive_horizon"
        ),
    )


def external_snapshot_events(events: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Events overlapping each scenario's range, with type and impact; all of them.

    Scenario ranges are cut into months, so that scenarios and events meet by an equi-join.
    """
    def months(start: Column, end: Column) -> Column:
        return F.explode(F.sequence(F.trunc(start, "month"), F.trunc(end, "month"), F.expr("interval 1 month")))

    ranges = scenarios.select("execution_id", "range_start", "range_end").withColumn(
        "_month", months(F.col("range_start"), F.col("range_end"))
    )
    spans = events.filter("start_date <= end_date").withColumn(
        "_month", months(F.col("start_date"), F.col("end_date"))
    )
    overlaps = (F.col("start_date") <= F.col("range_end")) & (F.col("end_date") >= F.col("range_start"))
    met = spans.join(ranges, "_month").filter(overlaps)
    # Both may share several months; the first shared one counts.
    first = F.trunc(F.greatest("start_date", "range_start"), "month")
    return met.filter(F.col("_month") == first).select(
        "execution_id",
        "event_id",
        F.greatest("start_date", "range_start").alias("target_date"),
        domain.event_type(F.col("category")).alias("event_type"),
        domain.impact_level(F.col("attendance_estimated")).alias("impact_level"),
    )


def external_snapshot_weather(weather: DataFrame) -> DataFrame:
    wind = F.coalesce(F.nullif(F.col("wind_max_kmh"), F.lit(0.0)), F.col("wind_mean_kmh"))
    return weather.withColumn("alert_level", domain.alert_level(F.col("precip_mm"), wind)).withColumn(
        "alert_summary", domain.alert_summary(F.col("alert_level"), F.col("precip_mm"), wind)
    )


# Comments ----------------------------------------------------------------------------------

# Vocabulary of scenario comments.
EVENT_TYPES = ["deportivo", "cultural", "universitario", "religioso", "feria/congreso", "otro"]
IMPACT_LEVELS = ["bajo", "medio", "alto", "muy alto"]
ALERT_LEVELS = ["sin_alerta", "amarilla", "naranja", "roja"]
DOMAINS = ["eventos", "meteorologia", "calendario"]
INTENTS = [
    "crear_evento",
    "modificar_evento",
    "eliminar_evento",
    "modificar_meteorologia",
    "marcar_festivo",
]
WEATHER_WORDS = ["lluvia", "alerta", "mm", "meteo"]
MISSING_DATE_REASON = "missing_date"

#: Words that may lead a comment without being part of a name.
COMMANDS = ["añade", "añadir", "crea", "crear", "inserta", "insertar", "programa", "programar", "registra", "registrar"]
ARTICLES = ["el", "los", "las", "un", "una", "de", "del", "evento", "eventos"]
#: Word sequences that say when, how strong and of what kind; with the words that may introduce them.
TIME_WORDS = [["pasado", "mañana"], ["pasado", "manana"], ["mañana"], ["manana"], ["hoy"]]
KIND_WORDS = [["feria"], ["congreso"], *[[k] for k in EVENT_TYPES]]


def _any_word(value: Column, words: Sequence[str]) -> Column:
    hit = F.lit(False)
    for word in words:
        hit = hit | value.contains(word)
    return hit


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def scenario_name(comment: Column) -> Column:
    """What a comment calls its event: its words without lead words and recognised slots.

    The comment is split into words once. Leading commands and articles go by list membership;
    then every stretch that names a day, an impact or a kind goes, with the word before it that
    introduces it. What is left, joined by spaces, begins with a capital.
    """
    split = F.filter(F.split(F.trim(comment), r"\s+"), lambda w: w != "")
    bare = lambda w: F.regexp_replace(F.lower(w), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    lead = [F.lit(w) for w in (*COMMANDS, *ARTICLES)]
    said = [
        (TIME_WORDS, ["para"]),
        ([["impacto", *level.split()] for level in IMPACT_LEVELS], ["con"]),
        ([["tipo", *kind] for kind in KIND_WORDS], ["de"]),
    ]

    def matched(low: Column, i: Column, phrase: Sequence[str]) -> Column:
        hit = F.lit(True)
        for k, word in enumerate(phrase):
            hit = hit & F.get(low, i + k).eqNullSafe(F.lit(word))
        return hit

    def inside(low: Column, i: Column) -> Column:
        """Whether word i belongs to a recognised stretch."""
        date = F.get(low, i).rlike(r"^\d{1,2}/\d{1,2}/\d{4}$")
        intro_date = (F.get(low, i) == "el") & F.coalesce(F.get(low, i + 1).rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.lit(False))
        found = date | intro_date
        for phrases, intros in said:
            for phrase in phrases:
                for back in range(len(phrase)):
                    found = found | matched(low, i - back, phrase)
                found = found | (F.get(low, i).isin(*intros) & matched(low, i + 1, phrase))
        return found

    def cleaned(words: Column) -> Column:
        low = F.transform(words, bare)
        rest = _let(
            low,
            lambda lows: F.aggregate(
                lows,
                F.struct(F.lit(0).alias("n"), F.lit(True).alias("leading")),
                lambda s, w: F.struct(
                    (s["n"] + (s["leading"] & w.isin(*lead)).cast("int")).alias("n"),
                    (s["leading"] & w.isin(*lead)).alias("leading"),
                ),
            )["n"],
        )
        kept = _let(
            low, lambda lows: F.filter(F.transform(words, lambda w, i: F.when(~inside(lows, i) & (i >= rest), w)), lambda w: w.isNotNull())
        )
        return F.array_join(kept, " ")

    name = F.nullif(text.collapse_spaces(_let(split, cleaned)), F.lit(""))
    return _let(name, lambda n: F.concat(F.upper(F.substring(n, 1, 1)), n.substr(F.lit(2), F.length(n))))


def extract_scenario_frame(comment: Column, reference: Column) -> Column:
    """Struct with domain, intent, date range and slots found in a free-text comment.

    Rules are ordered words and patterns; the whole text is searched. Where several types
    or impacts occur, the type listed last and the shortest impact win.
    """
    low = F.lower(comment)
    explicit = F.nullif(F.regexp_extract(low, "\\b(\\d{1,2}/\\d{1,2}/\\d{4})\\b", 1), F.lit(""))
    target = (
        F.when(_any_word(low, ["pasado mañana", "pasado manana"]), F.date_add(reference, 2))
        .when(_any_word(low, ["mañana", "manana"]), F.date_add(reference, 1))
        .when(low.contains("hoy"), reference)
        .otherwise(F.to_date(F.try_to_timestamp(explicit, F.lit("d/M/yyyy"))))
    )
    dated = target.isNotNull()
    weather = _any_word(low, WEATHER_WORDS)
    mentions_event = low.contains("evento")
    domain_name = F.when(dated, F.when(weather, "meteorologia").otherwise("eventos")).otherwise(
        F.when(mentions_event, "eventos").otherwise("meteorologia")
    )
    intent = F.when(domain_name == "eventos", "crear_evento").otherwise("modificar_meteorologia")

    name = scenario_name(comment)

    kind = F.lit(None).cast("string")
    for event_type in EVENT_TYPES:
        word = "deportiv" if event_type == "deportivo" else event_type
        kind = F.when(low.contains(word), event_type).otherwise(kind)
    impact = F.lit(None).cast("string")
    for level in sorted(IMPACT_LEVELS, key=len, reverse=True):
        impact = F.when(low.contains(level), level).otherwise(impact)
    alert = F.lit(None).cast("string")
    for level in ALERT_LEVELS[1:]:
        alert = F.when(low.contains(level), level).otherwise(alert)
    millimetres = F.translate(F.regexp_extract(low, "(\\d+(?:[,.]\\d+)?)\\s*mm\\b", 1), ",", ".")

    def slot(value: Column) -> Column:
        return F.when(dated, value)

    return F.struct(
        domain_name.alias("domain"),
        intent.alias("intent"),
        target.alias("range_start"),
        target.alias("range_end"),
        slot(F.when(domain_name == "eventos", name)).alias("name"),
        slot(kind).alias("event_type"),
        slot(impact).alias("impact_level"),
        slot(
            F.when(_any_word(low, ["todas las estaciones", "red completa"]), F.array(F.lit("all")))
        ).alias("affected_stations"),
        slot(F.when(low.contains("lluvia"), True)).alias("rain"),
        slot(F.when(low.contains("lluvia intensa"), True)).alias("heavy_rain"),
        slot(millimetres.try_cast("double")).alias("precip_mm"),
        slot(alert).alias("alert_level"),
    )


def validate_frames(frames: DataFrame, catalog: DataFrame, frame_id: str = "frame_id") -> DataFrame:
    """Accept or reject frames: date range, vocabulary and stations.

    Station words resolve by id or code to one series, by name to all lines of the
    station; a word that resolves to nothing is invalid.
    """
    valid_range = F.coalesce(F.col("range_end") >= F.col("range_start"), F.lit(False))
    folded = F.trim(F.lower(text.strip_accents(F.col("_word"))))
    words = frames.select(frame_id, F.explode("affected_stations").alias("_word")).distinct()

    def fold(column: str) -> Column:
        return F.trim(F.lower(text.strip_accents(F.col(column))))

    direct = catalog.select(
        "series_id", F.explode(F.array_distinct(F.array(fold("series_id"), fold("station_abbrev")))).alias("_key")
    ).groupBy("_key").agg(F.min("series_id").alias("_direct"))
    by_name = catalog.groupBy(fold("estacion").alias("_name")).agg(
        F.array_sort(F.collect_set("series_id")).alias("_named")
    )
    resolved = (
        words.withColumn("_folded", folded)
        .join(direct, F.col("_folded") == F.col("_key"), "left")
        .join(by_name, F.col("_folded") == F.col("_name"), "left")
        .withColumn(
            "_stations",
            F.when(F.col("_word") == "all", F.array(F.lit("all")))
            .when(F.col("_direct").isNotNull(), F.array("_direct"))
            .otherwise(F.col("_named")),
        )
    )
    per_frame = resolved.groupBy(frame_id).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("_stations")))).alias("resolved_stations"),
        F.array_sort(
            F.collect_list(F.when(F.col("_stations").isNull(), F.concat(F.lit("affected_stations="), "_word")))
        ).alias("_bad_stations"),
    )

    def bad(column: str, allowed: Sequence[str]) -> Column:
        value = F.col(column)
        return F.when(value.isNotNull() & ~value.isin(*allowed), F.concat(F.lit(f"{column}="), value))

    vocabulary = F.array(
        bad("event_type", EVENT_TYPES),
        bad("impact_level", IMPACT_LEVELS),
        bad("alert_level", ALERT_LEVELS),
        bad("domain", DOMAINS),
        bad("intent", INTENTS),
    )
    none = F.array().cast("array<string>")
    invalid = F.concat(
        F.filter(vocabulary, lambda v: v.isNotNull()), F.coalesce("_bad_stations", none)
    )
    reason = F.when(~valid_range, MISSING_DATE_REASON).when(F.size(invalid) > 0, "invalid_catalog_value")
    return (
        frames.join(per_frame, frame_id, "left")
        .withColumns(
            {
                "reject_reason": reason,
                "invalid_values": F.when(valid_range, F.array_join(invalid, ", ")).otherwise(""),
                "affected_stations": F.coalesce("resolved_stations", none),
            }
        )
        .withColumn("accepted", F.col("reject_reason").isNull())
        .drop("resolved_stations", "_bad_stations")
    )
