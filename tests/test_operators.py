"""Hand-worked cases of the rules that are easy to get wrong."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ridelake.functions import domain, text, times
from ridelake.operators import (
    analysis,
    backtest,
    calendar,
    demand,
    drift,
    features,
    joins,
    models,
    operations,
    panel,
    quality,
    scale,
    scenario,
)


def one(spark, column, value=None, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("r")).first().r


def day(text_):
    return dt.date.fromisoformat(text_)


# Text and times -----------------------------------------------------------------------------


@pytest.mark.parametrize(
    "raw, folded",
    [
        ("  EstaciÃ³n_Norte-2 ", "estacion norte 2"),
        ("Estación  Norte", "estacion norte"),
        ("REGULARIZACI?N en salida", "regularizacion en salida"),
        ("œuf Ã©", "œuf a©"),
        ("été", "ete"),
        (None, ""),
    ],
)
def test_fold_text(spark, raw, folded):
    assert one(spark, text.fold_text(F.col("x")), raw) == folded


def test_titles_and_types_survive_corruption(spark):
    rows = spark.createDataFrame(
        [("Primera Entrada", "M?sMetro"), ("primera_salida", "MásMetro"), ("regularizaci?n sencilla", "Contrata"), ("REGULARIZACIÃ³N SENCILLA", "T?tulo promocional")],
        "tipo_validacion string, tipo_titulo string",
    )
    kept = {(r.tipo_validacion_normalizada, r.tipo_titulo_limpio) for r in demand.filter_trips(rows).collect()}
    assert kept == {("primera_entrada", "MásMetro"), ("regularizacion_sencilla", "Título Promocional")}


def test_null_label_stays_null(spark):
    assert one(spark, text.match_label(F.col("x"))) is None


@pytest.mark.parametrize("name, code", [("Atarazanas", "ATAR"), ("el-puerto del mar azul", "EPDM"), ("", "UNK"), (None, "UNK")])
def test_fallback_station_code(spark, name, code):
    assert one(spark, text.fallback_station_code(F.col("x")), name) == code


def test_series_label(spark):
    rows = spark.createDataFrame([("LINEA 2", "PCH", True), ("LINEA 2", "TOR", False)], "l string, c string, s boolean")
    labels = rows.select(text.series_label(F.col("l"), F.col("c"), F.col("s")).alias("r")).collect()
    assert [r.r for r in labels] == ["PCH2", "TOR"]


@pytest.mark.parametrize("raw, number", [("1,5", 1.5), ("1.234,56", 0.0), ("-3 €", -3.0), ("", 0.0), (None, 0.0), ("abc", 0.0)])
def test_clean_number(spark, raw, number):
    assert one(spark, times.clean_number(F.col("x")), raw) == number


def test_service_day_boundary(spark):
    rows = spark.createDataFrame([("2024-05-02 00:30:00",), ("2024-05-02 03:30:00",)], "t string").select(F.to_timestamp("t").alias("t"))
    found = [r.d for r in rows.select(times.service_date(F.col("t"), 3).alias("d")).collect()]
    assert found == [day("2024-05-01"), day("2024-05-02")]


@pytest.mark.parametrize("clock, axis, offset", [("01:30", 1530, 1), ("05:00:59", 300, 0), ("25:00", None, None), (None, None, None)])
def test_service_time(spark, clock, axis, offset):
    found = one(spark, times.parse_service_time(F.col("x")), clock)
    assert (found.axis_minutes, found.day_offset) == (axis, offset)
    frame = times.add_service_time(spark.createDataFrame([(clock,)], "x string"), "x", "s").first()
    assert (frame.s_minutes, frame.s_day_offset) == (axis, offset)


@pytest.mark.parametrize("raw, value, status", [("12.500 personas", 12500, "parsed"), ("sin datos", None, "unparseable_text"), (" ", None, "missing")])
def test_attendance(spark, raw, value, status):
    found = one(spark, times.parse_attendance(F.col("x")), raw)
    assert (found.value, found.status) == (value, status)


def test_week_label_and_year_week(spark):
    rows = spark.createDataFrame([(day("2024-12-30"),), (day("2025-01-06"),)], "d date")
    labels = [r.w for r in rows.select(times.week_label(F.col("d")).alias("w")).collect()]
    assert labels == ["2024-W53", "2025-W02"]
    parts = rows.select(times.calendar_parts(F.col("d"))["year_week"].alias("w")).first()
    assert parts.w == "2024-01"


def test_alert_summary(spark):
    rows = spark.createDataFrame([(62.5, 12.0), (1.0, 2.0), (None, 71.0)], "p double, w double")
    level = domain.alert_level(F.col("p"), F.col("w"))
    found = [r.s for r in rows.select(domain.alert_summary(level, F.col("p"), F.col("w")).alias("s")).collect()]
    assert found == [
        "Alerta roja: precipitacion 62.5 mm, viento 12 km/h.",
        "Sin alerta meteorologica relevante.",
        "Alerta naranja: viento 71 km/h.",
    ]


# Demand and joins ---------------------------------------------------------------------------


def raw_rows(spark):
    columns = (
        "fecha_validacion timestamp, linea string, estacion string, cod_eq string, tipo_validacion string, tipo_titulo string, "
        "dinero_deducido double, saldo_restante double, viajes_deducidos long, fecha_validacion_hora_estimada boolean"
    )
    at = dt.datetime(2024, 3, 1, 8)
    good = "Billete ocasional"
    return spark.createDataFrame(
        [
            (at, "L1", "A", "E1", "Primera Entrada", good, 1.0, 2.0, 1, True),
            (at.replace(hour=9), "L1", "A", "E2", "Transbordo sencillo", good, None, 2.0, None, None),
            (at, "L1", "A", "E3", "Primera salida", good, 1.0, 2.0, 1, False),
            (at, "L1", "A", "E4", "Primera Entrada", "Contrata", 1.0, 2.0, 1, False),
        ],
        columns,
    )


def test_station_daily_trips(spark):
    row = demand.station_daily_trips(raw_rows(spark)).collect()
    assert len(row) == 1
    found = row[0]
    assert (found.trip_count, found.raw_unique_equipment_count, found.raw_rows_with_estimated_time) == (2, 2, 1)
    assert (found.raw_missing_money_fields_count, found.raw_missing_trip_fields_count) == (1, 1)


def test_station_daily_trips_does_not_depend_on_partitions(spark):
    rows = raw_rows(spark).unionByName(raw_rows(spark))
    assert demand.station_daily_trips(rows.repartition(5)).collect() == demand.station_daily_trips(rows.coalesce(1)).collect()


def test_network_changes_pivot(spark):
    rows = spark.createDataFrame(
        [(dt.datetime(2024, 1, 1, 5), "L1", "A", "equipment_first_seen")] * 2 + [(dt.datetime(2024, 1, 1, 6), "L1", "A", "other")],
        "effective_date timestamp, linea string, estacion string, change_type string",
    )
    found = demand.network_changes_daily(rows).first()
    assert (found.network_equipment_first_seen_count, found.network_change_count) == (2, 2)


def test_safe_join_rejects_duplicates_and_missing(spark):
    left = spark.createDataFrame([(1,), (2,)], "k int")
    with pytest.raises(quality.QualityError, match="duplicate"):
        joins.safe_left_join(left, spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string"), ["k"])
    with pytest.raises(quality.QualityError, match="without a match"):
        joins.safe_left_join(left, spark.createDataFrame([(1, "a")], "k int, v string"), ["k"], required=True)
    joined = joins.safe_left_join(left, spark.createDataFrame([(1, "a"), (3, "c"), (3, "d")], "k int, v string"), ["k"], right_unique=False)
    assert joined.count() == 2
    with pytest.raises(quality.QualityError, match="multiply rows.* 1"):
        joins.safe_left_join(left, spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string"), ["k"], right_unique=False)
    with pytest.raises(quality.QualityError, match="NULLs in k"):
        joins.safe_left_join(spark.createDataFrame([(1,), (None,)], "k int"), spark.createDataFrame([(1, "a")], "k int, v string"), ["k"])


def test_guards_of_several_joins_run_once_and_all(spark):
    """Guards stay in a plan of several joins, also where later steps drop their columns."""
    left = spark.createDataFrame([(i, i % 3) for i in range(30)], "k int, g int")
    few = spark.createDataFrame([(0, "x"), (1, "y")], "g int, name string")
    many = spark.createDataFrame([(i, i * 2) for i in range(30)] + [(7, 0)], "k int, v int")
    first = joins.guarded_left_join(left, few, ["g"], name="groups")
    assert joins.checked(first.select("k")).count() == 30
    with pytest.raises(quality.QualityError, match="values right side: duplicate key, e.g. 7"):
        joins.checked(joins.guarded_left_join(first, many, ["k"], name="values").select("g"))
    with pytest.raises(quality.QualityError, match="groups: left keys without a match, e.g. 2"):
        joins.checked(joins.guarded_left_join(left, few, ["g"], name="groups", required=True).select("k"))


def test_model_base_checks_and_zero_fill(spark):
    trips = spark.createDataFrame([(day("2024-01-01"), "LINEA 1", "Perchel", 5), (day("2024-01-01"), "LINEA 1", "Torre", 7)], "service_date date, linea string, estacion string, trip_count long")
    external = spark.createDataFrame([(day("2024-01-01"), True)], "date date, is_holiday boolean")
    stations = spark.createDataFrame([("LINEA 1", "Perchel", "pch"), ("LINEA 1", "Torre", "TOR")], "linea string, estacion string, station_abbrev string")
    lines = spark.createDataFrame([("LINEA 1", "p")], "linea string, line_reference_path string")
    changes = demand.network_changes_daily(
        spark.createDataFrame([(dt.datetime(2024, 1, 1), "LINEA 1", "Torre", "equipment_first_seen")], "effective_date timestamp, linea string, estacion string, change_type string")
    )
    base = {r.series_id: r for r in demand.build_model_base(trips, external, stations, lines, changes).collect()}
    assert set(base) == {"PCH1", "TOR"}
    assert (base["PCH1"].network_change_count, base["TOR"].network_change_count) == (0, 1)


@pytest.mark.parametrize("direction", ["backward", "forward"])
@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("blocked", [False, True])
def test_asof_join_against_brute_force(spark, direction, strict, blocked):
    left = [(k, t) for k in (1, 2) for t in range(0, 40, 3)]
    right = [(k, t, k * 100 + t) for k in (1, 3) for t in (2, 6, 9, 25)]
    found = joins.asof_join(
        spark.createDataFrame(left, "k int, t int"),
        spark.createDataFrame(right, "k int, rt int, v int"),
        ["k"], "t", "rt", ["v"], direction=direction, strict=strict,
        block=(lambda c: F.floor(c / 7)) if blocked else None,
    )
    expected = set()
    for k, t in left:
        if direction == "backward":
            hits = [r for r in right if r[0] == k and (r[1] < t or (r[1] == t and not strict))]
            best = max(hits, key=lambda r: r[1], default=None)
        else:
            hits = [r for r in right if r[0] == k and (r[1] > t or (r[1] == t and not strict))]
            best = min(hits, key=lambda r: r[1], default=None)
        expected.add((k, t, best[2] if best else None))
    assert {tuple(r) for r in found.select("k", "t", "v").collect()} == expected


# Panel --------------------------------------------------------------------------------------


def test_missing_day_is_null_and_windows_count_it(spark):
    rows = spark.createDataFrame(
        [("A", day("2024-01-01"), 4), ("A", day("2024-01-02"), 6), ("A", day("2024-01-04"), 8)], "series_id string, service_date date, trip_count long"
    )
    found = {r.service_date.day: r for r in panel.panel_features(panel.densify(rows)).collect()}
    assert len(found) == 4 and found[3].observed_target_value is None
    assert (found[3].target_latest_observed_value, found[3].target_days_since_latest_observation) == (6.0, 1)
    assert (found[4].target_lag_1, found[4].target_rolling_mean_7, found[4].target_observed_count_7) == (None, 6.0, 3)
    assert found[1].target_rolling_std_7 is None
    assert panel.longest_gap(panel.densify(rows)).first().max_gap_days == 1


def test_dense_and_asof_baselines_agree(spark):
    rows = spark.createDataFrame(
        [("A", day("2024-01-01") + dt.timedelta(days=i), i * 1.5) for i in range(0, 60) if i % 5 != 2], "series_id string, service_date date, trip_count double"
    )
    features_ = panel.panel_features(panel.densify(rows))
    dense = features.origin_rows(features_, 1, 3, 7)
    plain = dense.select("series_id", "horizon_days", "forecast_origin_date", "target_day_of_week")
    searched = panel.asof_same_weekday(plain, panel.observed_history(features_))
    names = ["series_id", "horizon_days", "forecast_origin_date", "baseline_naive_seasonal_weekly", "baseline_naive_seasonal_reference_date", "baseline_seasonal_weekday_mean_4_reference_count"]
    assert dense.select(names).exceptAll(searched.select(names)).count() == 0
    assert dense.count() == searched.count()


def test_training_dataset_arguments(spark):
    empty = spark.createDataFrame([], "series_id string")
    with pytest.raises(ValueError):
        features.training_dataset(empty, empty, "other", 1)
    with pytest.raises(ValueError):
        features.training_dataset(empty, empty, features.STRICT, 0)
    strict = features.feature_columns(features.STRICT)
    assert strict == sorted(strict) and not any(c.startswith("weather_") for c in strict)
    assert "weather_temp_max_c" in features.feature_columns(features.SCENARIO)


def test_temporal_splits(spark):
    rows = spark.range(800).select(F.date_add(F.lit("2022-01-01").cast("date"), F.col("id").cast("int")).alias("forecast_origin_date"))
    splits = backtest.temporal_splits(rows).collect()
    assert [s.split_name for s in splits] == ["validation_fold_1", "validation_fold_2", "validation_fold_3", "test"]
    assert all(s.train_end < s.score_start for s in splits)
    assert (splits[-1].score_end - splits[-1].score_start).days == 179
    with pytest.raises(Exception, match="not enough history"):
        backtest.temporal_splits(rows.limit(500)).collect()


def test_metrics_skip_missing_and_keep_coverage(spark):
    rows = spark.createDataFrame([(10.0, 8.0), (0.0, 0.0), (5.0, None)], "y_true double, y_pred double")
    found = backtest.forecast_metrics(rows, []).first()
    assert (found.mae, found.wape, found.available_prediction_count) == (1.0, 0.2, 2)
    assert found.coverage_ratio == pytest.approx(2 / 3) and found.smape == pytest.approx(2 * 2 / 18 / 2)


@pytest.mark.parametrize("line_change, chosen", [(0.0, "sparse_excluded"), (0.05, "all_series")])
def test_policy_needs_gain_and_guardrail(spark, line_change, chosen):
    split = spark.createDataFrame([(h, p, w) for h in (1, 7) for p, w in (("all_series", 0.10), ("sparse_excluded", 0.09))], "horizon_days int, series_policy string, wape double")
    line = spark.createDataFrame(
        [(h, "L1", p, w) for h in (1, 7) for p, w in (("all_series", 0.10), ("sparse_excluded", 0.10 * (1 + line_change)))], "horizon_days int, linea string, series_policy string, wape double"
    )
    assert backtest.recommended_policy(backtest.select_policy(split, line)).first().recommended_series_policy == chosen


# Calendar, events, incidents ----------------------------------------------------------------


def test_neighbours_are_rows(spark):
    rows = spark.createDataFrame([(day("2024-01-01"), False), (day("2024-01-05"), True), (day("2024-02-01"), False)], "date date, is_holiday boolean")
    found = calendar.neighbour_flags(rows).orderBy("date").collect()
    assert [r.is_preholiday for r in found] == [True, False, False]
    assert [r.is_postholiday for r in found] == [False, False, True]


def test_nearest_holiday_edges(spark):
    days = spark.createDataFrame([(day(d),) for d in ("2024-01-01", "2024-01-10", "2024-01-12", "2024-01-20", "2024-02-01")], "d date")
    marks = spark.createDataFrame([(day("2024-01-10"),), (day("2024-01-20"),)], "h date")
    found = joins.nearest_holiday(days, "d", marks, "h").orderBy("d").collect()
    assert [(r.days_to_next_holiday, r.days_since_prev_holiday) for r in found] == [(9, None), (0, 0), (8, 2), (0, 0), (None, 12)]


def test_truncate_without_zero_keeps_all(spark):
    rows = spark.createDataFrame([(1, 2), (2, 3)], "o int, v int")
    assert calendar.truncate_at_first_zero(rows, "o", "v").count() == 2
    assert calendar.truncate_at_first_zero(rows.unionByName(spark.createDataFrame([(0, None)], "o int, v int")), "o", "v").count() == 0


def stations(spark):
    return spark.createDataFrame(
        [("LINEA 1", "Puebla", "pbl", "PBL", "Puebla", 1, "g"), ("LINEA 1", "Centro", "cen", "CEN", "Centro", 2, "g"), ("LINEA 2", "Centro", "cen", "CEN", "Centro", 2, "g")],
        "linea string, estacion string, station_join_key string, station_abbrev string, station_display_name string, network_order int, station_group string",
    )


def test_events_end_to_end(spark):
    events = spark.createDataFrame(
        [(1, "Auditorio Málaga", "12.000", dt.datetime(2024, 5, 1, 22), dt.datetime(2024, 5, 1, 1)), (2, "auditorio  malaga", None, dt.datetime(2024, 5, 2, 10), dt.datetime(2024, 5, 2, 12))],
        "event_id int, location_raw string, attendance_raw string, start_raw timestamp, end_raw timestamp",
    )
    matrix = spark.createDataFrame([("AUDITORIO MALAGA", "1", "x", "0", "1")], "location_raw string, CEN string, PBI string, XXX string, TyC string")
    normalized = operations.events_normalized(events)
    mapping = operations.event_location_mapping(matrix, stations(spark))
    assert {(r.station_code_raw, r.station_abbrev, r.mapping_confidence) for r in mapping.collect()} == {("CEN", "CEN", "matrix_exact"), ("PBI", "PBL", "matrix_alias")}
    daily = {(str(r.service_date), r.station_abbrev): r for r in operations.event_station_daily(normalized, mapping).collect()}
    assert len(daily) == 4
    second = daily[("2024-05-02", "CEN")]
    assert (second.active_event_count, second.starting_event_count, second.ending_event_count) == (2, 1, 2)
    assert daily[("2024-05-01", "CEN")].high_impact_starting_event_count == 1
    series = operations.event_series_daily(operations.event_station_daily(normalized, mapping), stations(spark)).collect()
    shared = [r for r in series if r.station_abbrev == "CEN"]
    assert {r.deduplication_weight for r in shared} == {0.5} and len(shared) == 4
    notes = {r.location_raw: r.notes for r in operations.event_mapping_report(normalized, mapping).collect()}
    assert set(notes.values()) == {"normalized_text_match_only"}


def test_location_without_known_code_keeps_a_row(spark):
    matrix = spark.createDataFrame([("Plaza", "0", "1")], "location_raw string, CEN string, ZZZ string")
    row = operations.event_location_mapping(matrix, stations(spark)).first()
    assert (row.station_abbrev, row.station_mapping_count, row.unknown_station_codes_present) == (None, 0, "ZZZ")


@pytest.mark.parametrize(
    "location, scope, line, confidence",
    [
        ("PBI - Anden", "station", "LINEA 1", "station_prefix_alias_unique_line"),
        ("CEN- hall", "station", None, "station_prefix_exact_shared_station"),
        ("cen - hall", "unknown", None, "unknown_scope"),
        ("Línea 2", "line", "LINEA 2", "line_exact"),
        ("Cruce 4", "crossing", None, "crossing_scope"),
        ("Talleres", "depot", None, "depot_scope"),
        ("línea 1 y 2", "network", None, "network_scope"),
        (" 512 ", "rolling_stock_or_asset", None, "rolling_stock_or_asset_scope"),
        (None, "unknown", None, "unknown_scope"),
    ],
)
def test_incident_scope(spark, location, scope, line, confidence):
    row = operations.incident_scope(spark.createDataFrame([(location,)], "location_raw string"), stations(spark)).first()
    assert (row.impact_scope, row.mapped_linea, row.mapping_confidence) == (scope, line, confidence)


# Analysis, drift, scenario ------------------------------------------------------------------


def test_segment_improvements(spark):
    rows = spark.createDataFrame([(1, day("2024-01-01"), "A", 100.0, 80.0, 90.0, 95.0)], "horizon_days int, target_date date, series_id string, y_true double, y_pred_seasonal double, y_pred_tabular_strict double, y_pred_tabular_forecastable double")
    flagged = rows.withColumns({f: F.lit(False) for f in analysis.SEGMENT_FLAGS})
    found = {r.segment_name: r for r in analysis.segment_metrics(flagged).collect()}
    assert set(found) == set(analysis.SEGMENTS)
    normal = found["normal_days"]
    assert (normal.baseline_seasonal_wape, normal.tabular_strict_wape) == (0.2, 0.1)
    assert normal.tabular_strict_relative_wape_improvement_vs_seasonal == pytest.approx(0.5)
    assert normal.forecastable_relative_wape_improvement_vs_strict == pytest.approx(0.5)
    assert found["holidays"].row_count == 0 and found["holidays"].tabular_strict_wape is None


def test_psi_of_itself_is_zero_and_ks_separates(spark):
    same = spark.range(1000).select(F.explode(F.array(F.lit("baseline"), F.lit("target"))).alias("sample"), F.lit("same").alias("feature"), (F.col("id") % 97).cast("double").alias("value"))
    apart = spark.range(100).select(F.when(F.col("id") < 60, "baseline").otherwise("target").alias("sample"), F.lit("apart").alias("feature"), F.col("id").cast("double").alias("value"))
    few = spark.range(12).select(F.when(F.col("id") < 9, "baseline").otherwise("target").alias("sample"), F.lit("few").alias("feature"), F.col("id").cast("double").alias("value"))
    only = spark.range(20).select(F.lit("target").alias("sample"), F.lit("only_target").alias("feature"), F.col("id").cast("double").alias("value"))
    rows = same.unionByName(apart).unionByName(few).unionByName(only)
    found = {r.feature: r for r in drift.drift_check(rows, blocks=8).collect()}
    assert found["same"].psi == pytest.approx(0.0, abs=1e-9) and found["same"].status == "stable"
    assert found["same"].ks_statistic == 0.0 and found["same"].p_value == pytest.approx(1.0)
    assert found["apart"].ks_statistic == 1.0 and found["apart"].status == "drifted"
    assert found["few"].status == "insufficient_data" and found["only_target"].status == "insufficient_data"


def test_ks_p_value_is_one_formula_at_all_sizes(spark):
    rows = spark.createDataFrame(
        [(0.3, 60, 60), (0.2428, 800, 31), (1.0, 50, 50), (0.0, 50, 50), (0.5, 0, 9)], "d double, n long, m long"
    )
    p = [r[0] for r in rows.select(drift.ks_p_value(F.col("d"), F.col("n"), F.col("m"))).collect()]
    # Exact values of the first two are 0.0088 and 0.0491.
    assert p[0] == pytest.approx(0.0088, abs=2e-3) and p[1] == pytest.approx(0.0491, abs=6e-3)
    assert p[2] < 1e-9 and p[3] == 1.0 and p[4] == 1.0


@pytest.mark.parametrize("blocks", [4, 16, 128])
def test_running_totals_against_brute_force(spark, blocks):
    values = [(k, float(v), (v * 7 + k) % 5) for k in (1, 2) for v in range(-30, 170)]
    found = scale.running_totals(spark.createDataFrame(values, "k int, v double, n int"), ["k"], "v", ["n"], blocks)
    expected = {(k, v, sum(x[2] for x in values if x[0] == k and x[1] <= v)) for k, v, _ in values}
    assert {(r.k, r.v, r.cum_n) for r in found.collect()} == expected


def test_dense_index_is_a_permutation(spark):
    found = scale.dense_index(spark.range(500), ["id"], "i", blocks=7)
    assert sorted(r.i for r in found.collect()) == list(range(500))


def test_donors_are_a_permutation_per_repeat(spark):
    rows = spark.range(50).select(F.col("id").alias("k"), F.col("id").alias("a"), (F.col("id") * 2).alias("b"))
    found = models.donors(rows, 3, ["k"], ["a", "b"], blocks=4).collect()
    for repeat in range(3):
        part = [r for r in found if r.repeat == repeat]
        assert sorted(r.k for r in part) == sorted(r.donor.a for r in part) == list(range(50))
        assert all(r.donor.b == 2 * r.donor.a for r in part)
        assert any(r.k != r.donor.a for r in part)


def test_rollup_and_comparison(spark):
    schema = "target_date date, linea string, estacion string, y_pred double, y_real double"
    rows = spark.createDataFrame([(day("2024-01-01"), "L1", "A", 100.0, 90.0), (day("2024-01-01"), "L2", "A", 50.0, 60.0), (day("2024-01-02"), "L1", "B", 25.0, None)], schema)
    found = scenario.scenario_rollup(rows)
    by = {(r.level, r.target_date, r.linea, r.estacion): r for r in found.collect()}
    network = by[("network", None, None, None)]
    assert (network.y_pred, network.y_real, network.abs_error) == (175.0, 150.0, 25.0)
    assert by[("station", None, None, "A")].y_pred == 150.0 and by[("station", None, None, "B")].y_real is None
    for level in scenario.LEVELS:
        assert sum(r.y_pred for k, r in by.items() if k[0] == level) == 175.0
    delta = scenario.compare_scenarios(found, scenario.scenario_rollup(rows.withColumn("y_pred", F.col("y_pred") * 2)))
    assert delta.count() == found.count()
    assert delta.filter("level = 'network'").first().delta_pct == 1.0


def test_actuals_and_comparison_stay_within_an_execution(spark):
    schema = "execution_id string, target_date date, linea string, estacion string, y_pred double, y_real double"
    rows = spark.createDataFrame([("A", day("2024-01-01"), "L1", "S", 10.0, None), ("B", day("2024-01-01"), "L1", "S", 20.0, None)], schema)
    rolled = scenario.scenario_rollup(rows)
    history = spark.createDataFrame([(day("2024-01-01"), 7.0)], "target_date date, actual double")
    found = scenario.enrich_actuals(rolled, history).filter("level = 'network'").collect()
    assert sorted((r.execution_id, r.y_real) for r in found) == [("A", 7.0), ("B", 7.0)]
    same = scenario.compare_scenarios(rolled, rolled).filter("level = 'network'").collect()
    assert sorted((r.base_id, r.candidate_id, r.delta_abs) for r in same) == [("A", "A", 0.0), ("B", "B", 0.0)]
    pairs = spark.createDataFrame([("A", "B")], "base_id string, candidate_id string")
    crossed = scenario.compare_scenarios(rolled, rolled, pairs).filter("level = 'network'").first()
    assert (crossed.base_y_pred, crossed.candidate_y_pred, crossed.delta_abs) == (10.0, 20.0, 10.0)
    with pytest.raises(Exception, match="2 rows on one side"):
        scenario.compare_scenarios(rolled.unionByName(rolled), rolled).collect()


def test_forecast_comparison_rejects_duplicate_keys(spark):
    schema = "horizon_days int, series_id string, forecast_origin_date date, target_date date, linea string, estacion string, y_true double, y_pred double"
    rows = spark.createDataFrame([(1, "s", day("2024-01-01"), day("2024-01-02"), "L1", "S", 1.0, 1.0)], schema)
    assert analysis.compare_forecasts(rows, rows, rows).first().y_pred_seasonal == 1.0
    with pytest.raises(Exception, match="2 rows on one side"):
        analysis.compare_forecasts(rows, rows.unionByName(rows.withColumn("y_pred", F.lit(9.0))), rows).collect()


@pytest.mark.parametrize(
    ("comment", "name"),
    [
        ("Añadir evento de Feria del Libro para mañana con impacto muy alto", "Feria del Libro"),
        ("crea el concierto Sol y Mar el 10/06/2024 de tipo cultural", "Concierto Sol y Mar"),
        ("Programa un partido pasado mañana", "Partido"),
        ("evento hoy", None),
    ],
)
def test_scenario_name_drops_lead_words_and_slots(spark, comment, name):
    frame = spark.createDataFrame([(comment,)], "c string").select(scenario.scenario_name(F.col("c")).alias("n"))
    assert frame.first().n == name


def test_all_range_warnings(spark):
    coverage = spark.createDataFrame([("E", day("2024-01-01"), day("2024-02-20"), 51, 51, 0, 0)], "execution_id string, range_start date, range_end date, total_days int, calendar_days int, event_days int, weather_days int")
    codes = {r.warning_code for r in scenario.range_warnings(coverage).collect()}
    assert codes == {"long_range", "missing_events", "missing_future_weather", "calendar_only", "model_horizon_exceeded"}


def test_comment_frames(spark):
    comments = [
        "Crea el evento de Feria del Libro para mañana con impacto muy alto en todas las estaciones",
        "Añade un concierto el 07/03/2026 de tipo cultural",
        "Lluvia intensa de 12,5 mm hoy, alerta roja",
        "sin nada",
    ]
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(comments)], "i int, c string")
    frame = scenario.extract_scenario_frame(F.col("c"), F.lit("2026-03-01").cast("date"))
    found = [r.f for r in rows.select("i", frame.alias("f")).orderBy("i").collect()]
    assert found[0].name == "Feria del Libro en todas las estaciones" and found[0].affected_stations == ["all"]
    assert (found[0].range_start, found[0].impact_level, found[0].event_type) == (day("2026-03-02"), "alto", None)
    assert (found[1].name, found[1].event_type, str(found[1].range_end)) == ("Concierto", "cultural", "2026-03-07")
    assert (found[2].domain, found[2].heavy_rain, found[2].precip_mm, found[2].alert_level) == ("meteorologia", True, 12.5, "roja")
    assert found[3].range_start is None and found[3].domain == "meteorologia"


def test_priority_depends_on_recompute(spark):
    def source(value):
        return spark.createDataFrame([(day("2024-01-01"), "A", value)], "target_date date, series_id string, y_pred double")

    sources = {"historical": source(1.0), "model_inference": source(2.0), "precomputed_future_forecast": source(3.0)}
    assert scenario.priority_union(sources).first().y_pred == 1.0
    assert scenario.priority_union(sources, recompute=True).first().y_pred == 2.0


# Quality ------------------------------------------------------------------------------------


def test_contract_checks_raise_in_order(spark):
    rows = spark.createDataFrame([(1, None), (1, None)], "a int, b string")
    with pytest.raises(quality.QualityError, match="missing columns c"):
        quality.check_contract(rows, quality.Contract("t", ("c",), ("a",)))
    with pytest.raises(quality.QualityError, match="1 duplicate"):
        quality.check_contract(rows, quality.Contract("t", ("a",), ("a", "b"), ("b",)))
    with pytest.raises(quality.QualityError, match="NULL"):
        quality.check_contract(rows.limit(1), quality.Contract("t", ("a",), ("a",), ("b",)))
    assert quality.check_contract(rows.limit(1), quality.Contract("t", ("a",), ("a",))) is not None


def test_monitor_status(spark):
    rows = spark.createDataFrame([("a", "stable"), ("a", "insufficient_data"), ("b", "stable")], "parent string, status string")
    nested = quality.nested_status(rows, "parent")
    assert {r.parent: r.status for r in nested.collect()} == {"a": "insufficient_data", "b": "stable"}
    assert quality.monitor_status(nested).first().global_status == "warning"


def test_events_are_numbered_across_a_busy_month_and_missing_starts(spark):
    start = dt.datetime(2024, 5, 1)
    rows = [(i, start + dt.timedelta(minutes=(i * 37) % 4000) if i % 3 else None) for i in range(1500)]
    rows += [(i, dt.datetime(2024, 1, 1)) for i in range(1500, 1510)]
    events = spark.createDataFrame(rows, "event_id long, start_ts timestamp").repartition(7)
    numbered = operations.source_row_numbers(events, ["start_ts", "event_id"])
    assert numbered.columns == ["event_id", "start_ts", "source_row_number"]
    found = {r.event_id: r.source_row_number for r in numbered.collect()}
    ordered = sorted(rows, key=lambda r: (r[1] is None, r[1] or start, r[0]))
    assert found == {event: n for n, (event, _) in enumerate(ordered, 2)}
    assert operations.source_row_numbers(events.limit(0), ["start_ts", "event_id"]).collect() == []
