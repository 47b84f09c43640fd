"""Files in, files out, and the incremental ingest."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ridelake.operators import demand, features, panel
from ridelake.operators.quality import Contract, QualityError
from ridelake.plans import builders
from ridelake.sources import readers, reports, writers
from ridelake.streaming import ingest


def report_text(rows, generated="02-03-2024 04:05"):
    head = [
        "Informe",
        f"Generado: {generated} Rango de Fechas: 01-03-2024 00:00:00 - 01-03-2024 23:59",
        "",
        "",
        "Fecha|Linea|Estacion|Equipo|Tipo|Titulo|Id|Num|Dinero|Saldo|Viajes",
    ]
    return "\r\n".join(head + rows + ["Total | 2", ""])


def body(clock, station="Málaga", card="77.0"):
    return f'{clock} | "LINEA 1" | {station} | EQ1 | Primera Entrada | Título Promocional | id | {card} | 1,35 | 1.234,5 | 1 |'


def write_report(root, day, rows, **kwargs):
    folder = root / day.strftime("%Y") / day.strftime("%m_%Y") / day.strftime("%d%m%y")
    folder.mkdir(parents=True, exist_ok=True)
    path = folder / f"Validaciones detalladas {day.strftime('%d%m%y')}.csv"
    path.write_bytes(report_text(rows, **kwargs).encode("latin-1"))
    return path


def test_report_rows(spark, tmp_path):
    day = dt.date(2024, 3, 1)
    write_report(tmp_path, day, [body("01-03-2024 10:00:00"), body("bad"), "too | few | parts"])
    (tmp_path / "stray.csv").write_text("x|y")
    folder = tmp_path / "2024" / "03_2024" / "010324"
    (folder / "resumen 010324.csv").write_bytes(report_text([body("01-03-2024 12:00:00")]).encode("latin-1"))
    rows = reports.read_daily_reports(spark, str(tmp_path)).orderBy("fecha_validacion").collect()
    assert len(rows) == 2
    good = rows[1]
    assert (good.estacion, good.num_tarjeta, good.dinero_deducido, good.saldo_restante, good.dia) == ("Málaga", "77", 1.35, 0.0, "2024-03-01")
    assert rows[0].fecha_validacion is None
    assert str(good.fecha_generacion) == "2024-03-02 04:05:00" and str(good.rango_hasta) == "2024-03-01 23:59:00"


def test_incremental_ingest_is_idempotent_and_replaces_days(spark, tmp_path):
    source, store = tmp_path / "in", str(tmp_path / "store")
    first, second = dt.date(2024, 3, 1), dt.date(2024, 3, 2)
    write_report(source, first, [body("01-03-2024 10:00:00"), body("01-03-2024 11:00:00")])
    write_report(source, second, [body("02-03-2024 10:00:00")])
    today = F.lit("2024-03-03").cast("date")

    def run(checkpoint):
        query = ingest.incremental_ingest(spark, str(source), store, str(tmp_path / checkpoint), today)
        query.awaitTermination()
        assert query.exception() is None

    def days():
        counts = writers.read_days(spark, store).groupBy("dia", "_orden_manifest").count().collect()
        return {str(r.dia): (r["_orden_manifest"], r["count"]) for r in counts}

    run("c1")
    assert days() == {"2024-03-01": (1, 2), "2024-03-02": (2, 1)}
    run("c1")
    assert days() == {"2024-03-01": (1, 2), "2024-03-02": (2, 1)}
    # A later version of a day replaces it, a new day gets the next number, and a day whose
    # file cannot be parsed keeps its stored rows.
    write_report(source, second, [body(f"02-03-2024 1{i}:00:00") for i in range(3)])
    write_report(source, dt.date(2024, 3, 3), [body("03-03-2024 10:00:00")])
    write_report(source, first, ["nothing to parse"])
    run("c2")
    assert days() == {"2024-03-01": (1, 2), "2024-03-02": (2, 3), "2024-03-03": (3, 1)}


def test_select_files_rules(spark):
    def path(day):
        return f"/d/{day:%Y}/{day:%m_%Y}/{day:%d%m%y}/Validaciones detalladas {day:%d%m%y}.csv"

    today = dt.date(2024, 6, 30)
    old, recent, future = dt.date(2024, 1, 5), dt.date(2024, 6, 25), dt.date(2024, 6, 30)
    rows = [
        (path(old), dt.datetime(2024, 1, 6)),
        (path(old) + "x", dt.datetime(2024, 1, 6)),
        (path(dt.date(2024, 1, 6)), dt.datetime(2024, 1, 7)),
        (path(dt.date(2024, 1, 7)), dt.datetime(2024, 6, 29)),
        (path(recent), dt.datetime(2024, 6, 26)),
        (path(future), dt.datetime(2024, 6, 30)),
    ]
    files = spark.createDataFrame(rows, "path string, modificationTime timestamp")
    stored = spark.createDataFrame([("2024-01-06",), ("2024-01-07",), ("2024-06-25",)], "dia string")
    chosen = ingest.select_files(files, stored, F.lit(today), window_months=1, delay_days=1).collect()
    # The old day is new to the store, 7 January was touched lately, 25 June is in the window.
    assert {r.path for r in chosen} == {path(old), path(dt.date(2024, 1, 7)), path(recent)}


def test_report_files_are_parsed_once(spark, tmp_path):
    """Numbers and rows of a batch come from one parse of its files."""
    for i in (1, 2):
        write_report(tmp_path, dt.date(2024, 3, i), [body(f"0{i}-03-2024 10:00:00")])
    stored = spark.createDataFrame([("2024-03-02", 5)], "dia string, _orden_manifest long")
    fresh = reports.consolidated_rows(reports.report_files(spark, str(tmp_path)), stored)
    assert "binaryFile" not in fresh._jdf.queryExecution().toString()
    assert {(r.dia, r._orden_manifest) for r in fresh.collect()} == {("2024-03-01", 6), ("2024-03-02", 5)}


def test_read_table_errors(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        readers.read_table(spark, str(tmp_path / "none.parquet"))
    with pytest.raises(ValueError):
        readers.read_table(spark, str(tmp_path / "x.txt"))
    with pytest.raises(ValueError):
        readers.read_table(spark, str(tmp_path / "x.xlsx"))


def test_first_existing_prefers_parquet(spark, tmp_path):
    base = str(tmp_path / "t")
    spark.createDataFrame([(1,)], "a int").write.option("header", True).csv(base + ".csv")
    assert readers.read_first_existing(spark, base).first().a == "1"
    spark.createDataFrame([(2,)], "a int").write.parquet(base + ".parquet")
    assert readers.read_first_existing(spark, base).first().a == 2
    assert readers.read_first_existing(spark, str(tmp_path / "u"), "a int").count() == 0
    with pytest.raises(FileNotFoundError):
        readers.read_first_existing(spark, str(tmp_path / "u"))


def test_workbook_export(spark, tmp_path):
    (tmp_path / "Servicios Hist 1.csv").write_text("Descripción Servicio,fecha\n  ,2024-01-01\nx,2024-01-02\n", encoding="utf-8")
    rows = readers.read_workbook_export(spark, str(tmp_path / "Servicios*.csv"), ["Descripcion servicio"]).orderBy("fecha").collect()
    assert [r.descripcion_servicio for r in rows] == [None, "x"]
    with pytest.raises(QualityError):
        readers.read_workbook_export(spark, str(tmp_path / "Servicios*.csv"), ["otra"])
    (tmp_path / "Servicios Hist 2.csv").write_text("a\n1\n")
    with pytest.raises(FileExistsError):
        readers.read_workbook_export(spark, str(tmp_path / "Servicios*.csv"))
    with pytest.raises(FileNotFoundError):
        readers.read_workbook_export(spark, str(tmp_path / "Nada*.csv"))


def test_list_export_pages(spark, tmp_path):
    (tmp_path / "p1.json").write_text('{"value": [{"ID": 1, "Loc": {"a": 1}, "__metadata": {"u": "x"}}]}')
    rows = readers.read_list_export(spark, str(tmp_path / "*.json"), {"ID": "id"}).collect()
    assert [r.asDict() for r in rows] == [{"id": 1, "Loc": '{"a":1}'}]


def test_demand_history_tolerates_bom(spark, tmp_path):
    path = tmp_path / "demand.csv"
    path.write_text("﻿Fecha,Viajeros\n2024-01-01,10\n02/01/2024,\"12,5\"\nbad,3\n2024-01-04,x\n", encoding="utf-8")
    rows = readers.read_demand_history(spark, str(path)).orderBy("target_date").collect()
    assert [(str(r.target_date), r.actual) for r in rows] == [("2024-01-01", 10.0), ("2024-01-02", 12.5)]


def test_metric_files_union(spark, tmp_path):
    for i in (1, 2):
        (tmp_path / f"m{i}__split.csv").write_text(f"model_name,wape\nm{i},0.{i}\n")
    rows = readers.read_metric_files(spark, str(tmp_path / "*__split.csv")).orderBy("model_name").collect()
    assert [(r.model_name, r.wape) for r in rows] == [("m1", 0.1), ("m2", 0.2)]


def test_experiment_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("m", "strict_available", "all_series", 7, "A", 1.0)], "model_name string, variant string, series_policy string, horizon_days int, series_id string, y_pred double")
    metrics = spark.createDataFrame([("overall", 0.5)], "metric_level string, wape double")
    writers.persist_experiment(rows, metrics, str(tmp_path))
    found = readers.read_run_artifacts(spark, str(tmp_path / "predictions")).first()
    assert (found.model_name, found.variant, found.horizon_days, found.y_pred) == ("m", "strict_available", 7, 1.0)


def test_experiments_replace_their_own_runs(spark, tmp_path):
    def run(name, horizon):
        return f"'{name}' AS model_name, 'strict_available' AS variant, 'all_series' AS series_policy, {horizon} AS horizon_days"

    catalog = spark.createDataFrame([("lag_1", "autoregressive"), ("temp", "weather"), ("flag", "static")], "feature_name string, category string")

    def save(name, horizons, value, used, note):
        ones = [spark.sql(f"SELECT {run(name, h)}") for h in horizons]
        runs = ones[0] if len(ones) == 1 else ones[0].union(ones[1])
        levels = F.explode(F.array(*[F.lit(x) for x in ("overall", "split", "line", "series")])).alias("metric_level")
        writers.persist_experiment(
            runs.withColumn("y_pred", F.lit(value)),
            runs.select("*", levels).withColumn("wape", F.lit(value)),
            str(tmp_path),
            catalog=catalog,
            used=runs.withColumn("feature_name", F.explode(F.array(*[F.lit(f) for f in used]))),
            metadata=runs.withColumn("note", F.lit(note)),
        )

    save("m", [1, 7], 1.0, ["lag_1", "temp", "temp", "unlisted"], "first")
    save("n", [7], 2.0, ["flag"], "other")
    save("m", [7], 3.0, ["lag_1"], "second")
    predictions = spark.read.parquet(str(tmp_path / "predictions")).collect()
    assert {(r.model_name, int(r.horizon_days), r.y_pred) for r in predictions} == {("m", 1, 1.0), ("m", 7, 3.0), ("n", 7, 2.0)}
    metrics = spark.read.option("header", True).csv(str(tmp_path / "metrics")).collect()
    assert len(metrics) == 12 and {(r.model_name, int(r.horizon_days), float(r.wape)) for r in metrics} == {("m", 1, 1.0), ("m", 7, 3.0), ("n", 7, 2.0)}
    features = spark.read.option("header", True).csv(str(tmp_path / "features")).collect()
    assert sorted((r.model_name, int(r.horizon_days), r.feature_name, r.category) for r in features) == [
        ("m", 1, "lag_1", "autoregressive"), ("m", 1, "temp", "weather"), ("m", 7, "lag_1", "autoregressive"), ("n", 7, "flag", "static"),
    ]
    notes = spark.read.json(str(tmp_path / "metadata")).collect()
    assert {(r.model_name, int(r.horizon_days), r.note) for r in notes} == {("m", 1, "first"), ("m", 7, "second"), ("n", 7, "other")}


def test_write_output_formats(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a")], "k int, v string")
    assert writers.write_output(rows, str(tmp_path), Contract("t", unique_key=("k",))).endswith(".parquet")
    report = writers.write_output(rows, str(tmp_path), Contract("r", grain="report"))
    assert spark.read.option("header", True).csv(report).first().v == "a"
    with pytest.raises(QualityError):
        writers.write_output(rows.unionByName(rows), str(tmp_path), Contract("t", unique_key=("k",)))


def test_scenario_results_replace_and_audit_appends(spark, tmp_path):
    def save(execution, value):
        rows = spark.createDataFrame([(execution, value)], "execution_id string, y_pred double")
        writers.save_scenario_result(rows, rows, rows.select("execution_id"), str(tmp_path))

    save("A", 1.0)
    save("B", 2.0)
    save("A", 3.0)
    stored = spark.read.parquet(str(tmp_path / "predictions")).collect()
    assert {(r.execution_id, r.y_pred) for r in stored} == {("A", 3.0), ("B", 2.0)}
    assert spark.read.parquet(str(tmp_path / "audit_events")).count() == 3


def test_explanations_are_replaced_with_their_execution(spark, tmp_path):
    def save(executions, explained):
        rows = spark.createDataFrame([(e, 1.0) for e in executions], "execution_id string, y_pred double")
        reasons = spark.createDataFrame(explained, "execution_id string, label string")
        writers.save_scenario_result(rows, rows, rows.select("execution_id"), str(tmp_path), reasons)
        found = writers.read_explanations(spark, str(tmp_path)).select("execution_id", "label")
        return sorted(tuple(r) for r in found.collect())

    assert save(["A", "B"], [("A", "rain"), ("A", "game"), ("B", None)]) == [("A", "game"), ("A", "rain"), ("B", None)]
    # A loses its reasons, B is not part of this run.
    assert save(["A"], []) == [("B", None)]
    assert save(["A", "B"], [("B", "fair")]) == [("B", "fair")]


def test_training_specs_are_persisted(spark, tmp_path):
    start = dt.date(2024, 1, 1)
    rows = [(s, start + dt.timedelta(days=i), "LINEA 1", s, float(i % 7)) for s in ("A", "B") for i in range(40)]
    base = spark.createDataFrame(rows, "series_id string, service_date date, linea string, estacion string, trip_count double")
    external = spark.createDataFrame([(start + dt.timedelta(days=i), i % 7 + 1, 20.0) for i in range(50)], "date date, day_of_week int, temp_max_c double")
    foundation = builders.build_foundation(base, external)
    datasets = builders.training_datasets(foundation, sparse_series=["B"], scenario_start="2024-01-20")
    assert len(datasets) == 8
    writers.persist_training_specs(list(datasets.values()), foundation.catalog, foundation.diagnostics, str(tmp_path))
    manifest = {(r.feature_variant, r.series_policy, int(r.horizon_days)): r for r in spark.read.json(str(tmp_path / "manifest")).collect()}
    assert manifest[("strict_available", "all_series", 1)].row_count == 78
    assert manifest[("strict_available", "sparse_excluded", 7)].series_count == 1
    assert manifest[("forecastable_scenario", "all_series", 1)].target_min == "2024-01-20"


def test_smoke_predictions_are_written_twice(spark, tmp_path):
    writers.write_smoke_predictions(spark.createDataFrame([(1,)], "a int"), str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "smoke_predictions.parquet")).count() == 1
    assert spark.read.option("header", True).csv(str(tmp_path / "smoke_predictions.csv")).count() == 1


def test_stream_interval_demand_matches_batch(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame([("A", start + dt.timedelta(minutes=5 * i)) for i in range(48)], "series_id string, fecha_validacion timestamp")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = (
        ingest.stream_interval_demand(stream, lateness="10 minutes")
        .writeStream.format("memory").queryName("intervals").outputMode("complete").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    streamed = {(r.series_id, r.interval_start, r.trip_count) for r in spark.table("intervals").collect()}
    batch = {(r.series_id, r.interval_start, r.trip_count) for r in demand.interval_demand(rows).collect()}
    assert streamed == batch and len(batch) == 16


def test_station_catalog_fallback(spark):
    schema = "series_id string, linea string, estacion string, station_abbrev string, network_order int, ord int"
    empty = spark.createDataFrame([], schema)
    fallback = spark.createDataFrame([("A", "L1", "a", "A", 1, 0)], schema)
    assert readers.station_catalog(empty, "ord", fallback).first().series_id == "A"


def test_catalog_covers_all_features(spark):
    catalog = features.availability_catalog(spark)
    assert catalog.count() == 109 and catalog.select("feature_group").distinct().count() == 10
    assert panel.LAG_DAYS == [1, 7, 14, 28]


def test_upserts_of_days_are_atomic(spark, tmp_path):
    store = str(tmp_path / "days")

    def rows(*days, origin):
        return spark.createDataFrame([(d, origin, i) for d in days for i in range(3)], "dia string, origin string, i int")

    def shown():
        return {(r.dia, r.origin): r["count"] for r in writers.read_days(spark, store).groupBy("dia", "origin").count().collect()}

    writers.upsert_days(rows("2024-01-01", "2024-01-02", origin="a"), store)
    writers.upsert_days(rows("2024-01-02", "2024-01-03", origin="b"), store, version="batch-7")
    expected = {("2024-01-01", "a"): 3, ("2024-01-02", "b"): 3, ("2024-01-03", "b"): 3}
    assert shown() == expected
    # A replayed batch keeps what it committed, even after later commits.
    writers.upsert_days(rows("2024-01-03", origin="c"), store)
    writers.upsert_days(rows("2024-01-02", "2024-01-03", origin="b"), store, version="batch-7")
    assert shown() == {**{k: v for k, v in expected.items() if k[0] != "2024-01-03"}, ("2024-01-03", "c"): 3}
    # A writer that died before its commit leaves nothing to be seen.
    rows("2024-01-01", origin="lost").write.partitionBy("dia").parquet(f"{store}/data/version=zzz")
    assert ("2024-01-01", "lost") not in shown()
    # Two writers that saw the same commits: one order for all readers, and no mixed day.
    number = writers.commits(spark, store).agg({"number": "max"}).first()[0] + 1
    for name in ("w1", "w2"):
        rows("2024-01-01", "2024-01-09", origin=name).write.partitionBy("dia").parquet(f"{store}/data/version={name}")
        both = spark.createDataFrame([(name, d, number) for d in ("2024-01-01", "2024-01-09")], "version string, dia string, number long")
        both.coalesce(1).write.parquet(f"{store}/commits/{name}")
    assert {o for d, o in shown() if d in ("2024-01-01", "2024-01-09")} == {"w2"}
    # Only the partitions of live versions are read.
    plan = writers.read_days(spark, store).filter("dia = '2024-01-03'")._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    assert "PartitionFilters: [" in plan


def test_tables_stored_as_folders_are_discovered_once(spark, tmp_path):
    folder = tmp_path / "a.parquet" / "in"
    spark.range(40).repartition(3).write.parquet(f"{folder}/orders.parquet")
    spark.range(4).selectExpr("id", "id % 2 AS k").write.partitionBy("k").parquet(f"{folder}/deep/events.parquet")
    spark.range(5).coalesce(1).write.csv(f"{folder}/lines.csv")
    (folder / "notes.csv").write_text("x")
    (folder / "plain").write_text("no suffix")
    found = readers.discover_tables(spark, str(folder), ["*.parquet", "*.csv", "plain"]).collect()
    assert [r.path for r in found] == [f"file:{folder}/{n}" for n in ("deep/events.parquet", "lines.csv", "notes.csv", "orders.parquet", "plain")]
    sizes = {r.path.rsplit("/", 1)[1]: r.length for r in found}
    assert sizes["orders.parquet"] == sum(f.stat().st_size for f in (folder / "orders.parquet").glob("*.parquet"))
    assert (sizes["notes.csv"], sizes["lines.csv"], sizes["plain"]) == (1, 10, 9)
    assert [r.path for r in readers.discover_tables(spark, f"{tmp_path}/a.par*/in", ["notes.*"]).collect()] == [f"file:{folder}/notes.csv"]


def test_query_lists_tables_of_several_parts_once(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    from ridelake.catalog import load_queries
    from ridelake.catalog.registry import runner

    for name in ("region", "orders"):
        spark.range(9).repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    pq.write_table(pa.table({"id": [1]}), tmp_path / "nation.parquet")
    found = runner(load_queries()["SRC2_discover_files"])(spark, str(tmp_path)).collect()
    assert [r.file_name for r in found] == ["nation.parquet", "orders.parquet", "region.parquet"]


def test_report_lines_are_taken_apart_once(spark, tmp_path):
    day = dt.date(2024, 3, 1)
    lines = [body("01-03-2024 10:00:00"), "|".join("abcdefghij"), "|".join("abcdefghijk"), " | ".join("abcdefghij") + "|  |k", "||" + "|".join("abcdefghijk") + "|\r"]
    write_report(tmp_path, day, [*lines, '| "Total | ' + "|".join("abcdefghij"), "Fecha|" + "|".join("abcdefghij")])
    for name, text in {"one line": "Generado: 02-03-2024 04:05", "two lines": "x\nGenerado: 02-03-2024 04:05"}.items():
        (tmp_path / name).write_text(text)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(tmp_path))
    parsed = reports.parse_reports(files)
    assert sorted((r.fecha_validacion, r.cod_eq, r.viajes_deducidos) for r in parsed.collect()) == [
        ("01-03-2024 10:00:00", "EQ1", "1"), *[("a", "d", "k")] * 3,
    ]
    plan = parsed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(r"\s*\|\s*") == 1
    header = files.select(F.substring_index("path", "/", -1).alias("name"), reports.report_header(F.decode("content", "ISO-8859-1")).alias("h"))
    found = {r["name"]: str(r.h.fecha_generacion) for r in header.collect()}
    assert found == {"one line": "None", "two lines": "2024-03-02 04:05:00", "Validaciones detalladas 010324.csv": "2024-03-02 04:05:00"}
