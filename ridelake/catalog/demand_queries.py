"""Trips, daily demand, contracts and checked joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ridelake.catalog.registry import define, query
from ridelake.operators import calendar, demand, joins, quality

define(
    "station_daily",
    "SELECT CAST(fecha_validacion AS DATE) AS service_date, linea, estacion, COUNT(*) AS trip_count, "
    "MIN(fecha_validacion) AS first_ts, MAX(fecha_validacion) AS last_ts, "
    "COUNT(DISTINCT cod_eq) AS raw_unique_equipment_count, "
    "COUNT(*) FILTER (WHERE fecha_validacion_hora_estimada) AS raw_rows_with_estimated_time, "
    "COUNT(*) FILTER (WHERE dinero_deducido IS NULL OR saldo_restante IS NULL) AS raw_missing_money_fields_count, "
    "COUNT(*) FILTER (WHERE viajes_deducidos IS NULL) AS raw_missing_trip_fields_count FROM trips GROUP BY ALL",
)
STATION_DAILY_COLUMNS = (
    "service_date::VARCHAR AS service_date, linea, estacion, trip_count, "
    "strftime(first_ts, '%Y-%m-%d %H:%M:%S') AS first_trip_timestamp, "
    "strftime(last_ts, '%Y-%m-%d %H:%M:%S') AS last_trip_timestamp, raw_unique_equipment_count, "
    "raw_rows_with_estimated_time, raw_missing_money_fields_count, raw_missing_trip_fields_count"
)


@query("FLT1_filter_trips", "SELECT tipo, titulo, COUNT(*) AS n FROM trips GROUP BY ALL")
def filter_trips(t):
    kept = demand.filter_trips(t.raw)
    return kept.groupBy(
        F.col("tipo_validacion_normalizada").alias("tipo"), F.col("tipo_titulo_limpio").alias("titulo")
    ).agg(F.count("*").alias("n"))


@query("AG1_station_daily_trips", f"SELECT {STATION_DAILY_COLUMNS} FROM station_daily")
def station_daily_trips(t):
    return demand.station_daily_trips(t.raw)


@query(
    "AG1_JN1_trips_with_station",
    "SELECT d.service_date::VARCHAR AS service_date, d.linea, d.estacion, d.trip_count, s.station_abbrev, "
    "s.station_display_name, s.zone FROM station_daily d LEFT JOIN stations s USING (linea, estacion)",
)
def trips_with_station(t):
    """Flagship: trips per day, line and station with station attributes."""
    daily = demand.station_daily_trips(t.raw).select("service_date", "linea", "estacion", "trip_count")
    return joins.left_join(
        daily,
        t.stations.select("linea", "estacion", "station_abbrev", "station_display_name", "zone"),
        ["linea", "estacion"],
    )


@query(
    "AG2_network_changes",
    "SELECT CAST(effective_date AS DATE)::VARCHAR AS service_date, linea, estacion, "
    "COUNT(*) FILTER (WHERE change_type = 'equipment_first_seen') AS network_equipment_first_seen_count, "
    "COUNT(*) FILTER (WHERE change_type = 'equipment_last_seen_observed') AS network_equipment_last_seen_observed_count, "
    "COUNT(*) FILTER (WHERE change_type = 'line_station_first_seen') AS network_line_station_first_seen_count, "
    "COUNT(*) FILTER (WHERE change_type = 'line_station_last_seen_observed') AS network_line_station_last_seen_observed_count, "
    "COUNT(*) FILTER (WHERE change_type <> 'renamed') AS network_change_count FROM raw GROUP BY ALL",
)
def network_changes(t):
    return demand.network_changes_daily(t.raw)


@query(
    "AG3_station_groups",
    "SELECT station_abbrev, min(station_join_key) AS station_join_key, min(station_group) AS station_group, "
    "min(station_display_name) AS station_display_name, COUNT(DISTINCT linea) AS line_count, "
    "COUNT(DISTINCT linea) > 1 AS is_shared_between_lines FROM stations GROUP BY station_abbrev",
)
def station_groups(t):
    return demand.station_groups(t.stations)


@query(
    "AG4_shared_codes",
    "SELECT station_abbrev FROM (SELECT station_abbrev, COUNT(DISTINCT linea) AS n FROM stations "
    "GROUP BY station_abbrev) WHERE n > 1 UNION SELECT 'GDL' UNION SELECT 'PCH'",
)
def shared_codes(t):
    return demand.shared_codes(t.stations)


@query(
    "AG11_manifest_by_day",
    "SELECT dia, MAX(_orden_manifest) AS manifest_id FROM raw GROUP BY dia",
)
def manifest_by_day(t):
    return demand.manifest_by_day(t.raw)


@query(
    "AG30_daily_total",
    "SELECT dia, CAST(coalesce(SUM(viajes_deducidos), 0) AS BIGINT) AS viajes_deducidos FROM raw GROUP BY dia",
)
def daily_total(t):
    return demand.daily_total(t.raw)


@query(
    "STR2_interval_demand",
    "SELECT estacion, strftime(time_bucket(INTERVAL 15 MINUTE, fecha_validacion), '%Y-%m-%d %H:%M:%S') AS interval_start, "
    "COUNT(*) AS trip_count FROM trips GROUP BY ALL",
)
def interval_demand(t):
    return demand.interval_demand(demand.filter_trips(t.raw), series="estacion")


# Quality ----------------------------------------------------------------------------------


@query(
    "QC1_QC2_null_counts",
    "SELECT 'dinero_deducido' AS column_name, COUNT(*) FILTER (WHERE dinero_deducido IS NULL) AS null_count FROM raw "
    "UNION ALL SELECT 'saldo_restante', COUNT(*) FILTER (WHERE saldo_restante IS NULL) FROM raw "
    "UNION ALL SELECT 'viajes_deducidos', COUNT(*) FILTER (WHERE viajes_deducidos IS NULL) FROM raw",
)
def null_counts(t):
    checked = quality.require_columns(t.raw, ["dinero_deducido", "saldo_restante", "viajes_deducidos"])
    return quality.null_counts(checked, ["dinero_deducido", "saldo_restante", "viajes_deducidos", "absent"])


@query(
    "QC3_duplicate_rows",
    "SELECT COUNT(*) AS row_count, COUNT(DISTINCT (l_orderkey, l_linenumber)) AS distinct_keys, "
    "COUNT(*) - COUNT(DISTINCT (l_orderkey, l_linenumber)) AS duplicate_rows FROM lineitem",
)
def duplicate_rows(t):
    return quality.duplicate_rows(t.lineitem, ["l_orderkey", "l_linenumber"])


@query(
    "QC4_schema_violations",
    "SELECT * FROM (SELECT 'value' AS column_name, 'minimum' AS check_name, COUNT(*) FILTER (WHERE value - 5 < 0) AS violations FROM events "
    "UNION ALL SELECT 'value', 'type', COUNT(*) FILTER (WHERE value IS NULL) FROM events UNION ALL SELECT 'value', 'nullability', "
    "COUNT(*) FILTER (WHERE value IS NULL) FROM events "
    "UNION ALL SELECT 'props', 'type', COUNT(*) FROM events)",
)
def schema_violations(t):
    rules = {
        "value": quality.ColumnRule("double", nullable=False, minimum=0),
        "props": quality.ColumnRule("bigint"),
    }
    shifted = t.events.select((F.col("value") - 5).alias("value"), "props")
    return quality.schema_violations(shifted, rules)


@query(
    "QC5_contract_report",
    "SELECT 'raw' AS table_name, COUNT(*) AS row_count, COUNT(*) - COUNT(DISTINCT (dia, linea, estacion)) AS duplicate_rows, "
    "CAST(0 AS BIGINT) AS null_key_cells FROM raw",
)
def contract_report(t):
    contract = quality.Contract("raw", ("dia", "linea", "estacion"), ("dia", "linea", "estacion"))
    return quality.contract_report(t.raw, contract)


@query(
    "QC6_inspect",
    "SELECT 'row_count' AS item, '' AS column_name, COUNT(*)::VARCHAR AS value FROM orders "
    "UNION ALL SELECT 'column_count', '', '6' "
    "UNION ALL SELECT 'date_min', 'o_orderdate', CAST(MIN(o_orderdate) AS DATE)::VARCHAR FROM orders "
    "UNION ALL SELECT 'date_max', 'o_orderdate', CAST(MAX(o_orderdate) AS DATE)::VARCHAR FROM orders "
    "UNION ALL SELECT 'duplicate_count', '', (COUNT(*) - COUNT(DISTINCT o_custkey))::VARCHAR FROM orders "
    "UNION ALL SELECT 'null_count', 'o_orderpriority', COUNT(*)::VARCHAR FROM orders WHERE o_orderkey % 4 = 0 "
    "UNION ALL SELECT 'dtype', column_name, CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string' WHEN 'DATE' THEN 'date' "
    "WHEN 'TIMESTAMP' THEN 'timestamp_ntz' END FROM (SELECT unnest(['o_orderkey', 'o_custkey', 'o_orderstatus', 'o_totalprice', 'o_orderdate', 'o_orderpriority']) AS column_name, "
    "unnest([typeof(o_orderkey), typeof(o_custkey), typeof(o_orderstatus), typeof(o_totalprice), typeof(o_orderdate), typeof(o_orderpriority)]) AS data_type FROM (SELECT * FROM orders LIMIT 1))",
)
def inspect(t):
    holed = t.orders.withColumn(
        "o_orderpriority", F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderpriority"))
    )
    return quality.inspect(holed, ["o_custkey"], ["o_orderdate"])


@query(
    "QC7_inspection_summary",
    "SELECT 'orders' AS source_name, COUNT(*) AS row_count, CAST(6 AS BIGINT) AS column_count, "
    "COUNT(*) - COUNT(DISTINCT o_orderkey) AS duplicate_count, CAST(MIN(o_orderdate) AS DATE)::VARCHAR AS date_min, "
    "CAST(MAX(o_orderdate) AS DATE)::VARCHAR AS date_max, 'open=' || COUNT(*) FILTER (WHERE o_orderstatus = 'O') || "
    "'; urgent=' || COUNT(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS notes FROM orders "
    "UNION ALL SELECT 'events', COUNT(*), 6, COUNT(*) - COUNT(DISTINCT event_id), CAST(MIN(ts) AS DATE)::VARCHAR, "
    "CAST(MAX(ts) AS DATE)::VARCHAR, 'errors=' || COUNT(*) FILTER (WHERE event_type = 'error') FROM events",
)
def inspection_summary(t):
    return quality.inspection_summary(
        {
            "orders": (
                t.orders,
                ["o_orderkey"],
                "o_orderdate",
                {"open": F.col("o_orderstatus") == "O", "urgent": F.col("o_orderpriority") == "1-URGENT"},
            ),
            "events": (t.events, ["event_id"], "ts", {"errors": F.col("event_type") == "error"}),
        }
    )


@query(
    "QC9_coverage_gaps",
    "SELECT d::VARCHAR AS missing_day FROM (SELECT unnest(generate_series((SELECT MAX(o_orderdate) FROM orders) - INTERVAL 3 DAY "
    "- INTERVAL 899 DAY, (SELECT MAX(o_orderdate) FROM orders) - INTERVAL 3 DAY, INTERVAL 1 DAY))::DATE AS d) "
    "WHERE d NOT IN (SELECT CAST(o_orderdate AS DATE) FROM orders WHERE o_orderkey % 4 = 0)",
)
def coverage_gaps(t):
    """Days without an order of every fourth key, up to three days before the newest order."""
    days = t.orders.filter("o_orderkey % 4 = 0").select(F.to_date("o_orderdate").alias("day"))
    newest = t.orders.select(F.max(F.to_date("o_orderdate"))).scalar()
    return quality.coverage_gaps(days, "day", 900, 3, newest=newest)


@query(
    "QC9_latest_gaps",
    "SELECT d::VARCHAR AS missing_day FROM (SELECT unnest(generate_series((SELECT MAX(o_orderdate) FROM orders) - INTERVAL 1999 DAY, "
    "(SELECT MAX(o_orderdate) FROM orders), INTERVAL 1 DAY))::DATE AS d) "
    "WHERE d NOT IN (SELECT CAST(o_orderdate AS DATE) FROM orders)",
)
def latest_gaps(t):
    return quality.coverage_gaps(t.orders.select(F.to_date("o_orderdate").alias("day")), "day", 2000)


@query(
    "QC10_dataset_summary",
    "SELECT 'events' AS table_name, COUNT(*) AS row_count, CAST(6 AS BIGINT) AS column_count, 'event_id' AS unique_key FROM events",
)
def dataset_summary(t):
    return quality.dataset_summary(t.events, quality.Contract("events", unique_key=("event_id",)))


@query(
    "QC11_fingerprint",
    "SELECT COUNT(*) * 2 AS rows_twice, TRUE AS same_xor, TRUE AS same_sum FROM lineitem",
)
def fingerprint(t):
    """The digest of a table and of the same table in another row order must agree."""
    straight = quality.table_fingerprint(t.lineitem)
    shuffled = quality.table_fingerprint(t.lineitem.repartition("l_partkey"))
    both = straight.unionByName(shuffled)
    return both.agg(
        F.sum("row_count").alias("rows_twice"),
        (F.countDistinct("xor_digest") == 1).alias("same_xor"),
        (F.countDistinct("sum_digest") == 1).alias("same_sum"),
    )


LEAF_SQL = (
    "SELECT o_custkey % 50 AS parent, CASE WHEN o_orderkey % 401 = 0 THEN 'drifted' "
    "WHEN o_orderkey % 97 = 0 THEN 'insufficient_data' ELSE 'stable' END AS status FROM orders"
)


@query(
    "QC15_nested_status",
    f"SELECT parent, CASE WHEN bool_or(status = 'drifted') THEN 'drifted' WHEN bool_or(status = 'insufficient_data') "
    f"THEN 'insufficient_data' ELSE 'stable' END AS status FROM ({LEAF_SQL}) GROUP BY parent",
)
def nested_status(t):
    leaf = (
        F.when(F.col("o_orderkey") % 401 == 0, "drifted")
        .when(F.col("o_orderkey") % 97 == 0, "insufficient_data")
        .otherwise("stable")
    )
    leaves = t.orders.select((F.col("o_custkey") % 50).alias("parent"), leaf.alias("status"))
    return quality.nested_status(leaves, "parent")


# Joins --------------------------------------------------------------------------------------


@query(
    "JN1_safe_left_join",
    "SELECT c_custkey, n_name, CAST(n_regionkey AS INT) AS n_regionkey FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey",
)
def safe_left_join(t):
    joined = joins.safe_left_join(
        t.customer.select("c_custkey", "c_nationkey"), t.nation, ["c_nationkey"], ["n_nationkey"], required=True
    )
    return joined.select("c_custkey", "n_name", "n_regionkey")


@query(
    "JN1_unmatched_keys",
    "SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 20)",
)
def unmatched_keys(t):
    return joins.unmatched_keys(t.orders, t.customer.filter("c_nationkey < 20"), ["o_custkey"], ["c_custkey"])


@query(
    "JN2_contract_join",
    "SELECT p_partkey, coalesce(n, 0) AS n, coalesce(q, 0) AS q FROM part LEFT JOIN (SELECT l_partkey, COUNT(*) AS n, "
    "SUM(l_quantity) AS q FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_partkey) ON p_partkey = l_partkey",
)
def contract_join(t):
    returns = t.lineitem.filter("l_returnflag = 'R'").groupBy("l_partkey").agg(
        F.count("*").alias("n"), F.sum("l_quantity").alias("q")
    )
    contract = joins.JoinContract(("p_partkey",), ("l_partkey",), missing_policy="fill_zero")
    return joins.contract_join(t.part.select("p_partkey"), returns, contract)


define("trip_days", "SELECT DISTINCT service_date AS date FROM station_daily")
define(
    "changes",
    "SELECT CAST(effective_date AS DATE) AS service_date, linea, estacion, "
    "COUNT(*) FILTER (WHERE change_type <> 'renamed') AS network_change_count FROM raw "
    "WHERE event_id % 3 = 0 GROUP BY ALL",
)


@query(
    "JN3_model_base",
    "SELECT d.service_date::VARCHAR AS service_date, d.linea, d.estacion, d.trip_count, year(d.service_date) AS year, "
    "isodow(d.service_date) AS day_of_week, s.zone, s.network_order, s.station_abbrev, 'path/' || d.linea AS line_reference_path, "
    "coalesce(c.network_change_count, 0) AS network_change_count, CASE WHEN s.station_abbrev IN ('NAD','NCD','NED') "
    "THEN s.station_abbrev || substring(d.linea, 7, 1) ELSE s.station_abbrev END AS series_id FROM station_daily d "
    "LEFT JOIN stations s USING (linea, estacion) LEFT JOIN changes c USING (service_date, linea, estacion)",
)
def model_base(t):
    from ridelake.functions import times

    daily = demand.station_daily_trips(t.raw)
    days = t.raw.select(F.to_date("fecha_validacion").alias("date")).distinct()
    external = days.withColumns(
        {k: v for k, v in times.calendar_parts(F.col("date")).items() if k in ("year", "day_of_week")}
    )
    changes = demand.network_changes_daily(t.raw.filter("event_id % 3 = 0"))
    base = demand.build_model_base(daily, external, t.stations, t.lines, changes)
    return base.select(
        "service_date", "linea", "estacion", "trip_count", "year", "day_of_week", "zone", "network_order",
        "station_abbrev", "line_reference_path", "network_change_count", "series_id",
    )


@query(
    "JN6_nearest_holiday",
    "SELECT date::VARCHAR AS date, (SELECT MIN(holiday_date) FROM official WHERE holiday_date >= date) - date AS next_days, "
    "date - (SELECT MAX(holiday_date) FROM official WHERE holiday_date <= date) AS prev_days FROM order_days",
)
def nearest_holiday(t):
    days = t.orders.select(F.to_date("o_orderdate").alias("date")).distinct()
    near = joins.nearest_holiday(days, "date", t.official_holidays, "holiday_date")
    return near.select(
        "date",
        F.col("days_to_next_holiday").cast("long").alias("next_days"),
        F.col("days_since_prev_holiday").cast("long").alias("prev_days"),
    )


@query(
    "JN23_semi_anti",
    "SELECT CAST(o_orderdate AS DATE)::VARCHAR AS day, COUNT(*) AS n FROM orders WHERE CAST(o_orderdate AS DATE) IN "
    "(SELECT holiday_date FROM official) AND CAST(o_orderdate AS DATE) NOT IN (SELECT holiday_date FROM operational) GROUP BY ALL",
)
def semi_anti(t):
    days = t.orders.groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n"))
    official = t.official_holidays.select(F.col("holiday_date").alias("day"))
    operational = t.operational_holidays.select(F.col("holiday_date").alias("day"))
    return joins.drop_listed(joins.keep_listed(days, official, ["day"]), operational, ["day"])


@query(
    "JN_asof_blocked",
    "SELECT e.event_id, p.event_id AS purchase_id FROM events e ASOF LEFT JOIN "
    "(SELECT user_id, ts, event_id FROM events WHERE event_type = 'purchase') p ON e.user_id = p.user_id AND e.ts >= p.ts",
)
def asof_blocked(t):
    """Last purchase of the user before each event, swept in blocks of days."""
    purchases = t.events.filter("event_type = 'purchase'").select(
        "user_id", F.col("ts").alias("purchase_ts"), F.col("event_id").alias("purchase_id")
    )
    found = joins.asof_join(
        t.events.select("user_id", "ts", "event_id"),
        purchases,
        ["user_id"],
        "ts",
        "purchase_ts",
        ["purchase_id"],
        block=F.to_date,
    )
    return found.select("event_id", "purchase_id")


@query(
    "PRJ3_station_reference",
    "SELECT linea, estacion, station_join_key, station_display_name, station_abbrev, network_order, lat, zone, station_group, "
    "is_interchange_candidate FROM stations",
)
def station_reference(t):
    return demand.station_reference(t.stations.withColumn("n_validations", F.lit(1)))


@query("PRJ3_line_reference", "SELECT linea, line_reference_path FROM lines")
def line_reference(t):
    return demand.line_reference(t.lines.withColumn("internal_note", F.lit("x")))


# Sorts, sets --------------------------------------------------------------------------------


@query(
    "SRT1_ordered_output",
    "SELECT dia, linea, estacion, COUNT(*) AS n FROM raw GROUP BY ALL",
)
def ordered_output(t):
    return t.raw.groupBy("dia", "linea", "estacion").agg(F.count("*").alias("n")).orderBy("dia", "linea", "estacion")


@query(
    "SRT2_rank_map_order",
    "SELECT o_orderpriority, COUNT(*) AS n FROM orders GROUP BY ALL",
)
def rank_map_order(t):
    from ridelake.operators.analysis import rank_of

    order = ["5-LOW", "3-MEDIUM", "1-URGENT", "2-HIGH", "4-NOT SPECIFIED"]
    counted = t.orders.groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    return counted.orderBy(rank_of(F.col("o_orderpriority"), order))


@query(
    "SRT3_top_days",
    "SELECT CAST(o_orderdate AS DATE)::VARCHAR AS day, round(SUM(o_totalprice), 2) AS total FROM orders GROUP BY ALL "
    "ORDER BY total DESC, day LIMIT 20",
)
def top_days(t):
    """The feature is the limit: a report of the 20 largest days."""
    days = t.orders.groupBy(F.to_date("o_orderdate").alias("day")).agg(
        F.round(F.sum("o_totalprice"), 2).alias("total")
    )
    return days.orderBy(F.desc("total"), "day").limit(20)


@query(
    "SET1_extend_calendar",
    "SELECT date::VARCHAR AS date, year(date) AS year, isodow(date) AS day_of_week, FALSE AS is_holiday, "
    "CASE WHEN d % 2 = 0 THEN 'stored' ELSE 'auto_calendar_extension_missing_external_context' END AS run_id, "
    "CAST(CASE WHEN d % 2 = 0 THEN 21.5 END AS DOUBLE) AS temp_mean_c FROM (SELECT *, dayofyear(date) AS d FROM order_days)",
)
def extend_calendar(t):
    from ridelake.functions import times

    days = t.orders.select(F.to_date("o_orderdate").alias("date")).distinct()
    parts = times.calendar_parts(F.col("date"))
    stored = days.filter(F.dayofyear("date") % 2 == 0).select(
        "date",
        parts["year"].alias("year"),
        parts["day_of_week"].alias("day_of_week"),
        F.lit(False).alias("is_holiday"),
        F.lit("stored").alias("run_id"),
        F.lit(21.5).alias("temp_mean_c"),
    )
    return calendar.extend_calendar(stored, days)


@query(
    "SET5_SET6_distinct_difference",
    "SELECT DISTINCT CAST(l_shipdate AS DATE)::VARCHAR AS day FROM lineitem WHERE CAST(l_shipdate AS DATE) NOT IN "
    "(SELECT CAST(o_orderdate AS DATE) FROM orders WHERE o_orderpriority = '1-URGENT')",
)
def distinct_difference(t):
    shipped = t.lineitem.select(F.to_date("l_shipdate").alias("day")).distinct()
    urgent = t.orders.filter("o_orderpriority = '1-URGENT'").select(F.to_date("o_orderdate").alias("day"))
    return joins.drop_listed(shipped, urgent, ["day"])


@query(
    "FLT3_filter_sparse",
    "SELECT series_id, CAST(SUM(trip_count) AS BIGINT) AS trips FROM demand WHERE series_id NOT IN ('NAD1', 'NCD2') GROUP BY ALL",
)
def filter_sparse(t):
    from ridelake.operators.features import drop_sparse

    kept = drop_sparse(t.demand, ["NAD1", "NCD2"])
    return kept.groupBy("series_id").agg(F.sum("trip_count").alias("trips"))


@query(
    "FLT4_filter_overlap",
    "SELECT event_id FROM event_rows WHERE CAST(start_raw AS DATE) <= DATE '1998-06-30' AND CAST(end_raw AS DATE) >= DATE '1998-06-01'",
)
def filter_overlap(t):
    dated = t.event_rows.select(
        "event_id", F.to_date("start_raw").alias("start_date"), F.to_date("end_raw").alias("end_date")
    )
    kept = calendar.filter_overlap(
        dated, "start_date", "end_date", F.lit("1998-06-01").cast("date"), F.lit("1998-06-30").cast("date")
    )
    return kept.select("event_id")


@query(
    "FLT5_truncate_at_zero",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey < (SELECT MIN(o_orderkey) FROM orders WHERE "
    "o_orderkey > (SELECT MAX(o_orderkey) * 0.8 FROM orders) AND o_custkey % 7 = 0)",
)
def truncate_at_zero(t):
    limit = t.orders.select(F.max("o_orderkey") * 0.8).scalar()
    zeroed = t.orders.withColumn(
        "v", F.when((F.col("o_orderkey") > limit) & (F.col("o_custkey") % 7 == 0), 0.0).otherwise(F.col("o_totalprice"))
    )
    kept = calendar.truncate_at_first_zero(zeroed, "o_orderkey", "v")
    return kept.select("o_orderkey", "o_totalprice")


@query(
    "FLT7_filter_weekdays",
    "SELECT CAST(o_orderdate AS DATE)::VARCHAR AS day, COUNT(*) AS n FROM orders WHERE dayofweek(o_orderdate) IN (0, 6) GROUP BY ALL",
)
def filter_weekdays(t):
    days = t.orders.groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n"))
    return calendar.filter_weekdays(days, "day", [0, 6])
