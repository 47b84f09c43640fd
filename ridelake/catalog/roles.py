"""Input tables of the operators, derived from the given sample tables.

Each derivation is a list of SQL expressions that Spark and the check database both
understand, so one text defines the input on both sides.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = [
    "region",
    "nation",
    "customer",
    "supplier",
    "part",
    "orders",
    "lineitem",
    "events",
    "documents",
    "embeddings",
    "pages",
    "benchmark",
    "labels",
    "conversations",
]


def station_number_code(number: str) -> str:
    """Three-letter station code of a station number from 0 to 24."""
    return f"'N' || chr(CAST(65 + FLOOR({number} / 5) AS INT)) || chr(CAST(65 + {number} % 5 AS INT))"


def line_name(number: str, owner: str) -> str:
    """Line of a station; stations 3, 13 and 23 lie on both lines, by the owner's id."""
    return (
        f"'LINEA ' || CAST(CAST((CASE WHEN {number} % 10 = 3 THEN FLOOR({owner} / 25) "
        f"ELSE {number} % 5 END) AS BIGINT) % 2 + 1 AS STRING)"
    )


def two_digits(value: str) -> str:
    return f"lpad(CAST(CAST({value} AS BIGINT) AS STRING), 2, '0')"


RAW = [
    "event_id",
    "user_id",
    "ts AS fecha_validacion",
    f"{line_name('(user_id % 25)', 'user_id')} AS linea",
    "'NATION_' || CAST(user_id % 25 AS STRING) AS estacion",
    "'EQ' || CAST(user_id AS STRING) AS cod_eq",
    "CASE event_type WHEN 'view' THEN 'Primera Entrada' WHEN 'signup' THEN 'REGULARIZACI?N EN SALIDA' "
    "WHEN 'purchase' THEN 'Transbordo_Sencillo' WHEN 'click' THEN 'Primera salida' ELSE 'otra' END "
    "AS tipo_validacion",
    "CASE event_id % 5 WHEN 0 THEN 'Monedero Consorcio' WHEN 1 THEN 'T?tulo Promocional' "
    "WHEN 2 THEN 'M?SMETRO' WHEN 3 THEN 'Billete-ocasional' ELSE 'Pase Gratuito' END AS tipo_titulo",
    "'C' || CAST(user_id AS STRING) AS id_tarjeta",
    "CASE WHEN value >= 1 THEN value END AS dinero_deducido",
    "CASE WHEN event_id % 11 <> 0 THEN value * 2 END AS saldo_restante",
    "CASE WHEN event_id % 13 <> 0 THEN CAST(1 + event_id % 2 AS BIGINT) END AS viajes_deducidos",
    "event_id % 7 = 0 AS fecha_validacion_hora_estimada",
    "CAST(CAST(ts AS DATE) AS STRING) AS dia",
    "event_id AS _orden_manifest",
    "CASE event_id % 5 WHEN 0 THEN 'equipment_first_seen' WHEN 1 THEN 'equipment_last_seen_observed' "
    "WHEN 2 THEN 'line_station_first_seen' WHEN 3 THEN 'line_station_last_seen_observed' "
    "ELSE 'renamed' END AS change_type",
    "ts AS effective_date",
]

_STATION = [
    "n_name AS estacion",
    "lower(n_name) AS station_join_key",
    "'Station ' || CAST(n_nationkey AS STRING) AS station_display_name",
    f"{station_number_code('n_nationkey')} AS station_abbrev",
    "n_nationkey AS network_order",
    "CAST(n_nationkey AS DOUBLE) AS lat",
    "'Z' || CAST(n_regionkey AS STRING) AS zone",
    "'G' || CAST(n_regionkey AS STRING) AS station_group",
    "n_nationkey % 10 = 3 AS is_interchange_candidate",
]
STATIONS = [
    (["'LINEA ' || CAST(n_nationkey % 5 % 2 + 1 AS STRING) AS linea", *_STATION], "true"),
    (["'LINEA 1' AS linea", *_STATION], "n_nationkey % 10 = 3"),
]

DEMAND_ROWS = [
    "CAST(o_orderdate AS DATE) AS service_date",
    f"{line_name('c_nationkey', 'o_custkey')} AS linea",
    "'NATION_' || CAST(c_nationkey AS STRING) AS estacion",
    f"{station_number_code('c_nationkey')} AS station_abbrev",
]
SERIES_ID = (
    "CASE WHEN station_abbrev IN ('NAD', 'NCD', 'NED') "
    "THEN station_abbrev || substring(linea, 7, 1) ELSE station_abbrev END AS series_id"
)

READINGS = [
    "l_shipdate AS ts",
    "l_quantity - 8 AS temp",
    "CASE WHEN l_linenumber = 1 AND l_discount > 0.075 THEN l_discount * 100 ELSE 0.0 END AS precip",
    "CAST(FLOOR(l_extendedprice / 1000) AS DOUBLE) AS wind",
    "round(abs(l_tax) * 1000) AS humidity",
    "1000 + l_quantity AS pressure",
]

SERVICES = [
    "fecha",
    "servicio",
    "CASE WHEN n % 5 <> 0 THEN lo || '_plan.xml' ELSE '  ' END AS archivo_xml_planificado",
    "CASE WHEN n % 6 <> 0 THEN hi || '_plan.xml' END AS archivo_xml_usado",
    f"{two_digits('5 + n % 3')} || ':30' AS inicio_serv_comercial",
    f"CASE WHEN n % 11 <> 0 THEN {two_digits('(22 + n % 4) % 24')} || ':15:00' END AS fin_l1_serv_comercial",
    f"CASE WHEN n % 7 <> 0 THEN {two_digits('(23 + n % 3) % 24')} || ':05' ELSE 'x' END AS fin_l2_serv_comercial",
]
SERVICE_GROUPS = (
    "SELECT CAST(o_orderdate AS DATE) AS fecha, MIN(o_orderpriority) AS servicio, "
    "MIN(o_orderstatus) AS lo, MAX(o_orderstatus) AS hi, COUNT(*) AS n FROM orders "
    "GROUP BY CAST(o_orderdate AS DATE)"
)

EVENT_ROWS = [
    "o_orderkey AS event_id",
    "'Event ' || CAST(o_orderkey AS STRING) AS title",
    "CASE o_orderstatus WHEN 'F' THEN 'Deportes' WHEN 'O' THEN 'Feria' ELSE 'Musica' END AS category",
    "o_orderdate + INTERVAL 1 HOUR * CAST(o_orderkey % 24 AS INT) AS start_raw",
    "o_orderdate + INTERVAL 1 HOUR * CAST((o_orderkey * 7) % 24 + "
    "(CASE WHEN o_orderkey % 10 = 0 THEN 48 ELSE 0 END) AS INT) AS end_raw",
    "CASE WHEN o_orderkey % 50 = 0 THEN NULL WHEN o_orderkey % 4 = 0 THEN lower(o_orderpriority) "
    "ELSE o_orderpriority END AS location_raw",
    "CASE WHEN o_orderkey % 9 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN 'sin datos' "
    "ELSE CAST(CAST(FLOOR(o_totalprice / 20000) AS BIGINT) AS STRING) || '.' || "
    "lpad(CAST(CAST(FLOOR(o_totalprice / 20) AS BIGINT) % 1000 AS STRING), 3, '0') || ' personas' END "
    "AS attendance_raw",
]

INCIDENT_ROWS = [
    "l_orderkey * 8 + l_linenumber AS incident_id",
    "CAST(l_shipdate AS DATE) AS origin_date",
    f"{two_digits('l_orderkey % 24')} || ':' || {two_digits('l_partkey % 60')} AS start_clock",
    f"{two_digits('(l_orderkey + l_suppkey % 5) % 24')} || ':' || {two_digits('l_suppkey % 60')} AS end_clock",
    "CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE CAST(CAST(l_quantity AS BIGINT) AS STRING) || ':' || "
    f"{two_digits('l_partkey % 60')} END AS delay_text",
    f"CASE l_suppkey % 8 WHEN 0 THEN {station_number_code('(l_partkey % 25)')} || ' - Anden' "
    "WHEN 1 THEN 'LINEA 1' WHEN 2 THEN 'Línea 2' WHEN 3 THEN 'Cruce ' || CAST(l_linenumber AS STRING) "
    "WHEN 4 THEN 'Cocheras norte' WHEN 5 THEN 'Línea 1 y 2' WHEN 6 THEN CAST(l_partkey AS STRING) "
    "ELSE 'PBI - hall' END AS location_raw",
    "CASE l_linenumber % 5 WHEN 0 THEN 'RETRASOS' WHEN 1 THEN 'Servicio parcial' "
    "WHEN 2 THEN 'Paro de la línea' WHEN 3 THEN 'Vía única temporal' END AS service_affectation",
]

# Yearly holidays of the sample calendar and the Thursdays before Easter.
FIXED_HOLIDAYS = [
    ("01-01", "Año Nuevo"),
    ("01-06", "Epifanía"),
    ("05-01", "Día del Trabajo"),
    ("08-15", "Asunción"),
    ("10-12", "Fiesta Nacional"),
    ("11-01", "Todos los Santos"),
    ("12-06", "Constitución"),
    ("12-08", "Inmaculada"),
    ("12-25", "Navidad"),
]
MAUNDY_THURSDAYS = {
    1995: ("04-13", "04-14"),
    1996: ("04-04", "04-05"),
    1997: ("03-27", "03-28"),
    1998: ("04-09", "04-10"),
    1999: ("04-01", "04-02"),
    2000: ("04-20", "04-21"),
    2001: ("04-12", "04-13"),
}
OPERATIONAL_DAYS = ["12-24", "12-31", "08-15"]


def _holiday_values() -> tuple[str, str]:
    official, operational = [], []
    for year, (thursday, friday) in MAUNDY_THURSDAYS.items():
        named = [*FIXED_HOLIDAYS, (thursday, "Jueves Santo"), (friday, "Viernes Santo")]
        official += [f"(DATE '{year}-{day}', '{name}')" for day, name in named]
        operational += [f"(DATE '{year}-{day}')" for day in OPERATIONAL_DAYS]
    return ", ".join(official), ", ".join(operational)


OFFICIAL_VALUES, OPERATIONAL_VALUES = _holiday_values()

# Scenario requests: one per month of orders.
SCENARIO_GROUPS = (
    "SELECT CAST(year(o_orderdate) * 100 + month(o_orderdate) AS BIGINT) AS ym, "
    "CAST(MIN(o_orderdate) AS DATE) AS first_day, CAST(MAX(o_orderdate) AS DATE) AS last_day, "
    "COUNT(*) AS n FROM orders GROUP BY CAST(year(o_orderdate) * 100 + month(o_orderdate) AS BIGINT)"
)
SCENARIOS = [
    "'E' || CAST(ym AS STRING) AS execution_id",
    "first_day AS range_start",
    "CASE WHEN n % 3 = 0 THEN CAST(first_day + INTERVAL 9 DAY AS DATE) "
    "WHEN n % 3 = 1 THEN CAST(last_day + INTERVAL 12 DAY AS DATE) ELSE last_day END AS range_end",
    "CASE n % 4 WHEN 0 THEN 'excel_import' WHEN 1 THEN 'derived' ELSE 'manual' END AS origin_type",
    "n % 5 = 0 AS manual_changes",
    "n % 7 = 0 AS accepted_items",
    "n % 2 = 0 AS import_modified",
    "n % 3 = 0 AS has_events",
    "n % 11 = 0 AS has_weather",
]

COMMENTS = [
    "conv_id * 1000 + turn AS frame_id",
    "DATE '2026-01-15' AS reference_date",
    "CASE (conv_id + turn) % 7 WHEN 0 THEN 'Crea evento deportivo para mañana con impacto muy alto en todas las estaciones. ' "
    "WHEN 1 THEN 'Lluvia intensa de 12,5 mm hoy, alerta naranja. ' "
    "WHEN 2 THEN 'Feria pasado mañana impacto medio. ' "
    "WHEN 3 THEN 'Programa concierto el 07/03/2026 de tipo cultural. ' "
    "WHEN 4 THEN 'Habrá un evento sin fecha. ' "
    "WHEN 5 THEN 'Lluvia el 31/12/2026 con 3 mm. ' ELSE '' END || text AS comment",
]


class Tables:
    """Sample tables of one folder and the derived operator inputs, all lazy."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        #: Frames that a query keeps for several branches, by name.
        self.kept: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.table(name)
        raise AttributeError(name)

    @cached_property
    def raw(self) -> DataFrame:
        return self.events.selectExpr(*RAW)

    @cached_property
    def stations(self) -> DataFrame:
        parts = [self.nation.filter(where).selectExpr(*columns) for columns, where in STATIONS]
        return parts[0].unionByName(parts[1])

    @cached_property
    def lines(self) -> DataFrame:
        return self.stations.select("linea").distinct().withColumn(
            "line_reference_path", F.concat(F.lit("path/"), F.col("linea"))
        )

    @cached_property
    def demand(self) -> DataFrame:
        """Observed daily series: orders per day and customer's station."""
        customers = self.customer.select("c_custkey", "c_nationkey")
        rows = self.orders.select("o_custkey", "o_orderdate").join(
            customers, F.col("o_custkey") == F.col("c_custkey")
        )
        return (
            rows.selectExpr(*DEMAND_ROWS)
            .groupBy("service_date", "linea", "estacion", "station_abbrev")
            .agg(F.count("*").alias("trip_count"))
            .selectExpr("*", SERIES_ID)
        )

    @cached_property
    def readings(self) -> DataFrame:
        return self.lineitem.selectExpr(*READINGS)

    @cached_property
    def weather_codes(self) -> DataFrame:
        return self.orders.groupBy(F.to_date("o_orderdate").alias("date")).agg(
            F.max(F.col("o_orderkey") % 100).alias("weather_code")
        )

    @cached_property
    def services(self) -> DataFrame:
        grouped = self.orders.groupBy(F.to_date("o_orderdate").alias("fecha")).agg(
            F.min("o_orderpriority").alias("servicio"),
            F.min("o_orderstatus").alias("lo"),
            F.max("o_orderstatus").alias("hi"),
            F.count("*").alias("n"),
        )
        return grouped.selectExpr(*SERVICES)

    @cached_property
    def event_rows(self) -> DataFrame:
        return self.orders.selectExpr(*EVENT_ROWS)

    @cached_property
    def location_matrix(self) -> DataFrame:
        """Priority x station code matrix with the number of orders modulo 3 as mark."""
        rows = (
            self.orders.filter("o_orderpriority <> '5-LOW'")
            .select("o_custkey", "o_orderpriority")
            .join(self.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        )
        counted = rows.groupBy("o_orderpriority", "c_nationkey").agg((F.count("*") % 3).alias("mark"))
        codes = [f"N{chr(65 + n // 5)}{chr(65 + n % 5)}" for n in range(25)]
        coded = counted.selectExpr(
            "o_orderpriority AS location_raw", f"{station_number_code('c_nationkey')} AS code", "mark"
        )
        # Codes that are no stations: an alias of an unknown station and a non-station.
        extra = self.orders.filter("o_orderpriority <> '5-LOW'").groupBy(
            F.col("o_orderpriority").alias("location_raw")
        ).agg((F.count("*") % 2).alias("PBI"), (F.count("*") % 5).alias("TyC"))
        wide = coded.groupBy("location_raw").pivot("code", codes).agg(F.max("mark"))
        return wide.join(extra, "location_raw")

    @cached_property
    def incident_rows(self) -> DataFrame:
        return self.lineitem.filter("l_returnflag = 'R'").selectExpr(*INCIDENT_ROWS)

    @cached_property
    def official_holidays(self) -> DataFrame:
        return self.spark.sql(f"SELECT * FROM VALUES {OFFICIAL_VALUES} AS h(holiday_date, holiday_name)")

    @cached_property
    def operational_holidays(self) -> DataFrame:
        return self.spark.sql(f"SELECT * FROM VALUES {OPERATIONAL_VALUES} AS h(holiday_date)")

    @cached_property
    def scenarios(self) -> DataFrame:
        month = (F.year("o_orderdate") * 100 + F.month("o_orderdate")).cast("long")
        grouped = self.orders.groupBy(month.alias("ym")).agg(
            F.to_date(F.min("o_orderdate")).alias("first_day"),
            F.to_date(F.max("o_orderdate")).alias("last_day"),
            F.count("*").alias("n"),
        )
        return grouped.selectExpr(*SCENARIOS)

    @cached_property
    def comments(self) -> DataFrame:
        return self.conversations.selectExpr(*COMMENTS)


def ctes() -> dict[str, str]:
    """Named SQL texts of the same inputs, for the check queries."""
    def select(columns: list[str], source: str, where: str = "") -> str:
        return f"SELECT {', '.join(columns)} FROM {source}" + (f" WHERE {where}" if where else "")

    codes = [f"N{chr(65 + n // 5)}{chr(65 + n % 5)}" for n in range(25)]
    joined = "orders JOIN customer ON o_custkey = c_custkey"
    return {
        "raw": select(RAW, "events"),
        "stations": " UNION ALL ".join(select(c, "nation", w) for c, w in STATIONS),
        "lines": "SELECT DISTINCT linea, 'path/' || linea AS line_reference_path FROM stations",
        "demand": (
            f"SELECT *, {SERIES_ID} FROM (SELECT service_date, linea, estacion, station_abbrev, "
            f"COUNT(*) AS trip_count FROM ({select(DEMAND_ROWS, joined)}) "
            "GROUP BY service_date, linea, estacion, station_abbrev)"
        ),
        "readings": select(READINGS, "lineitem"),
        "weather_codes": (
            "SELECT CAST(o_orderdate AS DATE) AS date, MAX(o_orderkey % 100) AS weather_code FROM orders "
            "GROUP BY CAST(o_orderdate AS DATE)"
        ),
        "services": select(SERVICES, f"({SERVICE_GROUPS})"),
        "event_rows": select(EVENT_ROWS, "orders"),
        "marks": (
            "SELECT o_orderpriority AS location_raw, "
            f"{station_number_code('c_nationkey')} AS code, COUNT(*) % 3 AS mark "
            f"FROM {joined} WHERE o_orderpriority <> '5-LOW' GROUP BY ALL "
            "UNION ALL SELECT o_orderpriority, 'PBI', COUNT(*) % 2 FROM orders "
            "WHERE o_orderpriority <> '5-LOW' GROUP BY ALL "
            "UNION ALL SELECT o_orderpriority, 'TyC', COUNT(*) % 5 FROM orders "
            "WHERE o_orderpriority <> '5-LOW' GROUP BY ALL"
        ),
        "incident_rows": select(INCIDENT_ROWS, "lineitem", "l_returnflag = 'R'"),
        "official": f"SELECT * FROM (VALUES {OFFICIAL_VALUES}) AS h(holiday_date, holiday_name)",
        "operational": f"SELECT * FROM (VALUES {OPERATIONAL_VALUES}) AS h(holiday_date)",
        "scenarios": select(SCENARIOS, f"({SCENARIO_GROUPS})"),
        "comments": select(COMMENTS, "conversations"),
        "station_codes": "SELECT * FROM (VALUES " + ", ".join(f"('{c}')" for c in codes) + ") AS c(code)",
    }
