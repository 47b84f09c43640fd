"""Distribution drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from ridelake.catalog import derived
from ridelake.catalog.registry import define, query
from ridelake.operators import calendar, demand, drift, quality
from ridelake.operators.scale import running_totals

# Samples by ship date: the last 400 days against everything older than 800 days.
define(
    "samples",
    "SELECT feature, value, CASE WHEN day < hi - 800 THEN 'baseline' WHEN day >= hi - 400 THEN 'target' END AS sample FROM (SELECT CAST(l_shipdate AS DATE) AS day, "
    "(SELECT MAX(CAST(l_shipdate AS DATE)) FROM lineitem) AS hi, unnest(['l_quantity', 'l_extendedprice', 'l_discount']) AS feature, unnest([l_quantity, "
    "l_extendedprice, abs(l_discount)]) AS value FROM lineitem) WHERE day < hi - 800 OR day >= hi - 400",
)

def define_drift(prefix: str) -> None:
    """CTEs of the drift verdict over the samples of ``{prefix}samples``."""
    p = prefix
    define(
        f"{p}edges0",
        f"SELECT feature, list_sort(list_distinct(quantile_cont(value, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]))) AS q FROM {p}samples WHERE sample = 'baseline' GROUP BY feature",
    )
    define(
        f"{p}edges",
        f"SELECT feature, list_transform(q, lambda e, i: CASE WHEN i = 1 THEN e - 1e-5 WHEN i = len(q) THEN e + 1e-5 ELSE e END) AS q, len(q) - 1 AS bins FROM {p}edges0",
    )
    define(
        f"{p}sizes",
        f"SELECT feature, COUNT(*) FILTER (WHERE sample = 'baseline') AS nb, COUNT(*) FILTER (WHERE sample = 'target') AS nt FROM {p}samples WHERE sample IS NOT NULL GROUP BY feature",
    )
    define(
        f"{p}bucketed",
        f"SELECT s.feature, s.sample, least(len(list_filter(e.q, lambda x: x <= s.value)), e.bins) AS b FROM {p}samples s JOIN {p}edges e USING (feature) WHERE s.value BETWEEN e.q[1] AND e.q[-1]",
    )
    define(
        f"{p}shares",
        "SELECT g.feature, g.b, (COUNT(*) FILTER (WHERE k.sample = 'baseline') + 0.5) / (ANY_VALUE(n.nb) + 0.5 * ANY_VALUE(g.bins)) AS pb, "
        "(COUNT(*) FILTER (WHERE k.sample = 'target') + 0.5) / (ANY_VALUE(n.nt) + 0.5 * ANY_VALUE(g.bins)) AS pt FROM "
        f"(SELECT feature, bins, unnest(range(1, bins + 1)) AS b FROM {p}edges) g JOIN {p}sizes n USING (feature) LEFT JOIN {p}bucketed k ON k.feature = g.feature AND k.b = g.b GROUP BY g.feature, g.b",
    )
    define(f"{p}psis", f"SELECT feature, SUM((pt - pb) * ln(pt / pb)) AS psi FROM {p}shares GROUP BY feature")
    define(
        f"{p}distances",
        "SELECT feature, MAX(abs(cb / nb - ct / nt)) AS d FROM (SELECT feature, SUM(b) OVER w AS cb, SUM(t) OVER w AS ct FROM (SELECT feature, value, COUNT(*) FILTER "
        f"(WHERE sample = 'baseline') AS b, COUNT(*) FILTER (WHERE sample = 'target') AS t FROM {p}samples WHERE sample IS NOT NULL GROUP BY feature, value) WINDOW w AS (PARTITION BY feature ORDER BY value)) "
        f"JOIN {p}sizes USING (feature) GROUP BY feature",
    )
    define(
        f"{p}tested",
        "SELECT feature, nb, nt, psi, d, CASE WHEN x < 0.2 THEN 1 ELSE least(greatest(list_sum(list_transform(range(1, 101), lambda k: CASE WHEN k % 2 = 1 THEN 2 ELSE -2 END * exp(-2.0 * k * k * x * x))), 0), 1) END AS p "
        f"FROM (SELECT *, (e + 0.12 + 0.11 / e) * d AS x FROM (SELECT feature, nb, nt, coalesce(psi, 0) AS psi, coalesce(d, 0) AS d, nullif(sqrt(nb * nt / (nb + nt)), 0) AS e "
        f"FROM {p}sizes LEFT JOIN {p}psis USING (feature) LEFT JOIN {p}distances USING (feature)))",
    )
    define(
        f"{p}verdicts",
        "SELECT feature, nb AS n_baseline, nt AS n_target, CASE WHEN ok THEN round(d, 9) ELSE 0 END AS ks_statistic, CASE WHEN ok THEN round(p, 9) ELSE 1 END AS p_value, CASE WHEN ok THEN round(psi, 6) ELSE 0 END AS psi, "
        "ok AND coalesce(p < 0.05 OR psi > 0.25, false) AS drift_detected, CASE WHEN NOT ok THEN 'insufficient_data' WHEN p < 0.05 OR psi > 0.25 THEN 'drifted' ELSE 'stable' END AS status "
        f"FROM (SELECT *, nb >= 10 AND nt >= 10 AS ok FROM {p}tested)",
    )


define_drift("")


def _samples(t):
    newest = t.lineitem.select(F.max(F.to_date("l_shipdate"))).scalar()
    day = F.to_date("l_shipdate")
    sample = F.when(day < F.date_sub(newest, 800), "baseline").when(day >= F.date_sub(newest, 400), "target")
    rows = t.lineitem.select(
        sample.alias("sample"), "l_quantity", "l_extendedprice", F.abs("l_discount").alias("l_discount")
    ).filter("sample IS NOT NULL")
    return rows.unpivot(["sample"], ["l_quantity", "l_extendedprice", "l_discount"], "feature", "value")


@query(
    "MON1_psi",
    "SELECT feature, nb AS n_baseline, nt AS n_target, round(psi, 6) AS psi FROM psis JOIN sizes USING (feature)",
)
def psi(t):
    return derived.rounded(drift.psi(drift.value_counts(_samples(t))))


@query(
    "MON2_ks_statistic",
    "SELECT feature, nb AS n_baseline, nt AS n_target, round(d, 9) AS ks_statistic FROM distances JOIN sizes USING (feature)",
)
def ks_statistic(t):
    return derived.rounded(drift.ks_statistic(drift.value_counts(_samples(t))), 9)


@query(
    "MON1_baseline_quantiles",
    "SELECT feature, unnest(range(1, len(q) + 1)) AS position, round(unnest(q), 6) AS edge FROM edges0",
)
def baseline_quantiles(t):
    edges = drift.baseline_quantiles(drift.value_counts(_samples(t)))
    return edges.select("feature", F.posexplode("edges").alias("position", "edge")).select(
        "feature", (F.col("position") + 1).cast("long").alias("position"), F.round("edge", 6).alias("edge")
    )


def _shown(rows, *more):
    return rows.select(
        "feature", "n_baseline", "n_target", F.round("ks_statistic", 9).alias("ks_statistic"), F.round("p_value", 9).alias("p_value"),
        F.round("psi", 6).alias("psi"), "drift_detected", "status", *more,
    )


@query("MON3_drift_check", "SELECT * FROM verdicts")
def drift_check(t):
    return _shown(drift.drift_check(_samples(t)))


_LAST = "CASE WHEN d < hi - 60 THEN 'baseline' WHEN d >= hi - 30 THEN 'target' END AS sample"
define(
    "monitor_weather",
    "SELECT unnest(['temp_max_c', 'temp_min_c', 'precip_mm']) AS feature, unnest([temp_max_c, temp_min_c, precip_mm])::DOUBLE AS value, date AS d, (SELECT MAX(date) FROM weather) AS hi FROM weather",
)
define(
    "order_samples",
    f"SELECT feature, value, {_LAST} FROM monitor_weather WHERE feature = 'temp_max_c' UNION ALL SELECT 'demand_validations', n, {_LAST} FROM "
    "(SELECT CAST(o_orderdate AS DATE) AS d, COUNT(*)::DOUBLE AS n, (SELECT CAST(MAX(o_orderdate) AS DATE) FROM orders) AS hi FROM orders GROUP BY ALL)",
)
define_drift("order_")
define(
    "trip_samples",
    f"SELECT feature, value, {_LAST} FROM monitor_weather UNION ALL SELECT 'demand_validations', n, {_LAST} FROM "
    "(SELECT CAST(dia AS DATE) AS d, coalesce(SUM(viajes_deducidos), 0)::DOUBLE AS n, (SELECT CAST(MAX(dia) AS DATE) FROM raw) AS hi FROM raw GROUP BY ALL)",
)
define_drift("trip_")


@query(
    "MON4_drift_monitor",
    "SELECT *, CASE feature WHEN 'demand_validations' THEN 'demand_validations' ELSE 'weather_features' END AS parent FROM order_verdicts",
)
def drift_monitor(t):
    daily = t.orders.groupBy(F.to_date("o_orderdate").alias("dia")).agg(F.count("*").alias("viajes_deducidos"))
    weather = calendar.weather_daily(t.readings)
    return _shown(drift.drift_monitor(daily, weather, ["temp_max_c", "absent"]), "parent")


@query(
    "MON4_drift_monitor_trips",
    "SELECT *, CASE feature WHEN 'demand_validations' THEN 'demand_validations' ELSE 'weather_features' END AS parent FROM trip_verdicts",
)
def drift_monitor_trips(t):
    """Raw trips cover 30 days here: a side without values is insufficient data, not a stable one."""
    weather = calendar.weather_daily(t.readings)
    return _shown(drift.drift_monitor(demand.daily_total(t.raw), weather, ["temp_max_c", "temp_min_c", "precip_mm"]), "parent")


@query(
    "MON5_monitor_status",
    "SELECT CASE WHEN bool_or(status = 'drifted') THEN 'critical' WHEN bool_or(status = 'insufficient_data') THEN 'warning' ELSE 'ok' END AS global_status FROM trip_verdicts",
)
def monitor_status(t):
    daily = demand.daily_total(t.raw)
    weather = calendar.weather_daily(t.readings)
    rows = drift.drift_monitor(daily, weather, ["temp_max_c", "temp_min_c", "precip_mm"])
    return quality.monitor_status(quality.nested_status(rows, "parent"))


@query(
    "WIN8_distributed_running_total",
    "SELECT event_type, value, CAST(SUM(n) OVER (PARTITION BY event_type ORDER BY value) AS BIGINT) AS cum_n, CAST(SUM(n) OVER (PARTITION BY event_type) AS BIGINT) AS all_n "
    "FROM (SELECT event_type, value, COUNT(*) AS n FROM events GROUP BY ALL)",
)
def distributed_running_total(t):
    counted = t.events.groupBy("event_type", "value").agg(F.count("*").alias("n"))
    return running_totals(counted, ["event_type"], "value", ["n"]).drop("n")
