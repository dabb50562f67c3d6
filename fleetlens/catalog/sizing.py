"""Resource sizing."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.catalog.forecasting import BASE, FLOOR_SQL, forecast_sql
from fleetlens.catalog.registry import query
from fleetlens.catalog.sql import VIEWS, r6, view
from fleetlens.catalog.tables import Tables
from fleetlens.operators import sizing
from fleetlens.plans.predict_and_size import predict_and_size as plan
from fleetlens.schemas import BASIC_METRICS, HOST_METRICS, VALUE_RANGES

RESOURCES = ("cpu", "memory", "network")
OUT = ["model_id", *[f"{r}_allocation" for r in RESOURCES], "status", "solver_status", "objective_value", *[f"utilization_{r}" for r in RESOURCES]]


@query(
    "opt_demand",
    f"SELECT model_id, {', '.join(f'{r6(f'demand_{r}')} AS demand_{r}' for r in (*RESOURCES, 'latency'))} FROM demand",
)
def demand(t: Tables) -> DataFrame:
    value, event = F.col("value"), F.col("event_type")

    def only(kind: str, x: Column) -> Column:
        return F.when(event == kind, x)

    use = F.least(F.greatest(value / 50 * 10, F.lit(0.1)), F.lit(100.0))
    rows = t.events.select(
        "model_id",
        only("error", value).alias("cpu_usage"),
        only("view", use).alias("memory_usage"),
        only("purchase", use).alias("network_io"),
        only("signup", value / 50).alias("latency"),
    )
    return sizing.demand(rows)


view(
    "bounds_cost",
    "SELECT *, " + ", ".join(f"greatest(demand_{r} * 1.2, demand_{r} * demand_latency / max_latency) AS lb_{r}" for r in RESOURCES) + " FROM demand",
)
_fits = "lb_cpu <= max_cpu AND lb_memory <= max_memory AND lb_network <= max_network"


def _allocated(source: str, fits: str, best: Mapping[str, str], other: Mapping[str, str], objective: str) -> str:
    allocations = ", ".join(f"CASE WHEN {fits} THEN {best[r]} ELSE {other[r]} END AS {r}_allocation" for r in RESOURCES)
    used = ", ".join(
        f"{r6(f'CASE WHEN {r}_allocation > 0 THEN demand_{r} / {r}_allocation * 100 ELSE 0 END')} AS utilization_{r}" for r in RESOURCES
    )
    return f"""
    SELECT model_id, {', '.join(f'{r6(f'{r}_allocation')} AS {r}_allocation' for r in RESOURCES)},
           CASE WHEN fits THEN 'optimal' ELSE 'fallback' END AS status, CASE WHEN fits THEN 'Optimal' ELSE 'Infeasible' END AS solver_status,
           {r6(f'CASE WHEN fits THEN {objective} END')} AS objective_value, {used}
    FROM (SELECT *, ({fits}) AS fits, {allocations} FROM {source})"""


_plain = {r: f"CASE WHEN demand_{r} > 0 THEN greatest(0.1, demand_{r} * 1.2) ELSE 1.0 END" for r in RESOURCES}
_cost = "0.4 * cpu_allocation + 0.3 * memory_allocation + 0.3 * network_allocation"
COST_SQL = _allocated("bounds_cost", _fits, {r: f"lb_{r}" for r in RESOURCES}, _plain, _cost)


@query("opt_minimize_cost", COST_SQL)
def minimize_cost(t: Tables) -> DataFrame:
    return sizing.minimize_cost(t.demand).select(*OUT)


view(
    "bounds_share",
    """
    SELECT *, greatest(demand_cpu * 1.2 * f / max_cpu, 0.2) AS lc, greatest(demand_memory * 1.2 * f / max_memory, 0.2) AS lm,
           greatest(demand_network * 1.2 / max_network, 0.2) AS ln
    FROM (SELECT *, CASE WHEN least(demand_latency / max_latency, 1) > 0.8::DOUBLE
                         THEN 1 + (least(demand_latency / max_latency, 1) - 0.8::DOUBLE) * 2 ELSE 1 END AS f FROM demand)""",
)
view(
    "shares",
    """
    SELECT *, greatest(lc, lm - 0.2, ln - 0.4) AS uc, greatest(lm, lc - 0.2, ln - 0.2) AS um, greatest(ln, lm - 0.2, lc - 0.4) AS un
    FROM bounds_share""",
)
_share_fits = "uc <= 1 AND um <= 1 AND un <= 1"
_safe = {r: f"least(demand_{r} * 1.2, max_{r})" for r in RESOURCES}
_norm = "0.4 * cpu_allocation / max_cpu + 0.3 * memory_allocation / max_memory + 0.3 * network_allocation / max_network"


@query(
    "opt_maximize_performance",
    f"""
    SELECT 'plain' AS form, * FROM ({_allocated('bounds_cost', _fits, {r: f'max_{r}' for r in RESOURCES}, _plain, f'-({_cost})')})
    UNION ALL
    SELECT 'normalised', * FROM ({_allocated('shares', _share_fits, {r: f'max_{r}' for r in RESOURCES}, _safe, '-1.0')})""",
)
def maximize_performance(t: Tables) -> DataFrame:
    plain = sizing.maximize_performance(t.demand).select(F.lit("plain").alias("form"), *OUT)
    return plain.unionByName(sizing.performance_at_caps(t.demand).select(F.lit("normalised").alias("form"), *OUT))


_u = "greatest(lb_cpu / max_cpu, lb_memory / max_memory, lb_network / max_network)"


@query("opt_balance", _allocated("bounds_cost", f"{_u} <= 1", {r: f"{_u} * max_{r}" for r in RESOURCES}, _plain, "0.0"))
def balance(t: Tables) -> DataFrame:
    return sizing.balance(t.demand).select(*OUT)


@query(
    "opt_balanced_min_cost",
    _allocated("shares", _share_fits, {"cpu": "uc * max_cpu", "memory": "um * max_memory", "network": "un * max_network"}, _safe, _norm),
)
def balanced_min_cost(t: Tables) -> DataFrame:
    return sizing.balanced_min_cost(t.demand).select(*OUT)


@query(
    "opt_default_missing_metric",
    f"""
    SELECT model_id, {r6("CASE WHEN model_id = 'm1' THEN 60 ELSE demand_cpu END")} AS demand_cpu,
           {r6("CASE WHEN model_id = 'm2' THEN 50 ELSE demand_memory END")} AS demand_memory, {r6('demand_network')} AS demand_network,
           {r6("CASE WHEN model_id = 'm3' THEN 1 ELSE demand_latency END")} AS demand_latency
    FROM demand""",
)
def default_missing(t: Tables) -> DataFrame:
    """m1 lacks CPU (its limit is 120), m2 memory, m3 latency."""
    missing = {"demand_cpu": "m1", "demand_memory": "m2", "demand_latency": "m3"}
    rows = t.demand.withColumns({c: F.when(F.col("model_id") != m, F.col(c)) for c, m in missing.items()})
    filled = sizing.default_missing(rows.withColumn("max_cpu_usage", F.lit(120.0)))
    return filled.select("model_id", *[f"demand_{r}" for r in (*RESOURCES, "latency")])


@query(
    "opt_fallback",
    f"""
    SELECT model_id, 'lp' AS form, {', '.join(f'{r6(_plain[r])} AS {r}_allocation' for r in RESOURCES)} FROM demand
    UNION ALL SELECT model_id, 'analyzer', {', '.join(r6(_safe[r]) for r in RESOURCES)} FROM demand
    UNION ALL SELECT model_id, 'error', 200.0, 50.0, 50.0 FROM demand""",
)
def fallback(t: Tables) -> DataFrame:
    """A latency far above its limit makes every model infeasible."""
    hopeless = t.demand.withColumns({f"max_{r}": F.col(f"max_{r}") for r in RESOURCES}).withColumn("max_latency", F.lit(1e-6))
    keep = ["model_id", "form", *[f"{r}_allocation" for r in RESOURCES]]
    a = sizing.minimize_cost(hopeless).withColumn("form", F.lit("lp"))
    b = sizing.balanced_min_cost(t.demand, margin=1.2, min_utilization=200.0).withColumn("form", F.lit("analyzer"))
    c = sizing.error_fallback(t.demand).withColumn("form", F.lit("error"))
    return a.select(*keep).unionByName(b.select(*keep)).unionByName(c.select(*keep))


def _band(r: str) -> str:
    u = f"(CASE WHEN {r}_allocation > 0 THEN demand_{r} / {r}_allocation * 100 ELSE 0 END)"
    return f"CASE WHEN {u} < 20 THEN 'below' WHEN {u} > 90 THEN 'above' ELSE 'ok' END AS band_{r}"


@query(
    "opt_validate_solution",
    f"""
    SELECT model_id, true AS valid, {', '.join(f'{r}_allocation < demand_{r} AS short_{r}' for r in RESOURCES)},
           {', '.join(_band(r) for r in RESOURCES)}
    FROM (SELECT *, {', '.join(f'CASE WHEN {_share_fits} THEN {b} ELSE {_safe[r]} END AS {r}_allocation'
                               for r, b in (('cpu', 'uc * max_cpu'), ('memory', 'um * max_memory'), ('network', 'un * max_network')))} FROM shares)""",
)
def validate(t: Tables) -> DataFrame:
    checked = sizing.validate(sizing.balanced_min_cost(t.demand))
    return checked.select("model_id", "valid", *[f"short_{r}" for r in RESOURCES], *[f"band_{r}" for r in RESOURCES])


NAMES = (*BASIC_METRICS, *HOST_METRICS)
LIMITS = {"max_cpu": 400.0, "max_memory": 100.0, "max_network": 100.0, "max_latency": 100.0}
_held = "CASE metric_name " + " ".join(f"WHEN '{m}' THEN least(greatest(v, {lo}::DOUBLE), {hi}::DOUBLE)" for m, (lo, hi) in VALUE_RANGES.items()) + " ELSE v END"
view(
    "sized_rows",
    f"""
    SELECT model_id, metric_name, timestamp, {_held} AS value
    FROM (SELECT model_id, metric_name, timestamp, avg(value) AS v FROM metrics WHERE metric_name IN ({', '.join(f"'{m}'" for m in NAMES)}) GROUP BY ALL)""",
)
view("sized_timed", VIEWS["timed"].replace("hourly", "sized_rows"))
view(
    "sized_ahead",
    f"""
    SELECT model_id, metric_name, timestamp, yhat FROM ({forecast_sql('sized_timed', BASE)})
    UNION ALL
    SELECT model_id, metric_name, last_time + to_minutes(5 * p), mean
    FROM (SELECT model_id, metric_name, max(timestamp) AS last_time, avg(value) AS mean FROM sized_rows GROUP BY ALL HAVING count(value) < 8),
         (SELECT unnest(range(6))::INTEGER AS p)""",
)
view(
    "sized_wide",
    f"""
    SELECT model_id, timestamp, {', '.join(f"max(y) FILTER (metric_name = '{m}') AS {m}" for m in NAMES)}
    FROM (SELECT a.model_id, a.metric_name, timestamp, coalesce(newest, greatest(yhat, {FLOOR_SQL.replace('CASE ', 'CASE a.', 1)})) AS y
          FROM (SELECT * FROM sized_ahead) a LEFT JOIN (
              SELECT model_id, metric_name, arg_max(value, timestamp) AS newest FROM sized_rows
              WHERE metric_name IN ({', '.join(f"'{m}'" for m in HOST_METRICS)}) AND value IS NOT NULL GROUP BY ALL) n
          ON a.model_id = n.model_id AND a.metric_name = n.metric_name)
    GROUP BY model_id, timestamp""",
)


def _used(host: str, derived: str) -> str:
    return f"CASE WHEN count({host}) OVER m > 0 THEN {host} ELSE {derived} END"


view(
    "sized_demand",
    f"""
    SELECT model_id, coalesce(max(cpu), 50) AS demand_cpu, coalesce(max(memory), 50) AS demand_memory, coalesce(max(network), 50) AS demand_network,
           coalesce(max(latency_p99), 1) AS demand_latency, {', '.join(f'{v}::DOUBLE AS {k}' for k, v in LIMITS.items())}
    FROM (SELECT model_id, latency_p99,
                 {_used('cpu_usage_real', 'CASE WHEN max(requests_total) OVER m > 0 THEN least(greatest(requests_total / max(requests_total) OVER m * 80, 0), 100) ELSE 10 END')} AS cpu,
                 {_used('memory_usage_real', 'least(greatest(latency_avg * 10, 0.1), 100)')} AS memory,
                 {_used('network_io_real', 'least(greatest(latency_p95 * 10, 0.1), 100)')} AS network
          FROM sized_wide WINDOW m AS (PARTITION BY model_id))
    GROUP BY model_id""",
)
view("sized_bounds", VIEWS["bounds_cost"].replace("FROM demand", "FROM sized_demand"))
_rounded = [c for c in OUT if c not in ("model_id", "status", "solver_status")]


@query(
    "predict_and_size",
    f"""
    SELECT model_id, status, solver_status, {', '.join(f'round({c}, 4) AS {c}' for c in _rounded)}
    FROM ({COST_SQL.replace('bounds_cost', 'sized_bounds')})""",
)
def predict_and_size(t: Tables) -> DataFrame:
    """Fit, forecast, override with host readings, size; one row per model. To four decimals, as the twin solves in another order."""
    sized = plan(t.metrics, names=NAMES, limits=LIMITS).select(*OUT)
    return sized.withColumns({c: F.round(c, 4) for c in _rounded})
