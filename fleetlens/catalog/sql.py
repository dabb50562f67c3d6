"""SQL views the oracle twins share, written for DuckDB and independent of the Spark code."""

from __future__ import annotations

import re

VIEWS = {
    "ev": """
        SELECT event_id, ts, user_id, event_type, value, props,
               'm' || (user_id % 8) AS model_id, 'i' || (user_id % 3) AS instance,
               'c' || (user_id % 2) AS cpu, 'eth' || (user_id % 2) AS device,
               CAST(round(value * 100) AS BIGINT) AS cents, date_trunc('hour', ts) AS hr
        FROM events""",
    "metrics": """
        SELECT event_id, hr AS timestamp, value, model_id, instance,
               CASE event_type WHEN 'click' THEN 'requests_total' WHEN 'view' THEN 'latency_avg'
                    WHEN 'purchase' THEN 'latency_p95' WHEN 'signup' THEN 'latency_p99'
                    WHEN 'error' THEN 'cpu_usage_real' END AS metric_name
        FROM ev""",
    "gaps": """
        SELECT event_id, timestamp, CASE WHEN event_id % 7 <> 0 THEN value END AS value,
               model_id, instance, metric_name
        FROM metrics""",
    "hourly": """
        SELECT model_id, metric_name, timestamp, avg(value) AS value
        FROM gaps GROUP BY ALL""",
    "wide": """
        SELECT model_id, timestamp,
               avg(value) FILTER (metric_name = 'requests_total') AS requests_total,
               avg(value) FILTER (metric_name = 'latency_avg') AS latency_avg,
               avg(value) FILTER (metric_name = 'latency_p95') AS latency_p95,
               avg(value) FILTER (metric_name = 'latency_p99') AS latency_p99
        FROM gaps GROUP BY ALL""",
    "logs": """
        SELECT event_id, ts AS timestamp, model_id, instance, value / 50.0 AS latency,
               CASE WHEN user_id % 5 = 0 THEN '/health' ELSE '/predict' END AS endpoint,
               CASE WHEN event_type = 'error' THEN 'prediction failed' END AS error,
               CASE WHEN event_type <> 'error' THEN 200 WHEN event_id % 2 = 0 THEN 404 ELSE 500 END AS status_code,
               CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_type = 'error' THEN 'error'
                    WHEN value / 50.0 > 1 THEN 'WARNING' ELSE 'INFO' END AS level,
               props AS context,
               CASE WHEN event_id % 5 <> 0 THEN 'Completed request of ' || model_id END AS message
        FROM ev""",
    "counted": """
        SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY ts, event_id) AS n FROM ev""",
    "counts": """
        SELECT model_id, ts, event_id AS id, CAST(n % 50 AS DOUBLE) AS value FROM counted""",
    "sums": """
        SELECT model_id, ts, event_id AS id,
               sum(cents) OVER (PARTITION BY model_id, n // 50 ORDER BY n)::DOUBLE / 5000.0 AS value
        FROM counted""",
    "errors": """
        SELECT model_id, instance, ts, event_id AS id,
               sum(CASE WHEN event_type = 'error' THEN user_id % 7 + 1 ELSE 0 END)
                   OVER (PARTITION BY model_id, instance ORDER BY ts, event_id)::DOUBLE AS value
        FROM ev""",
    "idle": """
        SELECT instance, cpu, ts, event_id AS id,
               sum(cents) OVER (PARTITION BY instance, cpu ORDER BY ts, event_id)::DOUBLE / 10000.0 AS value
        FROM ev""",
    "received": """
        SELECT instance, device, ts, event_id AS id,
               sum(cents * 100) OVER (PARTITION BY instance, device ORDER BY ts, event_id)::DOUBLE AS value
        FROM ev""",
    "sent": """
        SELECT instance, device, ts, event_id AS id,
               sum(cents * 50) OVER (PARTITION BY instance, device ORDER BY ts, event_id)::DOUBLE AS value
        FROM ev""",
    "bounds": """
        SELECT unnest([0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0,
                       'Infinity'::DOUBLE]) AS le""",
    "histogram": """
        SELECT model_id, date_trunc('hour', timestamp) AS ts, le, count(*) FILTER (latency <= le) AS n,
               sum(latency) AS total, count(*) AS cnt
        FROM logs, bounds GROUP BY ALL""",
    "buckets": """
        SELECT model_id, le, ts, 0 AS id,
               sum(n) OVER (PARTITION BY model_id, le ORDER BY ts)::DOUBLE AS value
        FROM histogram""",
    "snapshots": """
        SELECT model_id, instance, hr AS ts, least(sum(cents) / (count(*) * 100.0::DOUBLE), 100.0) AS cpu_percent,
               least(max(value) / 3, 100.0) AS memory_percent, sum(cents) / (count(*) * 100.0::DOUBLE) * 3e7 AS memory_bytes,
               (sum(sum(cents)) OVER (PARTITION BY model_id, instance ORDER BY hr) * 10)::DOUBLE AS read_bytes,
               (sum(count(*)) OVER (PARTITION BY model_id, instance ORDER BY hr) * 500)::DOUBLE AS write_bytes
        FROM ev GROUP BY model_id, instance, hr""",
    "hosts": """
        SELECT instance, hr AS ts, least(sum(cents) / (count(*) * 100.0::DOUBLE) * 1.5, 100.0) AS cpu_percent,
               least(max(value) / 2, 100.0) AS memory_percent, least(min(value) * 4, 100.0) AS disk_percent
        FROM ev GROUP BY instance, hr""",
    "checks": """
        SELECT model_id, ts, event_id AS id, event_type <> 'error' AS ok FROM ev""",
    "accuracy": """
        SELECT model_id, date_trunc('day', ts)::TIMESTAMP AS ts,
               avg(CASE WHEN event_type <> 'error' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS accuracy
        FROM ev GROUP BY ALL""",
    "registry": """
        SELECT model_id, substr(model_id, 2)::INTEGER AS number, 8 AS feature_count, count(*) AS prediction_count,
               avg(value) / 50 AS avg_latency, max(ts) AS last_prediction,
               CASE WHEN substr(model_id, 2)::INTEGER % 3 <> 2 THEN 'running' ELSE 'stopped' END AS status
        FROM ev GROUP BY model_id""",
    "services": """
        SELECT DISTINCT 'm' || (user_id % 10) AS model_id,
               CASE WHEN user_id % 10 % 2 = 0 THEN 'running' ELSE 'unknown' END AS service_status,
               'http://localhost:' || (user_id % 10 + 8000) AS url, (user_id % 10 + 8000)::INTEGER AS port
        FROM events""",
    "docs": """
        SELECT model_id, ts::DATE AS d, date_trunc('second', max(ts)) AS timestamp, max(value) AS cpu_allocation,
               avg(value) AS memory_allocation, count(*) AS n
        FROM ev GROUP BY model_id, ts::DATE""",
    "demand": """
        SELECT model_id, max(value) FILTER (event_type = 'error') AS demand_cpu,
               max(least(greatest(value / 50 * 10, 0.1), 100.0)) FILTER (event_type = 'view') AS demand_memory,
               max(least(greatest(value / 50 * 10, 0.1), 100.0)) FILTER (event_type = 'purchase') AS demand_network,
               max(value / 50) FILTER (event_type = 'signup') AS demand_latency,
               400.0::DOUBLE AS max_cpu, 100.0::DOUBLE AS max_memory, 100.0::DOUBLE AS max_network,
               8.0::DOUBLE AS max_latency
        FROM ev GROUP BY model_id""",
}


def view(name: str, sql: str) -> None:
    """Add a view for the twins of one section."""
    if name in VIEWS:
        raise ValueError(f"view {name} is defined twice")
    VIEWS[name] = sql


def expand(sql: str) -> str:
    """Put the views a statement uses in front of it."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in needed and re.search(rf"\b(FROM|JOIN|,)\s*\(?{name}\b", text):
                visit(VIEWS[name])
                if name not in needed:
                    needed.append(name)

    visit(sql)
    parts = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in needed)
    if not parts:
        return sql
    own = sql.lstrip()
    return f"WITH {parts},\n{own[5:]}" if own.startswith("WITH ") else f"WITH {parts}\n{sql}"


def r6(x: str) -> str:
    """Double to six decimals (see registry.present)."""
    return f"round(({x})::DOUBLE + sign(({x})::DOUBLE) * 1e-9::DOUBLE, 6)"


def text(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%d %H:%M:%S.%f')"


def seconds(ts: str) -> str:
    """Time as operators show it, without the fraction."""
    return f"strftime({ts}, '%Y-%m-%d %H:%M:%S')"


def at(epoch: str) -> str:
    """Epoch seconds as text."""
    return f"strftime(make_timestamp(({epoch})::BIGINT * 1000000), '%Y-%m-%d %H:%M:%S.%f')"


def evaluations(step: int, range_seconds: int) -> str:
    """Evaluation times (seconds) whose range holds a sample."""
    first = f"(epoch_us(ts) // 1000000 // {step} + 1) * {step}"
    return f"unnest(range({first}, {first} + {range_seconds}, {step}))"


def ranges(source: str, keys: str, range_seconds: int = 300, step: int = 15) -> str:
    """Growth, sample count and elapsed seconds of a counter per key and evaluation ``e``."""
    return f"""(
        SELECT {keys}, e, count(*) AS n, (max(us) - min(us)) / 1e6 AS elapsed,
               sum(CASE WHEN prev_us >= (e - {range_seconds}) * 1000000
                        THEN CASE WHEN value < prev THEN value ELSE value - prev END ELSE 0 END) AS growth
        FROM (SELECT *, {evaluations(step, range_seconds)} AS e
              FROM (SELECT *, epoch_us(ts) AS us, lag(value) OVER w AS prev, lag(epoch_us(ts)) OVER w AS prev_us
                    FROM {source} WINDOW w AS (PARTITION BY {keys} ORDER BY ts, id)))
        GROUP BY {keys}, e)"""


def rate(source: str, keys: str, range_seconds: int = 300, step: int = 15) -> str:
    return f"""(SELECT {keys}, e, growth / elapsed AS value
        FROM {ranges(source, keys, range_seconds, step)} WHERE n >= 2 AND elapsed > 0)"""


def instant(source: str, keys: str, lookback: int = 300, step: int = 15) -> str:
    return f"""(SELECT {keys}, e, arg_max(value, (epoch_us(ts), id)) AS value
        FROM (SELECT *, {evaluations(step, lookback)} AS e FROM {source}) GROUP BY {keys}, e)"""


def hold(source: str, keys: str, seconds: int, step: int) -> str:
    """Runs of consecutive evaluations: ``since`` and whether the run has held long enough."""
    return f"""(
        SELECT *, CASE WHEN e - since >= {seconds} THEN 'firing' ELSE 'pending' END AS state
        FROM (SELECT *, min(e) OVER (PARTITION BY {keys}, run) AS since
              FROM (SELECT *, sum(fresh) OVER (PARTITION BY {keys} ORDER BY e) AS run
                    FROM (SELECT *, CASE WHEN e - lag(e) OVER (PARTITION BY {keys} ORDER BY e) = {step} THEN 0 ELSE 1 END AS fresh
                          FROM {source}))))"""
