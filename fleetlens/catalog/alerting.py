"""Alerts: thresholds, held conditions, grouping, repetition, inhibition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.catalog.joining import SYSTEM_SQL
from fleetlens.catalog.registry import query
from fleetlens.catalog.sql import at, hold, instant, r6, ranges, rate, text, view
from fleetlens.catalog.tables import Tables
from fleetlens.functions.scalars import moment
from fleetlens.operators import alerts, notify, tsexpr
from fleetlens.plans.active_alerts import active_alerts
from fleetlens.schemas import DESCRIPTIONS, RULE_ERROR_SPIKE, RULE_HIGH_LATENCY, RULES_HOST, RULES_MODEL, SUMMARIES

LOG_KEYS = ["event_id", "model_id", "timestamp"]

view(
    "slow",
    """
    SELECT event_id, model_id, timestamp, 'latency' AS type, latency AS value,
           CASE WHEN latency > 5 THEN 'CRITICAL' ELSE 'WARNING' END AS level,
           CASE WHEN latency > 5 THEN 5.0::DOUBLE ELSE 1.0::DOUBLE END AS threshold
    FROM logs WHERE latency > 1""",
)


@query(
    "alr_latency",
    f"""
    SELECT event_id, model_id, {text('timestamp')} AS timestamp, type, level, {r6('value')} AS value, threshold,
           'Model ' || model_id || ' latency (' || value || 's) exceeds ' || CASE level WHEN 'CRITICAL' THEN 'critical' ELSE 'warning' END
           || ' threshold (' || threshold || 's)' AS message
    FROM slow""",
)
def latency(t: Tables) -> DataFrame:
    return alerts.latency_alerts(t.logs, LOG_KEYS)


@query(
    "alr_error_rate",
    f"""
    SELECT event_id, model_id, 'error_rate' AS type, 'CRITICAL' AS level, {r6('r')} AS value, 0.05::DOUBLE AS threshold,
           'Model ' || model_id || ' error rate (' || printf('%.2f', r * 100) || '%) exceeds threshold (5.00%)' AS message
    FROM (SELECT *, avg(CASE WHEN error IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END)
                 OVER (PARTITION BY model_id ORDER BY timestamp, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS r FROM logs)
    WHERE r > 0.05""",
)
def error_rate(t: Tables) -> DataFrame:
    return alerts.error_rate_alerts(t.logs, ["event_id", "model_id"])


@query(
    "alr_resource",
    f"""
    SELECT model_id, instance, {text('ts')} AS ts, 'cpu_usage' AS type, 'WARNING' AS level, {r6('cpu_percent')} AS value, 80.0::DOUBLE AS threshold,
           'Model ' || model_id || ' CPU usage (' || printf('%.1f', cpu_percent) || '%) exceeds threshold (80.0%)' AS message
    FROM snapshots WHERE cpu_percent > 80
    UNION ALL
    SELECT model_id, instance, {text('ts')}, 'memory_usage', 'WARNING', {r6('memory_percent')}, 85.0,
           'Model ' || model_id || ' memory usage (' || printf('%.1f', memory_percent) || '%) exceeds threshold (85.0%)'
    FROM snapshots WHERE memory_percent > 85""",
)
def resource(t: Tables) -> DataFrame:
    return alerts.resource_alerts(t.snapshots, ["model_id", "instance", "ts"])


@query(
    "alr_accuracy",
    f"""
    SELECT model_id, {text('ts')} AS ts, 'accuracy' AS type, {r6('accuracy')} AS value, 0.9::DOUBLE AS threshold,
           'Model ' || model_id || ' accuracy (' || printf('%.2f', accuracy * 100) || '%) below minimum threshold (90.00%)' AS message
    FROM accuracy WHERE accuracy < 0.9
    UNION ALL
    SELECT model_id, {text('ts')}, 'accuracy_drop', {r6('prev - accuracy')}, 0.05,
           'Model ' || model_id || ' accuracy dropped by ' || printf('%.2f', (prev - accuracy) * 100) || '%'
    FROM (SELECT *, lag(accuracy) OVER (PARTITION BY model_id ORDER BY ts) AS prev FROM accuracy) WHERE prev - accuracy > 0.05""",
)
def accuracy(t: Tables) -> DataFrame:
    return alerts.accuracy_alerts(t.accuracy, ["model_id", "ts"]).drop("level")


@query("alr_system", SYSTEM_SQL)
def system(t: Tables) -> DataFrame:
    """Once per breach and model on the host."""
    return alerts.for_models(alerts.system_alerts(t.snapshots, t.hosts), t.snapshots)


@query(
    "alr_expire_30m",
    f"""
    SELECT event_id, model_id, {text('timestamp')} AS timestamp, level
    FROM slow WHERE timestamp > TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 30 MINUTES""",
)
def expire(t: Tables) -> DataFrame:
    found = alerts.latency_alerts(t.logs, LOG_KEYS)
    return alerts.young_alerts(found, moment("2024-01-30 12:00:00")).select(*LOG_KEYS, "level")


def _active(columns: str, kind: str, name: str, head: str, value: str, limit: float, source: str) -> str:
    return f"""SELECT '{name}' AS name, '{kind}' AS type, 'WARNING' AS level,
        {head} || ' usage (' || printf('%.1f', {value}) || '%) exceeds threshold ({limit}%)' AS message,
        {r6(value)} AS value, {limit}::DOUBLE AS threshold, true AS active, {columns}, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS since
        FROM {source} WHERE {value} > {limit} AND ts > TIMESTAMP '2024-01-30 12:15:00' - INTERVAL 30 MINUTES"""


_recent = "(SELECT DISTINCT model_id, instance FROM snapshots WHERE ts > TIMESTAMP '2024-01-30 12:15:00' - INTERVAL 30 MINUTES) m JOIN hosts USING (instance)"


@query(
    "active_alerts",
    " UNION ALL ".join(
        [
            _active("model_id", "cpu_usage", "Cpu Usage", "'Model ' || model_id || ' CPU'", "cpu_percent", 80.0, "snapshots"),
            _active("model_id", "memory_usage", "Memory Usage", "'Model ' || model_id || ' memory'", "memory_percent", 85.0, "snapshots"),
            _active("model_id", "system_cpu_usage", "System CPU Usage", "'System CPU'", "cpu_percent", 80.0, _recent),
            _active("model_id", "system_memory_usage", "System Memory Usage", "'System Memory'", "memory_percent", 85.0, _recent),
            _active("model_id", "system_disk_usage", "System Disk Usage", "'System Disk'", "disk_percent", 90.0, _recent),
        ]
    ),
)
def active(t: Tables) -> DataFrame:
    """What is active at a quarter past noon of the last day."""
    return active_alerts(t.snapshots, t.hosts, "2024-01-30 12:15:00")


@query("alr_level_counts", "SELECT level, count(*) AS n FROM slow GROUP BY level")
def level_counts(t: Tables) -> DataFrame:
    return alerts.level_counts(alerts.latency_alerts(t.logs, LOG_KEYS))


def ratio_sql(range_seconds: int, step: int) -> str:
    return f"""(SELECT model_id, e, s.value / c.value AS value
        FROM {rate('sums', 'model_id', range_seconds, step)} s JOIN {rate('counts', 'model_id', range_seconds, step)} c USING (model_id, e)
        WHERE c.value <> 0)"""


view("slow_evals", f"SELECT model_id, e, value FROM {ratio_sql(300, 15)} WHERE value > 1")


@query(
    "alr_rule_high_latency",
    f"""
    SELECT 'HighLatency' AS alertname, 'warning' AS severity, model_id, {at('e')} AS ts, {at('since')} AS since, state
    FROM {hold('slow_evals', 'model_id', 120, 15)}""",
)
def rule_high_latency(t: Tables) -> DataFrame:
    name, severity, limit, held = RULE_HIGH_LATENCY
    above = tsexpr.latency_avg(t.latency, ["model_id"]).where(F.col("value") > limit)
    states = alerts.hold(above, ["model_id"], held)
    return states.select(F.lit(name).alias("alertname"), F.lit(severity).alias("severity"), "model_id", "ts", "since", "state")


view(
    "error_evals",
    f"""
    SELECT model_id, e FROM (SELECT model_id, e, sum(growth) AS value FROM {ranges('errors', 'model_id, instance')} WHERE n >= 2 GROUP BY model_id, e)
    WHERE value > 3""",
)


@query(
    "alr_rule_error_spike",
    f"""
    SELECT 'PredictionErrorSpike' AS alertname, 'critical' AS severity, model_id, {at('e')} AS ts, {at('since')} AS since, state
    FROM {hold('error_evals', 'model_id', 60, 15)}""",
)
def rule_error_spike(t: Tables) -> DataFrame:
    name, severity, limit, held = RULE_ERROR_SPIKE
    grown = tsexpr.agg_by_label(tsexpr.increase(t.errors, ["model_id", "instance"]), ["model_id"], "sum")
    states = alerts.hold(grown.where(F.col("value") > limit), ["model_id"], held)
    return states.select(F.lit(name).alias("alertname"), F.lit(severity).alias("severity"), "model_id", "ts", "since", "state")


# Gauges are read hourly here, so they are looked up over an hour, every five minutes.
LOOKBACK, STEP = 3600, 300


def _model_gauges(t: Tables) -> DataFrame:
    keys = ["model_id", "instance"]

    def named(name: str, df: DataFrame) -> DataFrame:
        return df.select(F.lit(name).alias("name"), *keys, "ts", F.lit(0).alias("id"), "value")

    snapshots = t.snapshots
    samples = (
        named("cpu_usage_percent", snapshots.withColumn("value", F.col("cpu_percent")))
        .unionByName(named("memory_gigabytes", snapshots.withColumn("value", F.col("memory_bytes") / 1e9)))
        .unionByName(named("network_bytes_per_second", tsexpr.io_rate(snapshots).withColumn("value", F.col("value") * 4e6)))
    )
    return tsexpr.instant(samples, ["name", *keys], LOOKBACK, STEP)


view(
    "model_gauges",
    """
    SELECT 'ModelHighCPUUsage' AS alertname, 75.0::DOUBLE AS lim, model_id, instance, ts, 0 AS id, cpu_percent AS value FROM snapshots
    UNION ALL SELECT 'ModelHighMemoryUsage', 1.5, model_id, instance, ts, 0, memory_bytes / 1e9 FROM snapshots
    UNION ALL SELECT 'ModelHighNetworkTraffic', 5e7, model_id, instance, ts, 0,
           (read_bytes - pr + write_bytes - pw) / ((epoch_us(ts) - epoch_us(pt)) / 1e6) * 4e6
    FROM (SELECT *, lag(ts) OVER w AS pt, lag(read_bytes) OVER w AS pr, lag(write_bytes) OVER w AS pw
          FROM snapshots WINDOW w AS (PARTITION BY model_id, instance ORDER BY ts)) WHERE pt IS NOT NULL""",
)
view(
    "model_conditions",
    f"SELECT alertname, model_id, instance, e FROM {instant('model_gauges', 'alertname, lim, model_id, instance', LOOKBACK, STEP)} WHERE value > lim",
)


def _intervals(keys: str, source: str, seconds: int) -> str:
    return f"""
    SELECT {keys}, {at('since')} AS since, {at("min(e) FILTER (state = 'firing')")} AS firing_from, {at('max(e)')} AS until, count(*) AS evaluations
    FROM {hold(source, keys, seconds, STEP)} GROUP BY {keys}, since"""


@query("alr_rule_model_resources", _intervals("alertname, model_id, instance", "model_conditions", 300))
def rule_model_resources(t: Tables) -> DataFrame:
    keys = ["alertname", "model_id", "instance"]
    above = alerts.gauge_conditions(_model_gauges(t), RULES_MODEL)
    return alerts.intervals(alerts.hold(above, keys, F.col("hold"), step=STEP), keys)


view(
    "host_values",
    f"""
    SELECT 'HighCPUUsage' AS alertname, instance, '' AS mountpoint, e, 100 - avg(value) * 100 AS value, 80.0::DOUBLE AS lim
    FROM {rate('idle', 'instance, cpu', LOOKBACK, STEP)} GROUP BY instance, e
    UNION ALL
    SELECT 'HighMemoryUsage', instance, '', e, (1 - value / 1e10) * 100, 85.0 FROM {instant('available', 'instance', LOOKBACK, STEP)}
    UNION ALL
    SELECT 'HighDiskUsage', instance, mountpoint, e, (5e11 - value) * 100 / 5e11, 85.0 FROM {instant('disk_free', 'instance, mountpoint', LOOKBACK, STEP)}
    UNION ALL
    SELECT 'HighNetworkTraffic', instance, '', e, sum(a.value + b.value) * 1e6, 1e8
    FROM {rate('received', 'instance, device', LOOKBACK, STEP)} a JOIN {rate('sent', 'instance, device', LOOKBACK, STEP)} b
    USING (instance, device, e) GROUP BY instance, e""",
)
MOUNTS = {"/data": 1.0, "/var": 0.95}  # the share of the reading that each mount point shows
view(
    "disk_free",
    " UNION ALL ".join(f"SELECT instance, '{m}' AS mountpoint, ts, 0 AS id, (100 - disk_percent * {x}::DOUBLE) * 5e9 AS value FROM hosts" for m, x in MOUNTS.items()),
)
view("host_conditions", "SELECT alertname, instance, mountpoint, e FROM host_values WHERE value > lim")


@query("alr_rule_host_resources", _intervals("alertname, instance, mountpoint", "host_conditions", 300))
def rule_host_resources(t: Tables) -> DataFrame:
    """Disks are judged per mount point; each host has two."""

    def gauge(value: Column, *labels: Column) -> DataFrame:
        keys = ["instance", *(["mountpoint"] if labels else [])]
        return tsexpr.instant(t.host_gauge(value, *labels), keys, LOOKBACK, STEP)

    memory = tsexpr.memory_percent(gauge((F.lit(100.0) - F.col("memory_percent")) * 1e8), gauge(F.lit(1e10)))
    disk = None
    for path, share in MOUNTS.items():
        mount = F.lit(path).alias("mountpoint")
        part = tsexpr.disk_percent(gauge((F.lit(100.0) - F.col("disk_percent") * share) * 5e9, mount), gauge(F.lit(5e11), mount))
        disk = part if disk is None else disk.unionByName(part)
    network = tsexpr.network_bytes(t.network, ["instance"], LOOKBACK, STEP).withColumn("value", F.col("value") * 1e6)
    frames = {
        "cpu_percent": tsexpr.cpu_percent(t.idle, LOOKBACK, STEP),
        "memory_percent": memory,
        "disk_percent": disk,
        "network_bytes_per_second": network,
    }
    rows = None
    for name, frame in frames.items():
        mount = F.col("mountpoint") if "mountpoint" in frame.columns else F.lit("")
        part = frame.select(F.lit(name).alias("name"), "instance", mount.alias("mountpoint"), "ts", "value")
        rows = part if rows is None else rows.unionByName(part)
    keys = ["alertname", "instance", "mountpoint"]
    return alerts.intervals(alerts.hold(alerts.gauge_conditions(rows, RULES_HOST), keys, F.col("hold"), step=STEP), keys)


# Held conditions on a coarser grid, where runs are long.
WIDE, GRID = 3600, 900
view("lat", f"SELECT model_id, e, value FROM {ratio_sql(WIDE, GRID)}")
view("lat_high", "SELECT model_id, e FROM lat WHERE value > 1")
view(
    "err_high",
    f"""
    SELECT model_id, e FROM (SELECT model_id, e, sum(growth) AS value FROM {ranges('errors', 'model_id, instance', WIDE, GRID)}
                             WHERE n >= 2 GROUP BY model_id, e) WHERE value > 3""",
)


def _held(t: Tables) -> DataFrame:
    above = tsexpr.latency_avg(t.latency, ["model_id"], WIDE, GRID).where("value > 1.0")
    return alerts.hold(above, ["model_id"], 1800, step=GRID)


@query(
    "alr_for_duration",
    f"SELECT model_id, {at('e')} AS ts, {at('since')} AS since, state FROM {hold('lat_high', 'model_id', 1800, GRID)}",
)
def for_duration(t: Tables) -> DataFrame:
    return _held(t).select("model_id", "ts", "since", "state")


@query(
    "alr_render_labels",
    f"""
    SELECT alertname, model_id, instance, {text('ts')} AS ts, summary,
           replace(replace(replace(template, '{{model_id}}', model_id), '{{instance}}', instance), '{{mountpoint}}', '/data') AS description
    FROM snapshots, (VALUES {', '.join(f"('{name}', '{SUMMARIES[name]}', '{template}')" for name, template in DESCRIPTIONS.items())}) AS r(alertname, summary, template)
    WHERE cpu_percent > 75""",
)
def render_labels(t: Tables) -> DataFrame:
    """Every rule's texts for the same readings."""
    rows = t.snapshots.where("cpu_percent > 75").withColumns(
        {"alertname": F.explode(F.array(*[F.lit(name) for name in DESCRIPTIONS])), "mountpoint": F.lit("/data")}
    )
    return alerts.render(rows).select("alertname", "model_id", "instance", "ts", "summary", "description")


view(
    "firing",
    f"""
    SELECT 'HighLatency' AS alertname, model_id, e FROM {hold('lat_high', 'model_id', 1800, GRID)} WHERE state = 'firing'
    UNION ALL
    SELECT 'PredictionErrorSpike', model_id, e FROM {hold('err_high', 'model_id', 900, GRID)} WHERE state = 'firing'""",
)
view(
    "firing_groups",
    f"""
    SELECT alertname, e, count(*) AS alerts, sum(fresh)::BIGINT AS new_alerts
    FROM (SELECT *, CASE WHEN e - lag(e) OVER (PARTITION BY alertname, model_id ORDER BY e) = {GRID} THEN 0 ELSE 1 END AS fresh FROM firing)
    GROUP BY alertname, e""",
)


def _firing(t: Tables) -> DataFrame:
    grown = tsexpr.agg_by_label(tsexpr.increase(t.errors, ["model_id", "instance"], WIDE, GRID), ["model_id"], "sum")
    spikes = alerts.hold(grown.where("value > 3"), ["model_id"], 900, step=GRID)
    firing = None
    for name, states in (("HighLatency", _held(t)), ("PredictionErrorSpike", spikes)):
        part = states.where("state = 'firing'").select(F.lit(name).alias("alertname"), "model_id", "ts")
        firing = part if firing is None else firing.unionByName(part)
    return firing


def _groups(t: Tables) -> DataFrame:
    return alerts.group(alerts.mark_new(_firing(t), ["alertname", "model_id"], step=GRID))


@query("alr_group", f"SELECT alertname, {at('e')} AS ts, alerts, new_alerts FROM firing_groups")
def group(t: Tables) -> DataFrame:
    return _groups(t)


#: Evaluations end with the first one after the last event.
STOPPED = f"(SELECT (max(epoch_us(ts)) // 1000000 // {GRID} + 1) * {GRID} FROM ev)"
view(
    "alert_spans",
    f"""
    SELECT alertname, model_id, min(e) AS starts, CASE WHEN max(e) + {GRID} > {STOPPED} THEN max(e) + 300 ELSE max(e) + {GRID} END AS ends
    FROM (SELECT *, sum(fresh) OVER (PARTITION BY alertname, model_id ORDER BY e) AS run
          FROM (SELECT *, CASE WHEN e - lag(e) OVER (PARTITION BY alertname, model_id ORDER BY e) = {GRID} THEN 0 ELSE 1 END AS fresh
                FROM firing WHERE e <= {STOPPED}))
    GROUP BY alertname, model_id, run""",
)
# Changes lie 300 seconds apart at least, so a group is gone whenever nothing fires, and each change has a flush of its own.
view(
    "group_changes",
    """
    SELECT *, sum(CASE WHEN alerts - started + ended = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY alertname ORDER BY at_) AS life
    FROM (SELECT *, sum(started - ended) OVER (PARTITION BY alertname ORDER BY at_)::BIGINT AS alerts
          FROM (SELECT alertname, at_, count(*) FILTER (d = 1) AS started, count(*) FILTER (d = -1) AS ended
                FROM (SELECT alertname, starts AS at_, 1 AS d FROM alert_spans UNION ALL SELECT alertname, ends, -1 FROM alert_spans) GROUP BY ALL))
    WHERE started + ended > 0""",
)
view(
    "group_flushes",
    """
    SELECT *, CASE WHEN at_ = began THEN began + 10 ELSE began + 10 + ((at_ - began - 10) // 10 + 1) * 10 END AS flush
    FROM (SELECT *, min(at_) OVER (PARTITION BY alertname, life) AS began FROM group_changes)""",
)


def alert_spans(t: Tables) -> DataFrame:
    last = t.events.agg(F.timestamp_seconds((F.floor(F.unix_seconds(F.max("ts")) / GRID) + 1) * GRID)).scalar()
    return notify.alert_spans(_firing(t).where(F.col("ts") <= last), ["alertname", "model_id"], step=GRID, stopped=last)


NOTIFICATIONS_SQL = f"""
    SELECT alertname, {at('began')} AS since, {at('sent')} AS sent_at, CASE WHEN alerts > 0 THEN 'firing' ELSE 'resolved' END AS status, alerts,
           CASE WHEN sent = flush THEN started ELSE 0 END AS new_alerts, CASE WHEN sent = flush THEN ended ELSE 0 END AS resolved_alerts,
           ((sent - flush) // 3600)::INTEGER AS repeat
    FROM (SELECT *, unnest(range(flush, CASE WHEN alerts > 0 THEN next ELSE flush + 1 END, 3600)) AS sent
          FROM (SELECT *, lead(flush) OVER (PARTITION BY alertname, life ORDER BY at_) AS next FROM group_flushes))"""


@query("alr_repeat_suppress", NOTIFICATIONS_SQL)
def repeat_suppress(t: Tables) -> DataFrame:
    """Every notification of both alerts, resolved ones included."""
    return notify.notifications(alert_spans(t), ["alertname", "model_id"])


@query(
    "alr_inhibit",
    f"""
    SELECT alertname, severity, model_id, {at('e')} AS ts
    FROM (SELECT 'Latency' || (model_id < 'm4') AS alertname, 'critical' AS severity, model_id, e FROM lat WHERE value > 2
          UNION ALL
          SELECT 'Latency' || (model_id < 'm4'), 'warning', model_id, e FROM lat w WHERE value > 1 AND NOT EXISTS (
              SELECT 1 FROM lat c WHERE c.value > 2 AND c.e = w.e AND (c.model_id < 'm4') = (w.model_id < 'm4')))""",
)
def inhibit(t: Tables) -> DataFrame:
    """Models fall into two alert names; a critical one silences the warnings of its name."""
    above = tsexpr.latency_avg(t.latency, ["model_id"], WIDE, GRID).withColumn(
        "alertname", F.concat(F.lit("Latency"), (F.col("model_id") < "m4").cast("string"))
    )

    def firing(severity: str, limit: float) -> DataFrame:
        return above.where(F.col("value") > limit).select("alertname", F.lit(severity).alias("severity"), "model_id", "ts")

    return alerts.inhibit(firing("critical", 2.0).unionByName(firing("warning", 1.0)))


@query(
    "alr_unavailable_after_3",
    """
    SELECT model_id, id, failures, CASE WHEN failures >= 3 THEN 'unavailable' ELSE 'available' END AS status
    FROM (SELECT *, count(*) FILTER (NOT ok) OVER (PARTITION BY model_id, run ORDER BY ts, id) AS failures
          FROM (SELECT *, count(*) FILTER (ok) OVER (PARTITION BY model_id ORDER BY ts, id) AS run FROM checks))""",
)
def unavailable_after_3(t: Tables) -> DataFrame:
    return alerts.service_health(t.checks).select("model_id", "id", "failures", "status")
