"""Threshold alerts, held conditions, grouping and inhibition; ``notify`` has what becomes of groups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetlens.functions.scalars import fixed, literal_map, moment
from fleetlens.functions.timeline import CHUNK, chunked, previous, rows_back, running
from fleetlens.operators.filters import Moment
from fleetlens.schemas import (
    ALERT_LIFETIME,
    DESCRIPTIONS,
    EVAL_STEP,
    MAX_FAILED_CHECKS,
    SUMMARIES,
    THRESHOLDS,
)

Thresholds = Mapping[str, Mapping[str, float]]


def _alert(kind: str, level: str, value: Column, threshold: float, message: Column) -> Column:
    return F.struct(
        F.lit(kind).alias("type"),
        F.lit(level).alias("level"),
        value.cast("double").alias("value"),
        F.lit(float(threshold)).alias("threshold"),
        message.alias("message"),
    )


def _text(*parts: str | Column) -> Column:
    """Parts joined; the string ``model_id`` stands for that column."""
    return F.concat(*[p if isinstance(p, Column) else F.col(p) if p == "model_id" else F.lit(p) for p in parts])


def _raise_alerts(df: DataFrame, keep: Sequence[str], alerts: Sequence[tuple[Column, Column]]) -> DataFrame:
    """One row per (condition, alert) that holds."""
    candidates = F.array(*[F.when(cond, alert) for cond, alert in alerts])
    return df.select(*keep, F.explode(F.filter(candidates, lambda a: a.isNotNull())).alias("a")).select(*keep, "a.*")


def latency_alerts(logs: DataFrame, keep: Sequence[str], thresholds: Thresholds = THRESHOLDS) -> DataFrame:
    """CRITICAL above the critical limit, else WARNING above the warning limit."""
    rules = thresholds["latency_rules"]
    latency = F.col("latency")

    def message(level: str) -> Column:
        tail = f"s) exceeds {level} threshold ({rules[level]}s)"
        return _text("Model ", "model_id", " latency (", latency.cast("string"), tail)

    critical = latency > rules["critical"]
    warning = ~critical & (latency > rules["warning"])
    return _raise_alerts(
        logs,
        keep,
        [
            (critical, _alert("latency", "CRITICAL", latency, rules["critical"], message("critical"))),
            (warning, _alert("latency", "WARNING", latency, rules["warning"], message("warning"))),
        ],
    )


def error_rate_alerts(
    logs: DataFrame, keep: Sequence[str], ts: str = "timestamp", tie: str = "event_id", thresholds: Thresholds = THRESHOLDS
) -> DataFrame:
    """CRITICAL where the error share of a model's last requests is above the limit."""
    rules = thresholds["error_rules"]
    window = int(rules["error_window"])
    counted = running(
        logs, ["model_id"], ts, [ts, tie], {"_n": ("count", F.lit(1)), "_errors": ("count", F.col("error"))}
    )
    failed = F.col("_errors") - F.coalesce("back__errors", F.lit(0))
    rates = rows_back(counted, ["model_id"], "_n", window, ["_errors"]).withColumn(
        "_rate", failed / F.least("_n", F.lit(window))
    )
    limit = rules["max_error_rate"]
    message = _text("Model ", "model_id", " error rate (", fixed(F.col("_rate") * 100, 2), f"%) exceeds threshold ({limit:.2%})")
    return _raise_alerts(
        rates,
        keep,
        [(F.col("_rate") > limit, _alert("error_rate", "CRITICAL", F.col("_rate"), limit, message))],
    )


def resource_alerts(snapshots: DataFrame, keep: Sequence[str], thresholds: Thresholds = THRESHOLDS) -> DataFrame:
    """WARNING rows for CPU and memory percent above their limits."""
    rules = thresholds["resource_rules"]
    alerts = []
    for column, kind, name, key in (
        ("cpu_percent", "cpu_usage", "CPU", "cpu_threshold"),
        ("memory_percent", "memory_usage", "memory", "memory_threshold"),
    ):
        tail = f"%) exceeds threshold ({rules[key]}%)"
        message = _text("Model ", "model_id", f" {name} usage (", fixed(F.col(column), 1), tail)
        alerts.append((F.col(column) > rules[key], _alert(kind, "WARNING", F.col(column), rules[key], message)))
    return _raise_alerts(snapshots, keep, alerts)


def accuracy_alerts(accuracy: DataFrame, keep: Sequence[str], ts: str = "ts", thresholds: Thresholds = THRESHOLDS) -> DataFrame:
    """WARNING for accuracy below the minimum and for a drop against the reading before."""
    rules = thresholds["model_performance_rules"]
    rows = previous(accuracy, ["model_id"], ts, [ts], ["accuracy"]).withColumn(
        "_drop", F.col("prev_accuracy") - F.col("accuracy")
    )
    tail = f"%) below minimum threshold ({rules['min_accuracy']:.2%})"
    low = _text("Model ", "model_id", " accuracy (", fixed(F.col("accuracy") * 100, 2), tail)
    drop = _text("Model ", "model_id", " accuracy dropped by ", fixed(F.col("_drop") * 100, 2), "%")
    limit = rules["accuracy_drop_threshold"]
    return _raise_alerts(
        rows,
        keep,
        [
            (F.col("accuracy") < rules["min_accuracy"], _alert("accuracy", "WARNING", F.col("accuracy"), rules["min_accuracy"], low)),
            (F.col("_drop") > limit, _alert("accuracy_drop", "WARNING", F.col("_drop"), limit, drop)),
        ],
    )


def host_breaches(hosts: DataFrame, keep: Sequence[str], thresholds: Thresholds = THRESHOLDS) -> DataFrame:
    """Alerts of hosts whose CPU, memory or disk percent is above its limit; at most three per reading."""
    rules = thresholds["resource_rules"]
    alerts = []
    for column, kind, name in (("cpu_percent", "cpu", "CPU"), ("memory_percent", "memory", "Memory"), ("disk_percent", "disk", "Disk")):
        limit = rules[f"{kind}_threshold"]
        message = _text(f"System {name} usage (", fixed(F.col(column), 1), f"%) exceeds threshold ({limit}%)")
        alerts.append((F.col(column) > limit, _alert(f"system_{kind}_usage", "WARNING", F.col(column), limit, message)))
    return _raise_alerts(hosts, keep, alerts)


def on_hosts(models: DataFrame) -> DataFrame:
    """Which model runs on which host: the relation behind the alerts of hosts."""
    return models.select("model_id", "instance").distinct()


def system_alerts(models: DataFrame, hosts: DataFrame, ts: str = "ts", thresholds: Thresholds = THRESHOLDS) -> DataFrame:
    """Each breach of a host that runs models, once, with their number (``n_models``); see ``for_models``.

    The result is as long as there are breaches, however many models share a host.
    """
    served = on_hosts(models).groupBy("instance").agg(F.count(F.lit(1)).alias("n_models"))
    return host_breaches(hosts, ["instance", ts], thresholds).join(served, "instance")


def for_models(breaches: DataFrame, models: DataFrame, asked: Sequence[str] | None = None) -> DataFrame:
    """The breaches of ``system_alerts`` as alerts of the models asked for, or of every model on the host.

    A join on the host, so the work is that of the result; one host reproduces "every model".
    """
    relation = on_hosts(models)
    if asked is not None:
        relation = relation.where(F.col("model_id").isin(list(asked)))
    return relation.join(breaches, "instance").drop("n_models")


def alert_view(alerts: DataFrame) -> DataFrame:
    """Alert columns as shown to users, with their defaults."""
    defaults = {
        "name": F.lit("Unknown Alert"),
        "type": F.lit("unknown"),
        "level": F.lit("INFO"),
        "message": F.lit(""),
        "value": F.lit(0.0),
        "threshold": F.lit(0.0),
        "active": F.lit(False),
        "model_id": F.lit(""),
        "since": F.lit(""),
    }
    return alerts.select(
        *[(F.coalesce(F.col(c), d) if c in alerts.columns else d).alias(c) for c, d in defaults.items()]
    )


def young_alerts(alerts: DataFrame, now: Moment, ts: str = "timestamp", lifetime: int = ALERT_LIFETIME) -> DataFrame:
    """Alerts younger than their lifetime."""
    return alerts.where(F.col(ts) > moment(now) - F.expr(f"INTERVAL {lifetime} SECONDS"))


def level_counts(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("level").agg(F.count("*").alias("n"))


def gauge_conditions(gauges: DataFrame, rules: Mapping[str, tuple[str, str, float, int]], name: str = "name") -> DataFrame:
    """Gauge evaluations above the limit of their rule, with alert name, severity and hold time."""

    def field(i: int, kind: str) -> Column:
        pairs = [F.lit(x) for metric, rule in rules.items() for x in (metric, rule[i])]
        return F.element_at(F.create_map(*pairs), F.col(name)).cast(kind)

    known = gauges.where(F.col(name).isin(*rules))
    return known.where(F.col("value") > field(2, "double")).select(
        field(0, "string").alias("alertname"),
        field(1, "string").alias("severity"),
        field(3, "int").alias("hold"),
        *[c for c in gauges.columns if c != name],
    )


def hold(conditions: DataFrame, keys: Sequence[str], for_seconds: int | Column, ts: str = "ts", step: int = EVAL_STEP) -> DataFrame:
    """State of a condition at every evaluation where it is true.

    ``conditions`` holds only true evaluations, one row per key and time. A missing evaluation ends
    the run. ``since`` is the start of the run; the state is firing once it has held long enough.
    """
    wait = for_seconds if isinstance(for_seconds, Column) else F.lit(for_seconds)
    series = W.partitionBy(*keys).orderBy(ts)
    # Consecutive evaluations keep (time / step - number of the time) constant; rows of one time share it.
    run = F.unix_seconds(ts) / F.lit(step) - F.dense_rank().over(series)
    runs = conditions.withColumn("_run", run)
    since = F.min(ts).over(W.partitionBy(*keys, "_run"))
    held = F.unix_seconds(ts) - F.unix_seconds("since")
    return (
        runs.withColumn("since", since)
        .withColumn("state", F.when(held >= wait, "firing").otherwise("pending"))
        .drop("_run")
    )


def intervals(states: DataFrame, keys: Sequence[str], ts: str = "ts") -> DataFrame:
    """Runs of a held condition: start, time of first firing if any, last true evaluation."""
    firing = F.when(F.col("state") == "firing", F.col(ts))
    return states.groupBy(*keys, "since").agg(
        F.min(firing).alias("firing_from"), F.max(ts).alias("until"), F.count("*").alias("evaluations")
    )


def render(alerts: DataFrame, templates: Mapping[str, str] = DESCRIPTIONS, labels: Sequence[str] = ("model_id", "instance", "mountpoint")) -> DataFrame:
    """Adds ``summary`` and ``description``: the alert's texts with ``{label}`` replaced by the row's label."""
    text = F.element_at(literal_map(templates), F.col("alertname"))
    for label in labels:
        value = F.coalesce(F.col(label), F.lit("")) if label in alerts.columns else F.lit("")
        text = F.replace(text, F.lit("{" + label + "}"), value)
    return alerts.withColumns({"summary": F.element_at(literal_map(SUMMARIES), F.col("alertname")), "description": text})


def group(firing: DataFrame, by: Sequence[str] = ("alertname",), ts: str = "ts") -> DataFrame:
    """One notification group per label and evaluation: how many series fire and how many are new.

    Members stay rows of ``firing`` under the same key; a group is counted, never gathered.
    """
    new = F.col("newly_firing").cast("int")
    return firing.groupBy(*by, ts).agg(F.count("*").alias("alerts"), F.sum(new).alias("new_alerts"))


def mark_new(firing: DataFrame, keys: Sequence[str], ts: str = "ts", step: int = EVAL_STEP) -> DataFrame:
    """Adds ``newly_firing``: the series did not fire at the evaluation before."""
    before = F.lag(ts).over(W.partitionBy(*keys).orderBy(ts))
    gap = F.unix_seconds(ts) - F.unix_seconds(before)
    return firing.withColumn("newly_firing", before.isNull() | (gap != step))


def inhibit(firing: DataFrame, equal: Sequence[str] = ("alertname",), ts: str = "ts") -> DataFrame:
    """Warnings are dropped at evaluations where a critical alert with equal labels fires."""
    critical = firing.where("severity = 'critical'").select(*equal, ts).distinct()
    warnings = firing.where("severity = 'warning'").join(critical, [*equal, ts], "left_anti")
    return firing.where("severity <> 'warning'").unionByName(warnings)


def service_health(
    checks: DataFrame, keys: Sequence[str] = ("model_id",), ts: str = "ts", tie: str = "id", limit: int = MAX_FAILED_CHECKS
) -> DataFrame:
    """Consecutive failed checks after each check; unavailable from the limit on, a success resets."""
    numbered = running(chunked(checks, ts), keys, ts, [ts, tie], {"_n": ("count", F.lit(1))})
    marked = running(numbered, keys, ts, [ts, tie], {"_ok": ("max", F.when(F.col("ok"), F.col("_n")))})
    failures = F.col("_n") - F.coalesce("_ok", F.lit(0))
    return (
        marked.withColumn("failures", failures)
        .withColumn("status", F.when(F.col("failures") >= limit, "unavailable").otherwise("available"))
        .drop("_n", "_ok", CHUNK)
    )
