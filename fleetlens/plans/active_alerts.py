"""The alerts active now: those of models and those of their hosts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.operators.alerts import Thresholds, alert_view, for_models, host_breaches, resource_alerts, young_alerts
from fleetlens.operators.filters import Moment
from fleetlens.schemas import THRESHOLDS


def active_alerts(snapshots: DataFrame, hosts: DataFrame, now: Moment, thresholds: Thresholds = THRESHOLDS) -> DataFrame:
    """Alert rows with name, level, message, value, threshold and start, no older than 30 minutes.

    ``snapshots``: model_id, instance, ts, cpu_percent, memory_percent. ``hosts``: instance, ts and the
    percents of CPU, memory and disk. Old readings are dropped before anything is compared.
    """
    keep = ["model_id", "instance", "ts"]
    recent = young_alerts(snapshots, now, "ts")
    own = resource_alerts(recent, keep, thresholds)
    shared = for_models(host_breaches(young_alerts(hosts, now, "ts"), ["instance", "ts"], thresholds), recent)
    name = F.initcap(F.replace("type", F.lit("_"), F.lit(" ")))
    rows = own.unionByName(shared).withColumns(
        {
            "name": F.replace(name, F.lit("System Cpu"), F.lit("System CPU")),
            "active": F.lit(True),
            "since": F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        }
    )
    return alert_view(rows)
