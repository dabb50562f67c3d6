"""The life of a notification: alerts form groups, groups are sent, repeated and resolved.

A group lives from the first alert that fires until a flush finds none of its alerts firing. It is first flushed
``wait`` seconds after it begins and then every ``interval`` seconds; an alert that changes at the moment of a flush
is seen by the next one. A flush sends if alerts have begun to fire or were resolved since the last one, or if
``repeat`` seconds have passed since the last send while some fire. An alert that fires and ends between two flushes
was never sent as firing; it is told as resolved beside others that fire, and alone not at all. One that ends and
fires again between two flushes has not changed.

Only changes are looked at, never the evaluations between them: alerts are put together as spans, and their ends are
counted per group and time before groups are followed, so what one task sees of a group are its distinct times.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetlens.schemas import EVAL_STEP, GROUP_INTERVAL, GROUP_WAIT, REPEAT_INTERVAL, RESOLVE_TIMEOUT


def alert_spans(
    firing: DataFrame, keys: Sequence[str], ts: str = "ts", step: int = EVAL_STEP, stopped: Column | None = None, resolve_timeout: int = RESOLVE_TIMEOUT
) -> DataFrame:
    """Runs of firing evaluations: ``starts`` and ``ends`` in seconds.

    An alert ends at the first evaluation where it doesn't fire. Where evaluations end altogether (``stopped``, the
    time of the last one) nothing ends it: it is resolved once it wasn't reported for the resolve timeout.
    """
    epoch = F.unix_seconds(ts)
    series = W.partitionBy(*keys).orderBy(ts)
    runs = firing.select(*keys, epoch.alias("_at"), (epoch / F.lit(step) - F.row_number().over(series)).alias("_run"))
    spans = runs.groupBy(*keys, "_run").agg(F.min("_at").alias("starts"), F.max("_at").alias("_last"))
    ends = F.col("_last") + step
    if stopped is not None:
        ends = F.when(ends > F.unix_seconds(stopped), F.col("_last") + resolve_timeout).otherwise(ends)
    return spans.select(*keys, "starts", ends.alias("ends"))


def flush_of(at: int, began: int, wait: int, interval: int) -> int:
    """The flush that sees what changes at a time, in a group that began at another."""
    first = began + wait
    return first if at == began or at < first else first + ((at - first) // interval + 1) * interval


def flushes(moves: DataFrame, by: Sequence[str], wait: int = GROUP_WAIT, interval: int = GROUP_INTERVAL) -> DataFrame:
    """For every time (``at``) at which alerts of a group start (``d`` = 1) or end (-1): the begin of the group's life and
    the flush that sees it."""
    changes = moves.groupBy(*by, "at").agg(F.sum("d").alias("change"))
    order = W.partitionBy(*by).orderBy("at")
    before = F.coalesce(F.sum("change").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # nothing fires and the last flush is over: what comes now is another life for sure
    fresh = (before == 0) & F.coalesce(F.col("at") - F.lag("at").over(order) >= max(wait, interval), F.lit(True))
    parts = changes.withColumn("_fresh", fresh.cast("long")).withColumn("_part", F.sum("_fresh").over(order)).drop("_fresh")
    names = [*by, "at", "began", "flush"]

    def follow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        firing, began, closes, out = 0, None, None, []
        for at, change in zip(pdf["at"].tolist(), pdf["change"].tolist(), strict=True):
            if began is None or (firing == 0 and at >= closes):
                began = at
            firing += change
            closes = flush_of(at, began, wait, interval)
            out.append((began, closes))
        pdf["began"], pdf["flush"] = [b for b, _ in out], [f for _, f in out]
        return pdf[names]

    kinds = {f.name: f.dataType.simpleString() for f in changes.schema.fields}
    schema = ", ".join([*[f"{c} {kinds[c]}" for c in by], "at long, began long, flush long"])
    return parts.groupBy(*by, "_part").applyInPandas(follow, schema)


def notifications(
    spans: DataFrame,
    keys: Sequence[str],
    by: Sequence[str] = ("alertname",),
    wait: int = GROUP_WAIT,
    interval: int = GROUP_INTERVAL,
    repeat: int = REPEAT_INTERVAL,
) -> DataFrame:
    """What is sent of each group: when, and how many alerts fire, are new, are resolved; ``repeat`` counts from 0.

    ``keys`` name an alert and hold ``by``. A send after which none fires is ``resolved``.
    """
    both = F.array(F.struct(F.col("starts").alias("at"), F.lit(1).alias("d")), F.struct(F.col("ends").alias("at"), F.lit(-1).alias("d")))
    moves = spans.select(*keys, "starts", F.inline(both))
    seen = moves.join(flushes(moves, by, wait, interval), [*by, "at"])
    told = seen.groupBy(*keys, "starts", "began").agg(F.min("flush").alias("shown"), F.max("flush").alias("gone"))

    # an alert that is back by the flush that would see it end
    alert = W.partitionBy(*keys, "began").orderBy("starts")
    told = told.withColumn("_new", F.coalesce(F.col("shown") > F.lag("gone").over(alert), F.lit(True)).cast("long"))
    told = told.withColumn("_run", F.sum("_new").over(alert)).groupBy(*keys, "began", "_run").agg(F.min("shown").alias("shown"), F.max("gone").alias("gone"))

    short = F.col("shown") == F.col("gone")
    ends = F.array(
        F.struct(F.col("shown").alias("at"), (~short).cast("long").alias("new"), F.lit(0).cast("long").alias("gone"), short.cast("long").alias("short")),
        F.struct(F.col("gone").alias("at"), F.lit(0).cast("long").alias("new"), (~short).cast("long").alias("gone"), F.lit(0).cast("long").alias("short")),
    )
    counts = told.select(*by, "began", F.explode(ends).alias("m")).groupBy(*by, "began", F.col("m.at").alias("at"))
    counts = counts.agg(*[F.sum(f"m.{c}").alias(c) for c in ("new", "gone", "short")])
    life = W.partitionBy(*by, "began").orderBy("at")
    counts = counts.withColumn("alerts", F.sum(F.col("new") - F.col("gone")).over(life.rowsBetween(W.unboundedPreceding, W.currentRow)))
    sends = counts.where("new > 0 OR gone > 0 OR (short > 0 AND alerts > 0)").withColumn("_next", F.lead("at").over(life))

    every = -(-repeat // interval) * interval
    last = F.when(F.col("alerts") > 0, F.coalesce(F.col("_next") - 1, F.col("at"))).otherwise(F.col("at"))
    times = sends.select("*", F.posexplode(F.sequence("at", last, F.lit(every).cast("long"))).alias("repeat", "_sent"))
    first = F.col("repeat") == 0
    return times.select(
        *by,
        F.timestamp_seconds("began").alias("since"),
        F.timestamp_seconds("_sent").alias("sent_at"),
        F.when(F.col("alerts") > 0, "firing").otherwise("resolved").alias("status"),
        "alerts",
        F.when(first, F.col("new")).otherwise(0).alias("new_alerts"),
        F.when(first, F.col("gone") + F.col("short")).otherwise(0).alias("resolved_alerts"),
        "repeat",
    )
