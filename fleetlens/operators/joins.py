"""Joins, set operations, sorting and top-k over metrics, models and services."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.timeline import place


def metric_left(df: DataFrame, metrics: Sequence[str], keys: Sequence[str] = ("model_id", "timestamp")) -> DataFrame:
    """Every time of a model with the mean of each metric at that time, null where it has none: one aggregate."""
    return df.groupBy(*keys).agg(*[F.avg(F.when(F.col("metric_name") == m, F.col("value"))).alias(m) for m in metrics])


def join_forecasts(frames: Sequence[DataFrame], keys: Sequence[str] = ("model_id", "timestamp")) -> DataFrame:
    """Per-metric forecasts side by side, by model and time."""
    return reduce(lambda a, b: a.join(b, list(keys)), frames)


def vector_ratio(top: DataFrame, bottom: DataFrame, on: Sequence[str], value: str = "value") -> DataFrame:
    """Series divided by the series with the same labels; no result where the divisor is 0."""
    a = top.select(*on, F.col(value).alias("_a"))
    b = bottom.select(*on, F.col(value).alias("_b"))
    return a.join(b, list(on)).select(*on, F.try_divide("_a", "_b").alias(value)).where(F.col(value).isNotNull())


def vector_sum(a: DataFrame, b: DataFrame, on: Sequence[str], value: str = "value") -> DataFrame:
    """Series plus the series with the same labels."""
    left = a.select(*on, F.col(value).alias("_a"))
    right = b.select(*on, F.col(value).alias("_b"))
    return left.join(right, list(on)).select(*on, (F.col("_a") + F.col("_b")).alias(value))


def registered(rows: DataFrame, registry: DataFrame, on: str = "model_id") -> DataFrame:
    return rows.join(registry.select(on).distinct(), on, "left_semi")


def unregistered(rows: DataFrame, registry: DataFrame, on: str = "model_id") -> DataFrame:
    """Rows of models the registry does not know, with the error they are answered with."""
    return rows.join(registry.select(on).distinct(), on, "left_anti").withColumn("error", F.lit("Model not registered"))


def answered(rows: DataFrame, registry: DataFrame, on: str = "model_id") -> DataFrame:
    """All rows, with ``error`` for those of models the registry does not know: one scan, one left join."""
    known = registry.select(on).distinct().withColumn("_known", F.lit(True))
    error = F.when(F.col("_known").isNull(), F.lit("Model not registered"))
    return rows.join(known, on, "left").select(*rows.columns, error.alias("error"))


def services_gone(tracked: DataFrame, services: DataFrame, on: str = "model_id") -> DataFrame:
    return tracked.select(on).distinct().join(services.select(on).distinct(), on, "left_anti")


def add_registry_only(local: DataFrame, services: DataFrame, on: str = "model_id") -> DataFrame:
    """Local models plus services only the registry lists."""
    return local.unionByName(services.join(local.select(on), on, "left_anti"), allowMissingColumns=True)


def model_status(models: DataFrame, processes: DataFrame, services: DataFrame) -> DataFrame:
    """Status document per model.

    ``models``: model_id, feature_count, prediction_count, avg_latency, last_prediction.
    ``processes``: model_id, running, healthy. ``services``: model_id, service_status, url, port.
    Models the local registry lacks take the state the service list gives them.
    """
    local = models.join(processes, "model_id", "left").withColumn(
        "deployed", F.coalesce(F.col("running") & F.col("healthy"), F.lit(False))
    )
    both = local.withColumn("is_local", F.lit(True)).join(services, "model_id", "full")
    here = F.col("is_local").isNotNull()

    def pick(own: Column, other: Column | str | int | bool | None) -> Column:
        return F.when(here, own).otherwise(other if isinstance(other, Column) else F.lit(other))

    shown = F.date_format("last_prediction", "yyyy-MM-dd HH:mm:ss")
    return both.select(
        "model_id",
        pick(
            F.when(F.col("deployed"), "active").otherwise("inactive"), F.coalesce("service_status", F.lit("unknown"))
        ).alias("status"),
        F.struct(pick(F.col("feature_count"), 0).cast("bigint").alias("feature_count")).alias("metadata"),
        F.struct(
            pick(F.col("prediction_count"), 0).cast("bigint").alias("total_predictions"),
            pick(F.round(F.col("avg_latency") * 1000, 2), 0.0).alias("avg_latency_ms"),
            pick(F.when(F.col("prediction_count") > 0, shown).otherwise("Never"), "Never").alias("last_prediction"),
        ).alias("performance"),
        F.struct(
            pick(F.col("deployed"), True).alias("deployed"),
            F.when(~here | F.col("deployed"), F.col("url")).alias("url"),
            F.when(~here | F.col("deployed"), F.col("port")).alias("port"),
        ).alias("deployment"),
    )


def page(df: DataFrame, order: Sequence[Column], limit: int = 50, offset: int = 0) -> DataFrame:
    """One page of an ordered result."""
    return df.orderBy(*order).offset(offset).limit(limit)


def _behind(order: Sequence[str], after: Sequence[object]) -> Column:
    """Rows that come after the given values in descending order of the columns, nulls last."""
    column, value = F.col(order[0]), after[0]
    if value is None:  # only its ties can follow
        later, same = F.lit(False), column.isNull()
    else:
        later, same = column.isNull() | (column < F.lit(value)), column == F.lit(value)
    return later | (same & _behind(order[1:], after[1:])) if len(order) > 1 else later


def page_after(df: DataFrame, order: Sequence[str], after: Sequence[object] | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """The page behind a bookmark, in descending order of the columns (nulls last); they tell all rows apart.

    Rows in front of the bookmark are filtered out where they are read, and a task keeps ``limit`` rows however deep
    the page is.
    """
    rows = df if after is None else df.where(_behind(order, after))
    return page(rows, [F.col(c).desc_nulls_last() for c in order], limit, offset)


def bookmark(paged: DataFrame, order: Sequence[str]) -> tuple | None:
    """The place of the last row of a page, from which the next one goes on; none after an empty page."""
    last = paged.orderBy(*[F.col(c).asc_nulls_first() for c in order]).select(*order).first()
    return None if last is None else tuple(last)


def latest_value(df: DataFrame, keys: Sequence[str], ts: str = "timestamp", value: str = "value", tie: str | None = None) -> DataFrame:
    """Value at the latest time of each key."""
    return df.groupBy(*keys).agg(F.max(ts).alias(ts), F.max_by(value, place(ts, tie)).alias(value))
