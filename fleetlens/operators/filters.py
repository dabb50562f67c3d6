"""Selection and validation of metric rows, label maps, constraints."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.scalars import clip, literal_map, moment
from fleetlens.schemas import VALUE_RANGES

Moment = datetime | str | Column


def time_range(df: DataFrame, start: Moment | None = None, end: Moment | None = None, ts: str = "timestamp") -> DataFrame:
    """Rows with start <= ts <= end; an end not after the start is an error."""
    if isinstance(start, datetime) and isinstance(end, datetime) and end <= start:
        raise ValueError("End time must be after start time")
    if start is not None:
        df = df.where(F.col(ts) >= moment(start))
    if end is not None:
        df = df.where(F.col(ts) <= moment(end))
    return df


def lookback(df: DataFrame, now: Moment, minutes: int = 24 * 60, ts: str = "timestamp") -> DataFrame:
    """Rows of the last minutes up to now; the default is a day."""
    at = moment(now)
    return df.where((F.col(ts) >= at - F.expr(f"INTERVAL {minutes} MINUTES")) & (F.col(ts) <= at))


def label_match(df: DataFrame, wanted: Mapping[str, str], labels: str = "labels") -> DataFrame:
    """Series whose label map holds every given value."""
    for name, value in wanted.items():
        df = df.where(F.col(labels)[name] == value)
    return df


def name_regex(df: DataFrame, pattern: str, name: str = "name") -> DataFrame:
    """Series whose whole name matches."""
    return df.where(F.col(name).rlike(f"^(?:{pattern})$"))


def relabel(
    df: DataFrame,
    source: Sequence[str],
    target: str,
    replacement: str,
    pattern: str = "(.*)",
    separator: str = ";",
    labels: str = "labels",
) -> DataFrame:
    """Write label ``target`` from the joined source labels where they match the whole pattern.

    ``replacement`` may name groups as ``$1``. An empty result removes the label.
    """
    joined = F.concat_ws(separator, *[F.coalesce(F.col(labels)[s], F.lit("")) for s in source])
    anchored = f"^(?:{pattern})$"
    value = F.regexp_replace(joined, anchored, replacement)
    others = F.map_filter(labels, lambda k, _: k != target)
    written = F.when(value == "", others).otherwise(F.map_concat(others, F.create_map(F.lit(target), value)))
    return df.withColumn(labels, F.when(joined.rlike(anchored), written).otherwise(F.col(labels)))


def check_columns(df: DataFrame, required: Mapping[str, str]) -> list[str]:
    """Problems of a frame's schema: missing columns and columns that are not of the wanted kind."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    numeric = ("double", "float", "int", "bigint", "smallint", "tinyint", "decimal")
    problems = [f"missing column {c}" for c in required if c not in kinds]
    for column, kind in required.items():
        have = kinds.get(column)
        if have is None:
            continue
        if kind == "number" and not have.startswith(numeric):
            problems.append(f"column {column} must be numeric")
        if kind == "time" and not have.startswith(("timestamp", "date", "string")):
            problems.append(f"column {column} must be a time")
    return problems


def check_any(df: DataFrame, choices: Sequence[Mapping[str, str]]) -> list[str]:
    """No problems if the frame fits one of several column sets, else those of the nearest set."""
    return min((check_columns(df, c) for c in choices), key=len)


def quality_report(
    df: DataFrame,
    ranges: Mapping[str, tuple[float, float]] = VALUE_RANGES,
    metric: str = "metric_name",
    value: str = "value",
    ts: str = "timestamp",
) -> DataFrame:
    """Per metric: rows, rows without a time, without a value, and out of the metric's range."""
    low, high = _bounds(ranges, metric)
    v = F.col(value)
    return df.groupBy(metric).agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.col(ts).isNull()).alias("n_bad_time"),
        F.count_if(v.isNull()).alias("n_null"),
        F.count_if((v < low) | (v > high)).alias("n_out_of_range"),
    )


def _bounds(ranges: Mapping[str, tuple[float, float]], metric: str) -> tuple[Column, Column]:
    low = literal_map({m: r[0] for m, r in ranges.items()})
    high = literal_map({m: r[1] for m, r in ranges.items()})
    return F.element_at(low, F.col(metric)), F.element_at(high, F.col(metric))


def clip_to_range(
    df: DataFrame,
    ranges: Mapping[str, tuple[float, float]] = VALUE_RANGES,
    metric: str = "metric_name",
    value: str = "value",
) -> DataFrame:
    """Value held inside its metric's range, with a flag for rows that were outside; other metrics pass."""
    low, high = _bounds(ranges, metric)
    v = F.col(value)
    outside = F.coalesce((v < low) | (v > high), F.lit(False))
    return df.select("*", outside.alias("clipped")).withColumn(
        value, F.when(F.col("clipped"), clip(v, low, high)).otherwise(v)
    )


def check_constraints(df: DataFrame) -> DataFrame:
    """Adds ``reason`` to sizing constraints, one row per model; null for a good row."""
    caps = ["max_cpu", "max_memory", "max_network", "max_latency"]
    weights = ["w_cpu", "w_memory", "w_network"]
    missing = F.greatest(*[F.col(c).isNull() for c in caps])
    negative = F.least(*[F.col(c) > 0 for c in caps])
    inside = F.least(*[F.col(w).between(0, 1) for w in weights])
    total = sum((F.col(w) for w in weights), F.lit(0.0))
    reason = (
        F.when(missing, "Missing required constraints")
        .when(~negative, "Constraint must be positive")
        .when(~F.coalesce(inside, F.lit(False)), "Weight must be between 0 and 1")
        .when(F.abs(total - 1.0) > 1e-6, "Weights must sum to 1")
    )
    return df.withColumn("reason", reason)

