"""Scalar column functions: time conversion, text formats, ratios. All stay in the JVM."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal_map(values: Mapping[str, float]) -> Column:
    """A fixed Python mapping as a map literal; folded into the plan, nothing is joined."""
    pairs = [F.lit(x) for item in values.items() for x in item]
    return F.create_map(*pairs)


def moment(value: datetime | str | Column) -> Column:
    """A time as a column. A datetime or text without a zone means UTC, whatever the zone of the driver."""
    if isinstance(value, Column):
        return value
    if isinstance(value, datetime):
        aware = value if value.tzinfo else value.replace(tzinfo=timezone.utc)
        value = aware.astimezone(timezone.utc).strftime("%Y-%m-%d %H:%M:%S.%f")
    return F.lit(value).cast("timestamp")


def to_epoch(text: Column) -> Column:
    """Seconds since 1970 from a number or an ISO time; no zone means UTC, null or bad text gives 0."""
    number = text.try_cast("double")
    iso = F.regexp_replace(text, "Z$", "+00:00")
    moment = F.try_to_timestamp(iso)
    seconds = F.unix_micros(moment) / F.lit(1000000.0)
    return F.coalesce(number, seconds, F.lit(0.0))


def to_iso_utc(epoch: Column) -> Column:
    """ISO-8601 UTC text of an epoch in seconds; fractions are shown to the microsecond when present."""
    moment = F.timestamp_micros(F.round(epoch * 1000000).cast("bigint"))
    whole = F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.date_format(moment, ".SSSSSS")
    return F.concat(whole, F.when(fraction == ".000000", "").otherwise(fraction), F.lit("+00:00"))


def to_utc(text: Column) -> Column:
    """Timestamp from text with a zone, an offset or none (taken as UTC)."""
    return F.try_to_timestamp(text)


def fixed(value: Column, digits: int) -> Column:
    """Text with a fixed number of digits, rounded on the exact binary value as C and Python do."""
    return F.call_function("format_number", value, F.lit("0." + "0" * digits))


def format_bytes(size: Column) -> Column:
    """Size in steps of 1024 with two decimals, B to PB; null gives N/A."""
    text = F.concat(fixed(size / F.lit(1024.0**5), 2), F.lit(" PB"))
    for power, unit in reversed(list(enumerate(["B", "KB", "MB", "GB", "TB"]))):
        scaled = size / F.lit(1024.0**power)
        text = F.when(scaled < 1024.0, F.concat(fixed(scaled, 2), F.lit(f" {unit}"))).otherwise(text)
    return F.when(size.isNull(), "N/A").otherwise(text)


def format_duration(seconds: Column) -> Column:
    """12.3s, 4m 5s or 2h 3m; null gives N/A."""
    whole = F.floor(seconds)
    minutes = F.format_string("%dm %ds", F.floor(whole / 60), whole % 60)
    hours = F.format_string("%dh %dm", F.floor(whole / 3600), F.floor(whole % 3600 / 60))
    return (
        F.when(seconds.isNull(), "N/A")
        .when(seconds < 60, F.concat(fixed(seconds, 1), F.lit("s")))
        .when(seconds < 3600, minutes)
        .otherwise(hours)
    )


def time_features(ts: Column) -> dict[str, Column]:
    """Calendar features; Monday is 0, weeks are ISO weeks."""
    weekday = F.weekday(ts)
    return {
        "hour": F.hour(ts),
        "day_of_week": weekday,
        "is_weekend": (weekday >= 5).cast("int"),
        "month": F.month(ts),
        "day": F.dayofmonth(ts),
        "week_of_year": F.weekofyear(ts),
    }


def utilization(demand: Column, allocation: Column) -> Column:
    """Demand as percent of allocation; 0 where nothing is allocated or the result is not finite."""
    percent = F.when(allocation > 0, demand / F.when(allocation > 0, allocation) * 100)
    finite = percent.isNotNull() & ~F.isnan(percent) & (F.abs(percent) != float("inf"))
    return F.when(finite, percent).otherwise(F.lit(0.0))


def feature_vector(features: Column, names: list[str]) -> Column:
    """Values of a feature map in the order of ``names``; null if any is missing."""
    values = F.array(*[F.element_at(features, F.lit(n)) for n in names])
    return F.when(F.exists(values, lambda x: x.isNull()), None).otherwise(values)


def clip(value: Column, low: Column | float, high: Column | float) -> Column:
    """Value held inside [low, high]; null stays null."""
    low = low if isinstance(low, Column) else F.lit(low)
    high = high if isinstance(high, Column) else F.lit(high)
    return F.when(value.isNotNull(), F.least(F.greatest(value, low), high))
