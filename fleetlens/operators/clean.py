"""Cleaning and reshaping of metric series.

Windows here run over whole series. Apply them to series with one row per time step (after
``dedupe_mean``): such a series has at most (time span / step) rows however many rows were read,
since duplicates are averaged map-side before the shuffle. Statistics over a series are by default
grouped aggregates joined back, which need no such bound.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetlens.functions.scalars import clip, time_features
from fleetlens.functions.timeline import CHUNK_SECONDS, chunked, known_around, matched, running
from fleetlens.schemas import BASIC_METRICS, VALUE_RANGES

SERIES = ["model_id", "metric_name"]


def dedupe_mean(df: DataFrame, keys: Sequence[str] = ("timestamp", "metric_name", "model_id", "instance")) -> DataFrame:
    """One row per key with the mean value."""
    return df.groupBy(*keys).agg(F.avg("value").alias("value"))


def resample(
    df: DataFrame, step_seconds: int, keys: Sequence[str] = SERIES, ts: str = "timestamp", value: str = "value"
) -> DataFrame:
    """Mean per series and time step: makes a series regular, however densely it was sampled."""
    start = F.timestamp_seconds(F.floor(F.unix_seconds(F.col(ts)) / F.lit(step_seconds)) * step_seconds)
    return df.groupBy(*keys, start.alias(ts)).agg(F.avg(value).alias(value))


def dedupe_first(df: DataFrame, keys: Sequence[str], arrival: str) -> DataFrame:
    """One row per key: the one that arrived first. An aggregate, so duplicates never reach the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(arrival)).alias("row"))
    return first.select(*keys, "row.*")


def drop_duplicate_logs(logs: DataFrame, keys: Sequence[str] = ("model_id", "timestamp", "message")) -> DataFrame:
    return logs.dropDuplicates(list(keys))


def pivot_metrics(
    df: DataFrame, metrics: Sequence[str] = BASIC_METRICS, keys: Sequence[str] = ("model_id", "timestamp")
) -> DataFrame:
    """Long to wide with the mean per time; a metric a model never reports is 0, a missing point null."""
    owners = [k for k in keys if k != "timestamp"]
    if not owners:
        raise ValueError("the keys must name an owner of the series besides the time")
    means = [F.avg(F.when(F.col("metric_name") == m, F.col("value"))).alias(m) for m in metrics]
    rows = [F.count_if(F.col("metric_name") == m).alias(f"_r_{m}") for m in metrics]
    wide = df.groupBy(*keys).agg(*means, *rows)
    owner = W.partitionBy(*owners)
    filled = [F.when(F.sum(f"_r_{m}").over(owner) == 0, F.lit(0.0)).otherwise(F.col(m)).alias(m) for m in metrics]
    return wide.select(*keys, *filled)


def points_per_timestamp(df: DataFrame, metrics: Sequence[str], basic: Sequence[str] = BASIC_METRICS) -> DataFrame:
    """One record per model and time with the value of each metric; of several instances the last name wins.

    A null value counts as 0; basic metrics without a row are 0, others stay null.
    """
    newest = df.groupBy("timestamp", "metric_name", "model_id", F.coalesce("instance", F.lit("")).alias("instance")).agg(
        F.max_by(F.coalesce("value", F.lit(0.0)), "arrival").alias("value")
    )
    columns = []
    for m in metrics:
        last = F.max_by("value", F.when(F.col("metric_name") == m, F.col("instance")))
        columns.append((F.coalesce(last, F.lit(0.0)) if m in basic else last).alias(m))
    return newest.groupBy("model_id", "timestamp").agg(*columns)


def interpolate(
    df: DataFrame,
    columns: Sequence[str],
    keys: Sequence[str] = ("model_id",),
    ts: str = "timestamp",
    by_time: bool = False,
    regular: bool = True,
    seconds: int = CHUNK_SECONDS,
) -> DataFrame:
    """Linear interpolation inside each series, by row position or by elapsed time.

    Leading gaps stay null, trailing gaps repeat the last value. One row per series and time. Regular series (a row per
    step) are put through one window; those with raw times, of any length, through chunks (``regular=False``), where
    null keys become ``unknown``.
    """
    seconds_of = F.unix_micros(ts) / F.lit(1e6)
    if regular:
        series = W.partitionBy(*keys).orderBy(ts)
        placed = df.withColumn("_x", seconds_of if by_time else F.row_number().over(series).cast("double"))
        back = series.rowsBetween(W.unboundedPreceding, W.currentRow)
        # Looking ahead is looking back in reverse order: a frame to the end would be summed anew for each row.
        ahead = W.partitionBy(*keys).orderBy(F.col(ts).desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
        found = []
        for c in columns:
            known = F.when(F.col(c).isNotNull(), F.struct(F.col("_x").alias("at"), F.col(c).alias("v")))
            found.append(F.last(known, ignorenulls=True).over(back).alias(f"_p_{c}"))
            found.append(F.last(known, ignorenulls=True).over(ahead).alias(f"_n_{c}"))
        spans = placed.select("*", *found)
    else:
        parts = chunked(df, ts, seconds, keys)
        if by_time:
            placed = parts.withColumn("_x", seconds_of)
        else:
            placed = running(parts, keys, ts, [ts], {"_x": ("count", F.lit(1))}, seconds).withColumn("_x", F.col("_x").cast("double"))
        spans = known_around(placed, keys, ts, columns, "_x", seconds)

    def value(c: str) -> Column:
        p, n = F.col(f"_p_{c}"), F.col(f"_n_{c}")
        between = p["v"] + (n["v"] - p["v"]) * (F.col("_x") - p["at"]) / (n["at"] - p["at"])
        return (
            F.when(F.col(c).isNotNull(), F.col(c)).when(p.isNotNull() & n.isNull(), p["v"]).when(p.isNotNull(), between).alias(c)
        )

    return spans.select(*[value(c) if c in columns else c for c in df.columns])


def fill_gaps(
    df: DataFrame,
    keys: Sequence[str] = SERIES,
    ts: str = "timestamp",
    columns: Sequence[str] = ("value",),
    regular: bool = True,
    seconds: int = CHUNK_SECONDS,
) -> DataFrame:
    """Forward fill, then backward fill, then the series mean (which has no use left, but for series without any value).

    Regular series are put through one window, those with raw times through chunks; see ``interpolate``.
    """
    if not regular:
        placed = chunked(df, ts, seconds, keys).withColumn("_x", F.lit(0.0))
        around = known_around(placed, keys, ts, columns, "_x", seconds)
        return around.select(*[F.coalesce(c, f"_p_{c}.v", f"_n_{c}.v").alias(c) if c in columns else c for c in df.columns])
    series = W.partitionBy(*keys)
    back = series.orderBy(ts).rowsBetween(W.unboundedPreceding, W.currentRow)
    ahead = series.orderBy(F.col(ts).desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
    return df.withColumns(
        {
            c: F.coalesce(
                F.last(c, ignorenulls=True).over(back), F.last(c, ignorenulls=True).over(ahead), F.avg(c).over(series)
            )
            for c in columns
        }
    )


def fill_zero(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.fillna(0, subset=list(columns))


def with_stats(df: DataFrame, keys: Sequence[str], stats: Mapping[str, Column], regular: bool = False) -> DataFrame:
    """Adds aggregates of each series to its rows.

    By default they are grouped and joined back, which holds for series of any length. Regular
    series (one row per step) may take them from a window that shares the shuffle of the others.
    """
    if regular:
        series = W.partitionBy(*keys)
        return df.select("*", *[agg.over(series).alias(name) for name, agg in stats.items()])
    grouped = df.groupBy(*keys).agg(*[agg.alias(name) for name, agg in stats.items()])
    return matched(df, grouped, keys)


def cap_outliers(
    df: DataFrame, keys: Sequence[str] = SERIES, columns: Sequence[str] = ("value",), sigmas: float = 3.0, regular: bool = False
) -> DataFrame:
    """Cap at mean +- sigmas * sample standard deviation of the series; one-row series pass."""
    stats: dict[str, Column] = {}
    for c in columns:
        stats |= {f"_m_{c}": F.avg(c), f"_s_{c}": F.stddev_samp(c)}

    def capped(c: str) -> Column:
        mean, std = F.col(f"_m_{c}"), F.col(f"_s_{c}")
        held = clip(F.col(c), mean - sigmas * std, mean + sigmas * std)
        return F.when(std.isNull(), F.col(c)).otherwise(held).alias(c)

    known = with_stats(df, keys, stats, regular)
    return known.select(*[capped(c) if c in columns else c for c in df.columns])


def lag_features(
    df: DataFrame, columns: Sequence[str], lags: int = 12, keys: Sequence[str] = ("model_id",), ts: str = "timestamp"
) -> DataFrame:
    """``m_lag_1`` to ``m_lag_<lags>`` for each column; rows with any null are dropped."""
    series = W.partitionBy(*keys).orderBy(ts)
    shifted = [F.lag(c, k).over(series).alias(f"{c}_lag_{k}") for c in columns for k in range(1, lags + 1)]
    return df.select("*", *shifted).dropna()


PLAIN_FRAME = 32  # longer frames are summed in two levels


def rolling_sums(
    df: DataFrame, frames: Mapping[str, tuple[str, int]], keys: Sequence[str] = ("model_id",), ts: str = "timestamp"
) -> DataFrame:
    """Sum of ``column`` over the last n rows for each ``name: (column, n)``; short frames at the start are partial.

    Spark adds up a sliding frame anew for every row. A long frame of a * b rows is therefore the sum
    of b sums over a rows each.
    """
    series = W.partitionBy(*keys).orderBy(ts)
    parts = {name: max(d for d in range(1, int(n**0.5) + 1) if n % d == 0) if n > PLAIN_FRAME else n for name, (_, n) in frames.items()}
    short = df.select(
        "*", *[F.sum(c).over(series.rowsBetween(1 - parts[name], W.currentRow)).alias(name) for name, (c, _) in frames.items()]
    )
    totals = {}
    for name, (_, n) in frames.items():
        total = F.coalesce(F.col(name), F.lit(0.0))
        for shift in range(parts[name], n, parts[name]):
            total = total + F.coalesce(F.lag(name, shift).over(series), F.lit(0.0))
        totals[name] = total
    return short.withColumns(totals)


def rolling_means(
    df: DataFrame,
    columns: Sequence[str],
    spans: Mapping[str, int] = {"lag_1h": 12, "lag_24h": 288},
    keys: Sequence[str] = ("model_id",),
    ts: str = "timestamp",
) -> DataFrame:
    """Rolling mean of the last n rows, null until n non-null values are in the frame."""
    series = W.partitionBy(*keys).orderBy(ts)
    so_far = series.rowsBetween(W.unboundedPreceding, W.currentRow)
    names = {f"{c}_{span}": (c, n) for c in columns for span, n in spans.items()}
    counted = df.select("*", *[F.count(c).over(so_far).alias(f"_k_{c}") for c in columns])
    summed = rolling_sums(counted, names, keys, ts)
    means = []
    for name, (c, n) in names.items():
        held = F.col(f"_k_{c}") - F.coalesce(F.lag(f"_k_{c}", n).over(series), F.lit(0))
        means.append(F.when(held >= n, F.col(name) / n).alias(name))
    return summed.select(*df.columns, *means)


def minmax(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("model_id",), regular: bool = False) -> DataFrame:
    """``<c>_normalized`` in [0, 1] per series; 0 where the column is constant."""
    stats: dict[str, Column] = {}
    for c in columns:
        stats |= {f"_lo_{c}": F.min(c), f"_hi_{c}": F.max(c)}

    def scaled(c: str) -> Column:
        lo, hi = F.col(f"_lo_{c}"), F.col(f"_hi_{c}")
        value = F.when(hi > lo, (F.col(c) - lo) / F.when(hi > lo, hi - lo)).when(F.col(c).isNotNull(), F.lit(0.0))
        return value.alias(f"{c}_normalized")

    return with_stats(df, keys, stats, regular).select(*df.columns, *[scaled(c) for c in columns])


def zscore(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("model_id",), regular: bool = False) -> DataFrame:
    """``<c>_z`` with the population standard deviation; a deviation of 0 counts as 1."""
    stats: dict[str, Column] = {}
    for c in columns:
        stats |= {f"_m_{c}": F.avg(c), f"_s_{c}": F.stddev_pop(c)}

    def scaled(c: str) -> Column:
        std = F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(F.lit(1.0))
        return ((F.col(c) - F.col(f"_m_{c}")) / std).alias(f"{c}_z")

    return with_stats(df, keys, stats, regular).select(*df.columns, *[scaled(c) for c in columns])


def preprocess(df: DataFrame, metrics: Sequence[str], keys: Sequence[str] = ("model_id",), ts: str = "timestamp") -> DataFrame:
    """The cleaning steps in order on a wide frame: fill, cap, calendar, rolling means, min-max, zeros.

    The frame has one row per series and time, so every step is a window over the series and all of
    them share one shuffle.
    """
    capped = cap_outliers(fill_gaps(df, keys, ts, metrics), keys, metrics, regular=True)
    calendar = {k: v for k, v in time_features(F.col(ts)).items() if k != "week_of_year"}
    featured = rolling_means(capped.withColumns(calendar), metrics, keys=keys, ts=ts)
    rolled = [*metrics, *[f"{m}_{s}" for m in metrics for s in ("lag_1h", "lag_24h")]]
    scaled = minmax(featured, rolled, keys, regular=True)
    return fill_zero(scaled, [c for c in scaled.columns if c not in (*keys, ts)])


def train_frame(
    df: DataFrame, metrics: Sequence[str] = BASIC_METRICS, ranges: Mapping[str, tuple[float, float]] = VALUE_RANGES
) -> DataFrame:
    """Wide, one row per time, interpolated and clipped: what a forecaster is fitted on."""
    wide = interpolate(pivot_metrics(df, metrics), metrics)
    return wide.withColumns({m: clip(F.col(m), *ranges[m]) for m in metrics if m in ranges})


def future_grid(
    df: DataFrame,
    keys: Sequence[str] = ("model_id",),
    ts: str = "timestamp",
    horizon_minutes: int = 30,
    step_minutes: int = 5,
    include_start: bool = True,
) -> DataFrame:
    """Future times per series, from its last time on.

    Five-minute grid: max(1, horizon / 5) points from the last time. One-minute grid
    (``step_minutes=1, include_start=False``): ``horizon`` points after it.
    """
    points = max(1, horizon_minutes // step_minutes)
    first = 0 if include_start else 1
    last_time = df.groupBy(*keys).agg(F.max(ts).alias("_last"))
    offsets = F.sequence(F.lit(first), F.lit(first + points - 1))
    grid = last_time.select(*keys, "_last", F.explode(offsets).alias("step"))
    return grid.select(
        *keys, "step", F.timestamp_seconds(F.unix_seconds("_last") + F.col("step") * step_minutes * 60).alias(ts)
    )
