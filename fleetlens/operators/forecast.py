"""Per-series forecasting.

A series is ``(model_id, metric_name)`` with columns ``timestamp`` and ``value``. The seasonal model
is a linear trend plus Fourier terms of the day, the week and, for series that span one, the year, solved from
sums per slot: however dense a series is, its fit sees at most one row per five minutes, and without seasons
longer than a week at most one per slot of the week.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetlens.functions.scalars import literal_map, moment, time_features
from fleetlens.functions.timeline import matched, place
from fleetlens.operators.clean import future_grid, resample, rolling_means
from fleetlens.operators.filters import Moment
from fleetlens.schemas import FORECAST_FLOORS, HOST_METRICS, LATENCY_METRICS, VALUE_RANGES

SERIES = ["model_id", "metric_name"]
DAY = 86400
WEEK = 7 * DAY
SLOT = 300
YEAR = 31_557_600
#: Periods in seconds with their number of Fourier terms.
SEASONS = ((DAY, 4), (WEEK, 3), (YEAR, 10))
#: The variant with a season of 24 days besides.
SEASONS_24_DAYS = (*SEASONS, (24 * DAY, 8))
MIN_POINTS = 8
Z95 = 1.96
RIDGE = 1e-3

FIT_SCHEMA = (
    "model_id STRING, metric_name STRING, coefficients ARRAY<DOUBLE>, center DOUBLE, scale DOUBLE, "
    "sigma DOUBLE, points BIGINT, last_time TIMESTAMP, multiplicative BOOLEAN"
)


Seasons = Sequence[tuple[int, int]]


def _slot(ts: str, slot: int, seasons: Seasons) -> Column:
    """Slot of the week a time falls into, or of all time where a season is longer; 1970-01-01 is the origin."""
    seconds = F.unix_seconds(ts)
    if all(WEEK % period == 0 for period, _ in seasons):
        seconds = F.pmod(seconds, F.lit(WEEK))
    return F.floor(seconds / F.lit(slot))


def _waves(seconds: np.ndarray, seasons: Seasons) -> np.ndarray:
    columns = [np.empty((len(seconds), 0))]
    for period, order in seasons:
        for k in range(1, order + 1):
            angle = 2 * math.pi * k * (seconds % period) / period
            columns.append(np.column_stack([np.sin(angle), np.cos(angle)]))
    return np.hstack(columns)


def _ridge(gram: np.ndarray, moment: np.ndarray, free: int = 0) -> np.ndarray:
    """Coefficients under the ridge, which leaves the first ones free."""
    penalty = np.eye(len(gram)) * RIDGE
    penalty[:free, :free] = 0.0
    return np.linalg.solve(gram + penalty, moment)


def _solve(sums: pd.DataFrame, slot: int, seasons: Seasons = SEASONS, whole_cycles: bool = True, multiplicative: bool = False) -> pd.DataFrame:
    """Coefficients of one series from its sums per slot."""
    n = sums["n"].to_numpy(float)
    total = n.sum()
    center = float((n * sums["mt"]).sum() / total)
    u = sums["mt"].to_numpy(float) - center
    spread = float((n * (sums["vt"] + u**2)).sum() / total)
    scale = math.sqrt(spread) if spread > 0 else 1.0
    u, var_u, cov_uy = u / scale, sums["vt"].to_numpy(float) / scale**2, sums["cty"].to_numpy(float) / scale
    y, var_y = sums["my"].to_numpy(float), sums["vy"].to_numpy(float)

    # a season longer than a week needs one whole cycle; those after one that is left out are zeros in between
    span = (sums["last_time"].max() - sums["first_time"].min()).total_seconds()
    used = [(p, order) for p, order in seasons if p <= WEEK or not whole_cycles or span >= p]
    last = max((i for i, season in enumerate(seasons) if season in used), default=-1)
    kept = np.array([season in used for season in seasons[: last + 1] for _ in range(2 * season[1])], dtype=bool)
    waves = _waves(sums["slot"].to_numpy(float) * slot, seasons[: last + 1])[:, kept]
    squares = (n * (var_y + y**2)).sum()
    inside = (n * var_u).sum()  # spread of time inside the slots

    line = np.column_stack([np.ones_like(n), u])
    fixed = line if multiplicative else np.hstack([line, waves])
    gram = fixed.T @ (fixed * n[:, None])
    gram[1, 1] += inside
    moment = fixed.T @ (n * y)
    moment[1] += (n * cov_uy).sum()
    beta = _ridge(gram, moment, free=1)
    if multiplicative:
        # the trend stays, and the seasons are fitted to what it is to be multiplied with: y ~ g + g * s
        g = line @ beta
        gg, gy = n * (g**2 + beta[1] ** 2 * var_u), n * (g * y + beta[1] * cov_uy)
        season_gram, season_moment = waves.T @ (waves * gg[:, None]), waves.T @ (gy - gg)
        seasonal = _ridge(season_gram, season_moment)
        residual = squares - 2 * (gy.sum() + seasonal @ (waves.T @ gy)) + gg.sum() + 2 * seasonal @ (waves.T @ gg) + seasonal @ season_gram @ seasonal
        beta = np.concatenate([beta, seasonal])
    else:
        residual = squares - 2 * beta @ moment + beta @ gram @ beta
    full = np.zeros(2 + len(kept))
    full[:2], full[2:][kept] = beta[:2], beta[2:]
    first = sums.iloc[0]
    return pd.DataFrame(
        {
            "model_id": [first["model_id"]],
            "metric_name": [first["metric_name"]],
            "coefficients": [full.tolist()],
            "center": [center],
            "scale": [scale],
            "sigma": [math.sqrt(max(residual, 0.0) / total)],
            "points": [int(total)],
            "last_time": [sums["last_time"].max()],
            "multiplicative": [multiplicative],
        }
    )


def seasonal_fit(
    df: DataFrame,
    slot: int = SLOT,
    min_points: int = MIN_POINTS,
    seasons: Seasons = SEASONS,
    whole_cycles: bool = True,
    multiplicative: bool = False,
    short_means: bool = False,
) -> DataFrame:
    """One fitted row per series; series with fewer points than the minimum are skipped, or with ``short_means`` fitted by
    their mean alone, +-10 percent.

    Seasons are added to the trend or, ``multiplicative``, scale it. One longer than a week is used where a series
    spans it, or everywhere without ``whole_cycles``.
    """
    days = F.unix_micros("timestamp") / F.lit(DAY * 1e6)
    sums = (
        df.where("value IS NOT NULL")
        .select(*SERIES, _slot("timestamp", slot, seasons).alias("slot"), days.alias("t"), F.col("value").alias("y"), "timestamp")
        .groupBy(*SERIES, "slot")
        .agg(
            F.count("*").alias("n"),
            F.avg("t").alias("mt"),
            F.var_pop("t").alias("vt"),
            F.covar_pop("t", "y").alias("cty"),
            F.avg("y").alias("my"),
            F.var_pop("y").alias("vy"),
            F.min("timestamp").alias("first_time"),
            F.max("timestamp").alias("last_time"),
        )
    )

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        solved = _solve(pdf, slot, seasons, whole_cycles, multiplicative)
        if solved["points"].iloc[0] >= min_points:
            return solved
        mean = float((pdf["n"] * pdf["my"]).sum() / pdf["n"].sum())
        return solved.assign(coefficients=[[mean]], sigma=abs(mean) * 0.1 / Z95, multiplicative=False).iloc[: int(short_means)]

    return sums.groupBy(*SERIES).applyInPandas(fit, FIT_SCHEMA)


def model_terms(ts: str, slot: int = SLOT, seasons: Seasons = SEASONS) -> Column:
    """The terms of the model at a time, in the order of its coefficients; the row carries the fit."""
    seconds = F.floor(F.unix_seconds(ts) / F.lit(slot)) * slot
    features = [F.lit(1.0), (F.unix_micros(ts) / F.lit(DAY * 1e6) - F.col("center")) / F.col("scale")]
    for period, order in seasons:
        for k in range(1, order + 1):
            angle = F.lit(2 * math.pi * k / period) * F.pmod(seconds, F.lit(period))
            features += [F.sin(angle), F.cos(angle)]
    return F.array(*features)


def _model_value(fits: DataFrame, ts: str, slot: int, seasons: Seasons) -> Column:
    """Trend and seasons; a fit with fewer coefficients than terms leaves the last seasons out."""
    products = F.zip_with("coefficients", model_terms(ts, slot, seasons), lambda b, x: F.coalesce(b * x, F.lit(0.0)))

    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0.0), lambda a, x: a + x)

    if "multiplicative" not in fits.columns:
        return total(products)
    trend, season = total(F.slice(products, 1, 2)), total(F.slice(products, 3, 2 * sum(order for _, order in seasons) + 1))
    return F.when(F.col("multiplicative"), trend * (1 + season)).otherwise(trend + season)


def seasonal_predict(
    fits: DataFrame, horizon_minutes: int = 30, step_minutes: int = 5, include_start: bool = True, slot: int = SLOT, seasons: Seasons = SEASONS
) -> DataFrame:
    """Forecast with a 95 percent interval on the future grid of each fitted series; no join."""
    points = max(1, horizon_minutes // step_minutes)
    first = 0 if include_start else 1
    steps = F.explode(F.sequence(F.lit(first), F.lit(first + points - 1)))
    grid = fits.withColumn("step", steps).withColumn(
        "timestamp", F.timestamp_seconds(F.unix_seconds("last_time") + F.col("step") * step_minutes * 60)
    )
    return grid.withColumn("yhat", _model_value(fits, "timestamp", slot, seasons)).select(
        *SERIES,
        "timestamp",
        "yhat",
        (F.col("yhat") - Z95 * F.col("sigma")).alias("yhat_lower"),
        (F.col("yhat") + Z95 * F.col("sigma")).alias("yhat_upper"),
    )


def fitted_values(df: DataFrame, fits: DataFrame, slot: int = SLOT, seasons: Seasons = SEASONS) -> DataFrame:
    """Rows of fitted series with the model's value ``yhat`` at their time, to judge a fit by."""
    model = [c for c in ("coefficients", "center", "scale", "multiplicative") if c in fits.columns]
    joined = matched(df, fits.select(*SERIES, *model), SERIES)
    return joined.withColumn("yhat", _model_value(fits, "timestamp", slot, seasons)).drop(*model)


def postprocess(forecast: DataFrame, floors: Mapping[str, float] = FORECAST_FLOORS, latency_exp: bool = False) -> DataFrame:
    """Hold forecasts above the metric's floor and the bounds around the forecast.

    ``latency_exp`` is for models fitted on the logarithm of latency.
    """
    bounds = ["yhat", "yhat_lower", "yhat_upper"]
    if latency_exp:
        is_latency = F.col("metric_name").isin(LATENCY_METRICS)
        forecast = forecast.withColumns({c: F.when(is_latency, F.exp(c)).otherwise(F.col(c)) for c in bounds})
    floor = F.coalesce(F.element_at(literal_map(floors), F.col("metric_name")), F.lit(0.0))
    floored = forecast.withColumns({c: F.greatest(F.col(c), floor) for c in bounds})
    return floored.withColumns(
        {"yhat_upper": F.greatest("yhat_upper", "yhat", "yhat_lower"), "yhat_lower": F.least("yhat_lower", "yhat")}
    )


def to_wide(forecast: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """One row per model and time with m and, where the forecast has bounds, m_lower and m_upper for each metric; missing values are 0."""
    names = {c: c.replace("yhat", "") for c in ("yhat", "yhat_lower", "yhat_upper") if c in forecast.columns}

    def pick(m: str, c: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("metric_name") == m, F.col(c))), F.lit(0.0))

    return forecast.groupBy("model_id", "timestamp").agg(*[pick(m, c).alias(m + end) for m in metrics for c, end in names.items()])


def mean_forecast(df: DataFrame, horizon_minutes: int = 30, step_minutes: int = 1, include_start: bool = False) -> DataFrame:
    """The series mean at every future time, +-10 percent."""
    means = df.groupBy(*SERIES).agg(F.avg("value").alias("yhat"))
    grid = future_grid(df, SERIES, "timestamp", horizon_minutes, step_minutes, include_start)
    return matched(grid, means, SERIES).select(
        *SERIES, "timestamp", "yhat", (F.col("yhat") * 0.9).alias("yhat_lower"), (F.col("yhat") * 1.1).alias("yhat_upper")
    )


def override_latest(forecast: DataFrame, observed: DataFrame, metrics: Sequence[str] = HOST_METRICS, tie: str | None = None) -> DataFrame:
    """Host metrics in a forecast take the value observed last."""
    last = (
        observed.where(F.col("metric_name").isin(*metrics) & F.col("value").isNotNull())
        .groupBy(*SERIES)
        .agg(F.max_by("value", place("timestamp", tie)).alias("_last"))
    )
    joined = matched(forecast, last, SERIES, "left")
    return joined.withColumn("yhat", F.coalesce("_last", "yhat")).drop("_last")


def flat_from_latest(
    observed: DataFrame, as_of: Moment, anchors: int = 1, points: int = 5, tie: str | None = None
) -> DataFrame:
    """Where no forecast is stored: the latest values, repeated.

    Points are five minutes apart; several anchors, 15 minutes apart back from ``as_of``, make a history.
    """
    last = observed.groupBy(*SERIES).agg(F.max_by("value", place("timestamp", tie)).alias("value"))
    spread = last.withColumn("anchor", F.explode(F.sequence(F.lit(0), F.lit(anchors - 1)))).withColumn(
        "point", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))
    )
    start = F.unix_seconds(moment(as_of)) - F.col("anchor") * 900
    return spread.select(
        *SERIES, "anchor", "point", F.timestamp_seconds(start + F.col("point") * 300).alias("timestamp"), "value"
    )


def flat_allocation(observed: DataFrame, tie: str | None = None) -> DataFrame:
    """The allocation shown beside such a forecast: fixed sizes, utilization from the latest host metrics."""
    last = observed.groupBy(*SERIES).agg(F.max_by("value", place("timestamp", tie)).alias("value"))

    def used(metric: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("metric_name") == metric, F.col("value"))), F.lit(0.0))

    return last.groupBy("model_id").agg(
        F.first(F.lit(100.0)).alias("cpu_allocation"),
        F.first(F.lit(1024.0)).alias("memory_allocation"),
        F.first(F.lit(1024.0)).alias("network_allocation"),
        used("cpu_usage_real").alias("utilization_cpu"),
        used("memory_usage_real").alias("utilization_memory"),
        (used("network_io_real") / (10 * 1024 * 1024)).alias("utilization_network"),
    )


# --- forests -------------------------------------------------------------------------------

TREES = 100
DEPTH = 10
SEED = 42
CALENDAR = ["hour", "day_of_week", "is_weekend", "month", "day"]
ROLLED = ["lag_1h", "lag_24h"]
#: With fewer features than three these are used.
FEW = ["hour", "day_of_week", "month"]


def _forest() -> RandomForestRegressor:
    return RandomForestRegressor(featuresCol="x", labelCol="z", predictionCol="zhat", numTrees=TREES, maxDepth=DEPTH, seed=SEED)


def _features(ts: Column, calendar: Sequence[str], values: Column, n_values: int, metrics: Sequence[str]) -> Column:
    """Calendar, values and, as a category, the metric: one vector ``x``."""
    times = [time_features(ts)[c].cast("double") for c in calendar]
    number = F.element_at(F.create_map(*[F.lit(v) for i, m in enumerate(metrics) for v in (m, float(i))]), F.col("metric_name"))
    numeric = [{"idx": i, "name": f"x{i}"} for i in range(len(times) + n_values)]
    nominal = [{"idx": len(numeric), "name": "metric", "vals": [*metrics, "none"]}]
    described = {"ml_attr": {"attrs": {"numeric": numeric, "nominal": nominal}, "num_attrs": len(numeric) + 1}}
    return array_to_vector(F.concat(F.array(*times), values, F.array(number))).alias("x", metadata=described)


def series_scale(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Number of values, mean (``level``) and deviation (``spread``, 1 if there is none) of each series of these metrics."""
    spread = F.stddev_pop("value")
    return (
        df.where(F.col("metric_name").isin(*metrics))
        .groupBy(*SERIES)
        .agg(F.count("value").alias("rows"), F.avg("value").alias("level"), F.when(spread > 0, spread).otherwise(1.0).alias("spread"))
    )


def forest_forecast(
    df: DataFrame, metrics: Sequence[str], horizon_minutes: int = 30, min_rows: int = 10, features: Sequence[str] = (*CALENDAR, *ROLLED)
) -> DataFrame:
    """One random forest for the series of all models and metrics, one-minute grid, +-10 percent.

    Values are taken relative to mean and deviation of their series, so series of any size share the forest; the
    metric is a category. Features are the calendar and the 1 h and 24 h rolling means, or those of them that are
    asked for. The grid begins after the last time of the model. Series with few rows get their mean, and a series
    without values has none.
    """
    features = list(features) if len(features) >= len(FEW) else FEW
    calendar, rolls = [f for f in features if f in (*CALENDAR, *FEW)], [f for f in features if f in ROLLED]
    wanted = df.where(F.col("metric_name").isin(*metrics))
    scale = series_scale(df, metrics)
    rolled = rolling_means(wanted, ["value"], keys=SERIES).withColumnsRenamed({f"value_{r}": r for r in ROLLED})

    back = W.partitionBy(*SERIES).orderBy(F.col("timestamp").desc())
    recent = rolled.withColumn("_age", F.row_number().over(back)).where("_age <= 24").groupBy(*SERIES).agg(*[F.avg(r).alias(r) for r in ROLLED])
    grid = future_grid(wanted, ["model_id"], "timestamp", horizon_minutes, 1, False)
    series = matched(scale, recent, SERIES)
    future = matched(grid, series, ["model_id"])

    relative = F.array(*[F.coalesce((F.col(r) - F.col("level")) / F.col("spread"), F.lit(0.0)) for r in rolls]).cast("array<double>")
    x = _features(F.col("timestamp"), calendar, relative, len(rolls), metrics)
    train = matched(rolled.where("value IS NOT NULL"), scale.where(F.col("rows") >= min_rows), SERIES)
    train = train.select(x, ((F.col("value") - F.col("level")) / F.col("spread")).alias("z"))
    future = future.select("*", x)
    if train.isEmpty():
        shown = future.withColumn("zhat", F.lit(0.0))
    else:
        shown = _forest().fit(train).transform(future)
    yhat = F.when(F.col("rows") >= min_rows, F.col("level") + F.col("spread") * F.col("zhat")).otherwise(F.col("level"))
    return shown.withColumn("yhat", yhat).select(
        *SERIES, "timestamp", "yhat", (F.col("yhat") * 0.9).alias("yhat_lower"), (F.col("yhat") * 1.1).alias("yhat_upper")
    )


LAGS = 12
STEP_CALENDAR = ["hour", "day_of_week", "month", "day", "week_of_year"]


def forest_recursive(
    df: DataFrame,
    metrics: Sequence[str],
    horizon: int = 30,
    step_minutes: int = 5,
    ranges: Mapping[str, tuple[float, float]] = VALUE_RANGES,
    checkpoint_every: int = 4,
) -> DataFrame:
    """One forest for all models and metrics on the calendar and the last 12 values, fed its own forecasts step by step.

    The state is one row per series with its last values as a vector, relative to the series as in
    ``forest_forecast``; each step is one transform over all of them, held in the metric's range before it is fed back.
    Long horizons cut the lineage with checkpoints, so the session needs its checkpoint folder set
    (``session.shared_folder``). Series of up to 12 values have no forecast.
    """
    rows = df.where(F.col("metric_name").isin(*metrics) & F.col("value").isNotNull()).select(*SERIES, "timestamp", "value")
    series = W.partitionBy(*SERIES).orderBy("timestamp")
    rows = matched(rows, series_scale(rows, metrics).drop("rows"), SERIES)
    rows = rows.withColumn("z", (F.col("value") - F.col("level")) / F.col("spread"))
    lagged = rows.withColumn("lags", F.array(*[F.lag("z", k).over(series) for k in range(1, LAGS + 1)])).where(F.col("lags")[LAGS - 1].isNotNull())

    def x(ts: Column) -> Column:
        return _features(ts, STEP_CALENDAR, F.col("lags"), LAGS, metrics)

    train = lagged.select(x(F.col("timestamp")), "z")
    low, high = (F.element_at(literal_map({m: float(r[i]) for m, r in ranges.items()}), F.col("metric_name")) for i in (0, 1))
    state = lagged.groupBy(*SERIES, "level", "spread").agg(
        F.max("timestamp").alias("origin"), F.max_by(F.concat(F.array("z"), F.slice("lags", 1, LAGS - 1)), place("timestamp")).alias("lags")
    ).withColumn("path", F.array().cast("array<double>"))
    if not train.isEmpty():
        model = _forest().fit(train)
        for i in range(1, horizon + 1):
            at = F.timestamp_seconds(F.unix_seconds("origin") + i * step_minutes * 60)
            value = F.col("level") + F.col("spread") * F.col("zhat")
            value = F.greatest(F.least(value, high), low)  # nulls, metrics without a range, are passed over
            stepped = model.transform(state.select("*", x(at))).withColumn("_v", value)
            state = stepped.select(
                *SERIES, "level", "spread", "origin",
                F.concat(F.array((F.col("_v") - F.col("level")) / F.col("spread")), F.slice("lags", 1, LAGS - 1)).alias("lags"),
                F.concat("path", F.array("_v")).alias("path"),
            )
            if i % checkpoint_every == 0 and i < horizon:
                state = state.checkpoint()
    steps = state.select(*SERIES, "origin", F.posexplode("path").alias("i", "yhat"))
    at = F.timestamp_seconds(F.unix_seconds("origin") + (F.col("i") + 1) * step_minutes * 60)
    return steps.select(*SERIES, at.alias("timestamp"), "yhat")


# --- stored models -------------------------------------------------------------------------


def save_fits(fits: DataFrame, path: str, fitted_at: Moment) -> None:
    fits.withColumn("fitted_at", moment(fitted_at)).write.mode("append").parquet(path)


def load_fits(spark: SparkSession, path: str) -> DataFrame:
    """The newest stored fit of each series."""
    stored = spark.read.parquet(path)
    rest = [c for c in stored.columns if c not in SERIES]
    newest = stored.groupBy(*SERIES).agg(F.max_by(F.struct(*rest), "fitted_at").alias("fit"))
    return newest.select(*SERIES, "fit.*")


def series_model(df: DataFrame, fit, predict, schema: str, step_seconds: int | None = None) -> DataFrame:  # noqa: ANN001
    """A user's ``fit(pdf) -> model`` and ``predict(model, pdf) -> pdf`` run on each series.

    Each series is handed to Python whole, as it is. A series too long for that can be averaged per time
    step: it then has at most (time span / step) rows, whatever the table holds.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return predict(fit(pdf), pdf)

    rows = df if step_seconds is None else resample(df, step_seconds)
    return rows.groupBy(*SERIES).applyInPandas(run, schema)


def score_rows(df: DataFrame, scorer, schema: str) -> DataFrame:  # noqa: ANN001
    """A user's ``scorer(pdf) -> pdf`` over Arrow batches; nothing is shuffled."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield scorer(pdf)

    return df.mapInPandas(run, schema)
