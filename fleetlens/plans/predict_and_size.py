"""Collect, fit or load, forecast, override, size."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.timeline import matched
from fleetlens.operators import forecast, sizing
from fleetlens.operators.clean import dedupe_mean
from fleetlens.operators.filters import Moment, clip_to_range, time_range
from fleetlens.schemas import BASIC_METRICS, HOST_METRICS

LIMITS = {"max_cpu": 100.0, "max_memory": 100.0, "max_network": 100.0, "max_latency": 1.0}


def with_limits(df: DataFrame, limits: Mapping[str, float] = LIMITS) -> DataFrame:
    return df.withColumns({k: F.lit(float(v)) for k, v in limits.items()})


def predict_and_size(
    metrics: DataFrame,
    start: Moment | None = None,
    end: Moment | None = None,
    horizon_minutes: int = 30,
    limits: Mapping[str, float] = LIMITS,
    names: Sequence[str] = (*BASIC_METRICS, *HOST_METRICS),
    fits: DataFrame | None = None,
) -> DataFrame:
    """One sizing row per model from its long metric table; series too short for a fit keep their mean.

    Two shuffles carry the raw rows' weight: the mean per series and time, and the sums per slot of
    the week; everything after is one row per series and future step.
    """
    wanted = time_range(metrics.where(F.col("metric_name").isin(*names)), start, end)
    observed = clip_to_range(dedupe_mean(wanted, ["timestamp", "metric_name", "model_id"])).drop("clipped")
    if fits is None:
        predicted = forecast.seasonal_predict(forecast.seasonal_fit(observed, short_means=True), horizon_minutes)
    else:
        rest = matched(observed, fits.select(*forecast.SERIES), forecast.SERIES, "left_anti")
        meant = forecast.mean_forecast(rest, horizon_minutes, step_minutes=5, include_start=True)
        predicted = forecast.seasonal_predict(fits, horizon_minutes).unionByName(meant)
    predicted = forecast.postprocess(predicted)
    overridden = forecast.override_latest(predicted, observed)
    wide = (
        overridden.groupBy("model_id", "timestamp")
        .agg(*[F.max(F.when(F.col("metric_name") == m, F.col("yhat"))).alias(m) for m in names])
    )
    needed = sizing.demand(sizing.derive_resource_metrics(wide))
    return sizing.minimize_cost(with_limits(sizing.default_missing(needed), limits))
