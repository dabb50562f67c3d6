"""CPU, memory and network sizing per model.

Each linear program of three resources has a closed form, so sizing is one aggregate and a
projection for any number of models. Demand is d, cap C, margin m; an allocation is infeasible
where its lower bound is above the cap.

Input rows: model_id, demand_cpu, demand_memory, demand_network, demand_latency and the limits
max_cpu, max_memory, max_network, max_latency. Output adds cpu_allocation, memory_allocation,
network_allocation, solver_status, status, objective_value and utilization_*.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.scalars import clip, utilization
from fleetlens.operators.clean import with_stats
from fleetlens.schemas import SIZING_WEIGHTS

RESOURCES = ("cpu", "memory", "network")
MARGIN = 1.2
TOLERANCE = 0.2
MIN_UTILIZATION = 20.0
MAX_UTILIZATION = 90.0


def _d(r: str) -> Column:
    return F.col(f"demand_{r}")


def _cap(r: str) -> Column:
    return F.col(f"max_{r}")


def derive_resource_metrics(df: DataFrame, keys: Sequence[str] = ("model_id",)) -> DataFrame:
    """cpu_usage, memory_usage, network_io and latency from host metrics, or from service metrics.

    ``df`` is a wide frame, one row per model and time. A host metric column that is null throughout a model counts as absent.
    """
    basis = {
        "_requests": F.max("requests_total"),
        "_cpu": F.count("cpu_usage_real"),
        "_memory": F.count("memory_usage_real"),
        "_network": F.count("network_io_real"),
    }
    peak = F.when(F.col("_requests") > 0, F.col("_requests"))
    cpu = F.when(peak.isNotNull(), clip(F.col("requests_total") / peak * 0.8 * 100, 0.0, 100.0)).otherwise(F.lit(10.0))
    chosen = {
        "cpu_usage": F.when(F.col("_cpu") > 0, F.col("cpu_usage_real")).otherwise(cpu),
        "memory_usage": F.when(F.col("_memory") > 0, F.col("memory_usage_real")).otherwise(
            clip(F.col("latency_avg") * 10, 0.1, 100.0)
        ),
        "network_io": F.when(F.col("_network") > 0, F.col("network_io_real")).otherwise(
            clip(F.col("latency_p95") * 10, 0.1, 100.0)
        ),
        "latency": F.col("latency_p99"),
    }
    return with_stats(df, keys, basis, regular=True).withColumns(chosen).drop(*basis)


def demand(df: DataFrame, keys: Sequence[str] = ("model_id",)) -> DataFrame:
    """Peak demand per resource and peak latency."""
    return df.groupBy(*keys).agg(
        F.max("cpu_usage").alias("demand_cpu"),
        F.max("memory_usage").alias("demand_memory"),
        F.max("network_io").alias("demand_network"),
        F.max("latency").alias("demand_latency"),
    )


def default_missing(df: DataFrame) -> DataFrame:
    """Missing demand counts as half of ``max_<metric>``, or 50 where that limit is not given either;
    missing latency counts as 1."""
    limits = {"cpu": "max_cpu_usage", "memory": "max_memory_usage", "network": "max_network_io"}
    filled = {}
    for r, limit in limits.items():
        default = F.coalesce(F.col(limit), F.lit(100.0)) * 0.5 if limit in df.columns else F.lit(50.0)
        filled[f"demand_{r}"] = F.coalesce(_d(r), default)
    filled["demand_latency"] = F.coalesce(_d("latency"), F.lit(1.0))
    return df.withColumns(filled)


def _lower_bounds(margin: float) -> dict[str, Column]:
    """Demand with margin, and with the share of the latency limit in use."""
    share = _d("latency") / _cap("latency")
    return {r: F.greatest(_d(r) * margin, _d(r) * share) for r in RESOURCES}


def _all_fit(parts: Mapping[str, Column]) -> Column:
    fits = F.lit(True)
    for r in RESOURCES:
        fits = fits & (parts[r] <= _cap(r))
    return fits


def _fallback(margin: float) -> dict[str, Column]:
    return {r: F.when(_d(r) > 0, F.greatest(F.lit(0.1), _d(r) * margin)).otherwise(F.lit(1.0)) for r in RESOURCES}


def _result(df: DataFrame, feasible: Column, best: Mapping[str, Column], otherwise: Mapping[str, Column], objective: Column) -> DataFrame:
    """``objective`` is written over the allocation columns."""
    allocated = df.withColumn("_feasible", feasible).withColumns(
        {f"{r}_allocation": F.when(F.col("_feasible"), best[r]).otherwise(otherwise[r]) for r in RESOURCES}
    )
    return allocated.withColumns(
        {
            "solver_status": F.when(F.col("_feasible"), "Optimal").otherwise("Infeasible"),
            "status": F.when(F.col("_feasible"), "optimal").otherwise("fallback"),
            "objective_value": F.when(F.col("_feasible"), objective),
            **{f"utilization_{r}": utilization(_d(r), F.col(f"{r}_allocation")) for r in RESOURCES},
        }
    ).drop("_feasible")


def _weighted(weights: Mapping[str, float], normalised: bool = False) -> Column:
    terms = [F.lit(weights[r]) * F.col(f"{r}_allocation") / (_cap(r) if normalised else F.lit(1.0)) for r in RESOURCES]
    return terms[0] + terms[1] + terms[2]


def minimize_cost(df: DataFrame, weights: Mapping[str, float] = SIZING_WEIGHTS, margin: float = MARGIN) -> DataFrame:
    """Smallest allocation that covers demand with margin and the latency share."""
    bounds = _lower_bounds(margin)
    return _result(df, _all_fit(bounds), bounds, _fallback(margin), _weighted(weights))


def maximize_performance(df: DataFrame, weights: Mapping[str, float] = SIZING_WEIGHTS, margin: float = MARGIN) -> DataFrame:
    """All of every cap, where the lower bounds fit below it."""
    caps = {r: _cap(r) for r in RESOURCES}
    return _result(df, _all_fit(_lower_bounds(margin)), caps, _fallback(margin), -_weighted(weights))


def balance(df: DataFrame, margin: float = MARGIN) -> DataFrame:
    """Equal shares of the caps: the smallest share that covers every lower bound; imbalance 0."""
    bounds = _lower_bounds(margin)
    share = F.greatest(*[bounds[r] / _cap(r) for r in RESOURCES])
    equal = {r: share * _cap(r) for r in RESOURCES}
    return _result(df, share <= 1, equal, _fallback(margin), F.lit(0.0))


def balanced_min_cost(
    df: DataFrame,
    weights: Mapping[str, float] = SIZING_WEIGHTS,
    margin: float = MARGIN,
    tolerance: float = TOLERANCE,
    min_utilization: float = MIN_UTILIZATION,
) -> DataFrame:
    """Smallest normalised cost with neighbouring shares (cpu-memory, memory-network) within a tolerance.

    A latency above 0.8 of its limit scales the CPU and memory bounds from 1 up to 1.4. Each share
    is the largest of its own bound and its neighbours' bounds less the tolerance between them.
    """
    factor = F.least(_d("latency") / _cap("latency"), F.lit(1.0))
    scale = F.when(factor > 0.8, 1 + (factor - 0.8) * 2).otherwise(F.lit(1.0))
    floor = F.lit(min_utilization / 100)
    bound = {
        "cpu": F.greatest(_d("cpu") * margin * scale / _cap("cpu"), floor),
        "memory": F.greatest(_d("memory") * margin * scale / _cap("memory"), floor),
        "network": F.greatest(_d("network") * margin / _cap("network"), floor),
    }
    apart = {("cpu", "memory"): 1, ("memory", "network"): 1, ("cpu", "network"): 2}

    def share(r: str) -> Column:
        others = [bound[o] - apart[tuple(sorted((r, o)))] * tolerance for o in RESOURCES if o != r]
        return F.greatest(bound[r], *others)

    shares = {r: share(r) for r in RESOURCES}
    feasible = F.greatest(*shares.values()) <= 1
    best = {r: shares[r] * _cap(r) for r in RESOURCES}
    safe = {r: F.least(_d(r) * margin, _cap(r)) for r in RESOURCES}
    return _result(df, feasible, best, safe, _weighted(weights, normalised=True))


def performance_at_caps(df: DataFrame, weights: Mapping[str, float] = SIZING_WEIGHTS, margin: float = MARGIN) -> DataFrame:
    """The normalised form with the sign turned: caps where feasible, objective -1."""
    sized = balanced_min_cost(df, weights, margin)
    feasible = F.col("status") == "optimal"
    return sized.withColumns(
        {
            **{f"{r}_allocation": F.when(feasible, _cap(r)).otherwise(F.col(f"{r}_allocation")) for r in RESOURCES},
            **{f"utilization_{r}": F.when(feasible, utilization(_d(r), _cap(r))).otherwise(F.col(f"utilization_{r}")) for r in RESOURCES},
            "objective_value": F.when(feasible, F.lit(-float(sum(weights.values())))),
        }
    )


def error_fallback(df: DataFrame) -> DataFrame:
    """Half of every cap at 50 percent utilization: the answer where sizing could not be done."""
    return df.withColumns(
        {
            **{f"{r}_allocation": _cap(r) * 0.5 for r in RESOURCES},
            **{f"utilization_{r}": F.lit(50.0) for r in RESOURCES},
            "status": F.lit("error"),
        }
    )


def validate(sized: DataFrame, low: float = MIN_UTILIZATION, high: float = MAX_UTILIZATION, epsilon: float = 1e-5) -> DataFrame:
    """Flags: negative allocation (invalid), allocation short of demand, utilization outside its band."""
    busy = F.lit(True)
    for r in RESOURCES:
        busy = busy & (_d(r) > epsilon)
    flags: dict[str, Column] = {"valid": F.least(*[F.col(f"{r}_allocation") >= 0 for r in RESOURCES])}
    for r in RESOURCES:
        used = F.col(f"utilization_{r}")
        flags[f"short_{r}"] = (_d(r) > epsilon) & (F.col(f"{r}_allocation") < _d(r))
        flags[f"band_{r}"] = F.when(busy & (used < low), "below").when(busy & (used > high), "above").otherwise("ok")
    return sized.withColumns(flags)
