"""Closed forms against an enumeration of the vertices of each linear program."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest

from fleetlens.operators import sizing
from fleetlens.plans.predict_and_size import with_limits
from tests.conftest import rows

W = {"cpu": 0.4, "memory": 0.3, "network": 0.3}
CAPS = (100.0, 80.0, 50.0)


def best_vertex(cost, halfspaces):
    """Minimum of cost.x over the vertices of {x: a.x <= b}; None if there are none."""
    best = None
    for trio in itertools.combinations(halfspaces, 3):
        a = np.array([h[0] for h in trio], float)
        if abs(np.linalg.det(a)) < 1e-9:
            continue
        x = np.linalg.solve(a, np.array([h[1] for h in trio], float))
        if all(np.dot(h[0], x) <= h[1] + 1e-7 for h in halfspaces):
            value = float(np.dot(cost, x))
            best = value if best is None or value < best else best
    return best


def box(lows):
    e = np.eye(3)
    return [(-e[i], -lows[i]) for i in range(3)] + [(e[i], CAPS[i]) for i in range(3)]


def cases(n, seed):
    rng = random.Random(seed)
    return [
        (f"m{i}", rng.uniform(0, 90), rng.uniform(0, 75), rng.uniform(0, 45), rng.uniform(0, 1.6)) for i in range(n)
    ]


def frame(spark, data):
    df = spark.createDataFrame(data, "model_id STRING, demand_cpu DOUBLE, demand_memory DOUBLE, demand_network DOUBLE, demand_latency DOUBLE")
    return with_limits(df, {"max_cpu": CAPS[0], "max_memory": CAPS[1], "max_network": CAPS[2], "max_latency": 1.0})


def lows_plain(d):
    return [max(x * 1.2, x * d[4]) for x in d[1:4]]


def lows_scaled(d):
    f = min(d[4], 1.0)
    s = 1 + (f - 0.8) * 2 if f > 0.8 else 1.0
    return [max(d[1] * 1.2 * s, 20.0), max(d[2] * 1.2 * s, 16.0), max(d[3] * 1.2, 10.0)]


def neighbours(t):
    c, m, n = (np.eye(3)[i] / CAPS[i] for i in range(3))
    return [(c - m, t), (m - c, t), (m - n, t), (n - m, t)]


def test_minimize_cost(spark):
    data = cases(150, 1)
    got = {r["model_id"]: r for r in sizing.minimize_cost(frame(spark, data)).collect()}
    infeasible = 0
    for d in data:
        want = best_vertex([0.4, 0.3, 0.3], box(lows_plain(d)))
        row = got[d[0]]
        if want is None:
            infeasible += 1
            assert (row["status"], row["solver_status"], row["objective_value"]) == ("fallback", "Infeasible", None)
        else:
            assert row["objective_value"] == pytest.approx(want) and row["status"] == "optimal"
    assert 0 < infeasible < len(data)


def test_maximize_performance(spark):
    data = cases(80, 2)
    got = {r["model_id"]: r for r in sizing.maximize_performance(frame(spark, data)).collect()}
    for d in data:
        want = best_vertex([-0.4, -0.3, -0.3], box(lows_plain(d)))
        assert got[d[0]]["objective_value"] == (None if want is None else pytest.approx(want))


@pytest.mark.parametrize("seed", [3, 4])
def test_balanced_min_cost(spark, seed):
    data = cases(150, seed)
    got = {r["model_id"]: r for r in sizing.balanced_min_cost(frame(spark, data)).collect()}
    cost = [W[r] / c for r, c in zip(W, CAPS)]
    for d in data:
        want = best_vertex(cost, box(lows_scaled(d)) + neighbours(0.2))
        row = got[d[0]]
        assert row["objective_value"] == (None if want is None else pytest.approx(want))
        if want is None:
            assert row["cpu_allocation"] == pytest.approx(min(d[1] * 1.2, CAPS[0]))


def test_performance_at_caps(spark):
    data = cases(60, 5)
    got = {r["model_id"]: r for r in sizing.performance_at_caps(frame(spark, data)).collect()}
    cost = [-W[r] / c for r, c in zip(W, CAPS)]
    for d in data:
        want = best_vertex(cost, box(lows_scaled(d)) + neighbours(0.2))
        assert got[d[0]]["objective_value"] == (None if want is None else pytest.approx(want))


def test_balance_is_equal_and_smallest(spark):
    data = cases(60, 6)
    for d, row in zip(sorted(data), sizing.balance(frame(spark, data)).orderBy("model_id").collect()):
        share = max(low / cap for low, cap in zip(lows_plain(d), CAPS))
        assert (row["status"] == "optimal") == (share <= 1)
        if share <= 1:
            shares = [row[f"{r}_allocation"] / cap for r, cap in zip(W, CAPS)]
            assert shares == pytest.approx([share] * 3) and row["objective_value"] == 0.0


def test_fallback_of_idle_resources(spark):
    got = sizing.minimize_cost(frame(spark, [("m", 0.0, 0.05, 200.0, 0.1)])).first()
    assert (got["cpu_allocation"], got["memory_allocation"], got["network_allocation"]) == (1.0, 0.1, 240.0)
    assert got["utilization_cpu"] == 0.0


def test_default_missing(spark):
    got = sizing.default_missing(frame(spark, [("m", None, None, 1.0, None)])).first()
    assert (got["demand_cpu"], got["demand_memory"], got["demand_latency"]) == (50.0, 50.0, 1.0)


def test_validate_flags(spark):
    sized = sizing.minimize_cost(frame(spark, [("m", 50.0, 50.0, 10.0, 0.1)]))
    tight = sized.withColumn("cpu_allocation", sized["demand_cpu"] * 0.5).withColumn("utilization_cpu", sized["demand_cpu"] * 4)
    got = sizing.validate(tight).first()
    assert got["valid"] and got["short_cpu"] and got["band_cpu"] == "above" and not got["short_memory"] and got["band_memory"] == "ok"


def test_derive_prefers_host_metrics(spark):
    schema = "model_id STRING, requests_total DOUBLE, latency_avg DOUBLE, latency_p95 DOUBLE, latency_p99 DOUBLE, cpu_usage_real DOUBLE, memory_usage_real DOUBLE, network_io_real DOUBLE"
    data = [("a", 10.0, 0.5, 0.001, 2.0, 33.0, None, None), ("a", 20.0, 50.0, 1.0, 3.0, None, None, None), ("b", 0.0, 0.5, 0.5, 1.0, None, None, None), ("c", 5.0, 1.0, 1.0, 1.0, None, None, None), ("c", 10.0, 1.0, 1.0, 1.0, None, None, None)]
    got = rows(sizing.derive_resource_metrics(spark.createDataFrame(data, schema)), "model_id", "cpu_usage", "memory_usage", "network_io", "latency")
    assert got == [
        ("a", 33.0, 5.0, 0.1, 2.0),
        ("a", None, 100.0, 10.0, 3.0),
        ("b", 10.0, 5.0, 5.0, 1.0),
        ("c", 40.0, 10.0, 10.0, 1.0),
        ("c", 80.0, 10.0, 10.0, 1.0),
    ]
