"""Cleaning, reshaping and window features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.catalog.registry import query
from fleetlens.catalog.sql import r6, text, view
from fleetlens.catalog.tables import Tables
from fleetlens.operators import clean
from fleetlens.schemas import BASIC_METRICS, HOST_METRICS
from fleetlens.sources.metrics import stack_frames

COLS = ", ".join(f"{r6(m)} AS {m}" for m in BASIC_METRICS)
TS = f"{text('timestamp')} AS timestamp"


@query(
    "cln_dedupe_mean",
    f"SELECT {TS}, metric_name, model_id, instance, {r6('avg(value)')} AS value FROM metrics GROUP BY timestamp, metric_name, model_id, instance",
)
def dedupe_mean(t: Tables) -> DataFrame:
    return clean.dedupe_mean(t.metrics)


@query(
    "cln_dedupe_first",
    f"SELECT {TS}, metric_name, model_id, event_id, value FROM metrics "
    "QUALIFY row_number() OVER (PARTITION BY timestamp, metric_name, model_id ORDER BY event_id) = 1",
)
def dedupe_first(t: Tables) -> DataFrame:
    first = clean.dedupe_first(t.metrics, ["timestamp", "metric_name", "model_id"], "event_id")
    return first.select("timestamp", "metric_name", "model_id", "event_id", "value")


def twice(logs: DataFrame) -> DataFrame:
    """Every tenth log delivered twice."""
    return logs.unionByName(logs.where(F.col("event_id") % 10 == 0))


@query("cln_drop_duplicate_logs", f"SELECT event_id, model_id, {TS}, message FROM logs")
def drop_duplicate_logs(t: Tables) -> DataFrame:
    return clean.drop_duplicate_logs(twice(t.logs)).select("event_id", "model_id", "timestamp", "message")


@query("rsh_pivot_metrics", f"SELECT model_id, {TS}, {COLS}, 0.0::DOUBLE AS memory_usage_real FROM wide")
def pivot_metrics(t: Tables) -> DataFrame:
    return clean.pivot_metrics(t.gaps, [*BASIC_METRICS, "memory_usage_real"])


_last = ", ".join(
    f"{r6(f'coalesce(max(value) FILTER (metric_name = $${m}$$), 0)')} AS {m}".replace("$$", "'") for m in BASIC_METRICS
)


@query(
    "rsh_points_per_timestamp",
    f"""
    SELECT model_id, {TS}, {_last}, {r6("max(value) FILTER (metric_name = 'cpu_usage_real')")} AS cpu_usage_real
    FROM (SELECT model_id, timestamp, metric_name, coalesce(value, 0) AS value FROM gaps
          QUALIFY row_number() OVER (PARTITION BY model_id, timestamp, metric_name ORDER BY instance DESC, event_id DESC) = 1)
    GROUP BY model_id, timestamp""",
)
def points_per_timestamp(t: Tables) -> DataFrame:
    rows = t.gaps.withColumnRenamed("event_id", "arrival")
    return clean.points_per_timestamp(rows, [*BASIC_METRICS, "cpu_usage_real"])


@query(
    "rsh_stack",
    f"""
    SELECT {TS}, metric_name, CASE WHEN metric_name = 'cpu_usage_real' THEN NULL ELSE model_id END AS model_id,
           CASE WHEN metric_name = 'cpu_usage_real' THEN instance END AS instance, {r6('avg(value)')} AS value
    FROM metrics GROUP BY ALL""",
)
def stack(t: Tables) -> DataFrame:
    """Means per owner: hosts own their metrics, models the others; one scan."""
    of_host = F.col("metric_name").isin(*HOST_METRICS)
    owned = t.metrics.withColumns(
        {"model_id": F.when(~of_host, F.col("model_id")), "instance": F.when(of_host, F.col("instance"))}
    )
    return clean.dedupe_mean(owned)


def interpolated(metric: str, x: str) -> str:
    """Joins each gap with the known points around it."""
    return f"""(
        SELECT g.model_id, g.timestamp,
               CASE WHEN g.v IS NOT NULL THEN g.v WHEN p.v IS NULL THEN NULL WHEN n.v IS NULL THEN p.v
                    ELSE p.v + (n.v - p.v) * (g.x - p.x) / (n.x - p.x) END AS {metric}
        FROM (SELECT *, max(CASE WHEN v IS NOT NULL THEN rn END) OVER (w ROWS UNBOUNDED PRECEDING) AS pr,
                     min(CASE WHEN v IS NOT NULL THEN rn END) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nr
              FROM pts_{metric} WINDOW w AS (PARTITION BY model_id ORDER BY rn)) g
        LEFT JOIN pts_{metric} p ON p.model_id = g.model_id AND p.rn = g.pr
        LEFT JOIN pts_{metric} n ON n.model_id = g.model_id AND n.rn = g.nr)""".replace("g.x", f"g.{x}").replace("p.x", f"p.{x}").replace("n.x", f"n.{x}")


for _m in BASIC_METRICS:
    view(
        f"pts_{_m}",
        f"""
        SELECT model_id, timestamp, {_m} AS v, row_number() OVER (PARTITION BY model_id ORDER BY timestamp)::DOUBLE AS rn,
               epoch_us(timestamp) / 1e6 AS sec
        FROM wide""",
    )
    view(f"lin_{_m}", "SELECT * FROM " + interpolated(_m, "rn"))
    view(f"tim_{_m}", "SELECT * FROM " + interpolated(_m, "sec"))


def _joined(prefix: str) -> str:
    first, *rest = [f"{prefix}_{m}" for m in BASIC_METRICS]
    return first + "".join(f" JOIN {r} USING (model_id, timestamp)" for r in rest)


@query("cln_interpolate_linear", f"SELECT model_id, {TS}, {COLS} FROM {_joined('lin')}")
def interpolate_linear(t: Tables) -> DataFrame:
    return clean.interpolate(t.wide, BASIC_METRICS)


@query("cln_interpolate_time", f"SELECT model_id, {TS}, {COLS} FROM {_joined('tim')}")
def interpolate_time(t: Tables) -> DataFrame:
    return clean.interpolate(t.wide, BASIC_METRICS, by_time=True)


@query("cln_interpolate_chunked", f"SELECT model_id, {TS}, {COLS} FROM {_joined('tim')}")
def interpolate_chunked(t: Tables) -> DataFrame:
    """As ``cln_interpolate_time``, by chunks of a day: no task holds a series."""
    return clean.interpolate(t.wide, BASIC_METRICS, by_time=True, regular=False, seconds=86400)


view(
    "filled",
    """
    SELECT model_id, metric_name, timestamp,
           coalesce(last_value(value IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                    first_value(value IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
                    avg(value) OVER (PARTITION BY model_id, metric_name)) AS value
    FROM hourly WINDOW w AS (PARTITION BY model_id, metric_name ORDER BY timestamp)""",
)


@query("cln_fill_ffill_bfill_mean", f"SELECT model_id, metric_name, {TS}, {r6('value')} AS value FROM filled")
def fill_gaps(t: Tables) -> DataFrame:
    return clean.fill_gaps(t.hourly)


@query("cln_fill_chunked", f"SELECT model_id, metric_name, {TS}, {r6('value')} AS value FROM filled")
def fill_chunked(t: Tables) -> DataFrame:
    """As ``cln_fill_ffill_bfill_mean``, by chunks of a day."""
    return clean.fill_gaps(t.hourly, regular=False, seconds=86400)


@query("cln_fill_zero", f"SELECT model_id, metric_name, {TS}, {r6('coalesce(value, 0)')} AS value FROM hourly")
def fill_zero(t: Tables) -> DataFrame:
    return clean.fill_zero(t.hourly, ["value"])


@query(
    "cln_cap_outliers_3sigma",
    f"""
    SELECT model_id, metric_name, {TS},
           {r6('CASE WHEN s IS NULL OR value IS NULL THEN value ELSE least(greatest(value, m - 3 * s), m + 3 * s) END')} AS value
    FROM (SELECT *, avg(value) OVER w AS m, stddev_samp(value) OVER w AS s FROM hourly
          WINDOW w AS (PARTITION BY model_id, metric_name))""",
)
def cap_outliers(t: Tables) -> DataFrame:
    return clean.cap_outliers(t.hourly)


view("zeroed", f"SELECT model_id, timestamp, {', '.join(f'coalesce({m}, 0) AS {m}' for m in BASIC_METRICS)} FROM wide")
_lags = [f"lag({m}, {k}) OVER w AS {m}_lag_{k}" for m in BASIC_METRICS for k in range(1, 13)]
_lag_names = [f"{m}_lag_{k}" for m in BASIC_METRICS for k in range(1, 13)]


@query(
    "win_lag_features",
    f"""
    SELECT model_id, {TS}, {', '.join(f'{r6(c)} AS {c}' for c in [*BASIC_METRICS, *_lag_names])}
    FROM (SELECT *, {', '.join(_lags)} FROM zeroed WINDOW w AS (PARTITION BY model_id ORDER BY timestamp))
    WHERE requests_total_lag_12 IS NOT NULL""",
)
def lag_features(t: Tables) -> DataFrame:
    return clean.lag_features(clean.fill_zero(t.wide, BASIC_METRICS), BASIC_METRICS)


def _rolling(c: str, n: int) -> str:
    frame = f"(PARTITION BY model_id ORDER BY timestamp ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({c}) OVER {frame} >= {n} THEN avg({c}) OVER {frame} END"


@query(
    "win_rolling_mean",
    f"""
    SELECT model_id, {TS}, {COLS},
           {', '.join(f"{r6(_rolling(m, n))} AS {m}_lag_{s}" for m in BASIC_METRICS for s, n in (('1h', 12), ('24h', 288)))}
    FROM (SELECT * REPLACE (coalesce(requests_total, 0) AS requests_total) FROM wide)""",
)
def rolling_means(t: Tables) -> DataFrame:
    """One column without gaps; the gaps of the others keep frames from filling."""
    return clean.rolling_means(clean.fill_zero(t.wide, ["requests_total"]), BASIC_METRICS)


_win = "OVER (PARTITION BY model_id)"


def _scaled(m: str) -> str:
    spread = f"(max({m}) {_win} - min({m}) {_win})"
    return r6(f"CASE WHEN {spread} > 0 THEN ({m} - min({m}) {_win}) / {spread} WHEN {m} IS NOT NULL THEN 0 END") + f" AS {m}_normalized"


def _standard(m: str) -> str:
    return r6(f"({m} - avg({m}) {_win}) / CASE WHEN stddev_pop({m}) {_win} > 0 THEN stddev_pop({m}) {_win} ELSE 1 END") + f" AS {m}_z"


@query("nrm_minmax", f"SELECT model_id, {TS}, {COLS}, {', '.join(_scaled(m) for m in BASIC_METRICS)} FROM wide")
def minmax(t: Tables) -> DataFrame:
    return clean.minmax(t.wide, BASIC_METRICS)


@query("nrm_zscore", f"SELECT model_id, {TS}, {COLS}, {', '.join(_standard(m) for m in BASIC_METRICS)} FROM wide")
def zscore(t: Tables) -> DataFrame:
    return clean.zscore(t.wide, BASIC_METRICS)


PRE = list(BASIC_METRICS)


def _pre_views() -> None:
    def fill(c: str) -> str:
        return f"""coalesce(last_value({c} IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
            first_value({c} IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS {c}"""

    def cap(c: str) -> str:
        return f"""CASE WHEN stddev_samp({c}) {_win} IS NULL THEN {c} ELSE least(greatest({c}, avg({c}) {_win} - 3 * stddev_samp({c}) {_win}),
            avg({c}) {_win} + 3 * stddev_samp({c}) {_win}) END AS {c}"""

    view("pre_fill", f"SELECT model_id, timestamp, {', '.join(fill(c) for c in PRE)} FROM wide WINDOW w AS (PARTITION BY model_id ORDER BY timestamp)")
    view("pre_cap", f"SELECT model_id, timestamp, {', '.join(cap(c) for c in PRE)} FROM pre_fill")
    rolled = ", ".join(f"{_rolling(c, n)} AS {c}_{s}" for c in PRE for s, n in (("lag_1h", 12), ("lag_24h", 288)))
    view("pre_roll", f"SELECT *, {rolled} FROM pre_cap")


_pre_views()
_pre_cols = [*PRE, *[f"{c}_{s}" for c in PRE for s in ("lag_1h", "lag_24h")]]


def _norm(c: str) -> str:
    spread = f"(max({c}) {_win} - min({c}) {_win})"
    return r6(f"coalesce(CASE WHEN {spread} > 0 THEN ({c} - min({c}) {_win}) / {spread} END, 0)") + f" AS {c}_normalized"


@query(
    "cln_preprocess",
    f"""
    SELECT model_id, {TS}, hour(timestamp)::INTEGER AS hour, (isodow(timestamp) - 1)::INTEGER AS day_of_week,
           (isodow(timestamp) >= 6)::INTEGER AS is_weekend, month(timestamp)::INTEGER AS month, day(timestamp)::INTEGER AS day,
           {', '.join(f"{r6(f'coalesce({c}, 0)')} AS {c}" for c in _pre_cols)}, {', '.join(_norm(c) for c in _pre_cols)}
    FROM pre_roll""",
)
def preprocess(t: Tables) -> DataFrame:
    """All cleaning steps in one call."""
    return clean.preprocess(t.wide.select("model_id", "timestamp", *PRE), PRE)


def _clipped(m: str) -> str:
    top = "1000000" if m == "requests_total" else "100"
    return f"{r6(f'CASE WHEN {m} IS NOT NULL THEN least(greatest({m}, 0), {top}) END')} AS {m}"


@query("rsh_train_frame", f"SELECT model_id, {TS}, {', '.join(_clipped(m) for m in BASIC_METRICS)} FROM {_joined('lin')}")
def train_frame(t: Tables) -> DataFrame:
    return clean.train_frame(t.gaps)


@query(
    "gen_future_grid",
    f"""
    SELECT model_id, '5min' AS grid, p AS step, {text('last + to_minutes(5 * p)')} AS timestamp
    FROM (SELECT model_id, max(timestamp) AS last FROM metrics GROUP BY model_id), (SELECT unnest(range(6))::INTEGER AS p)
    UNION ALL
    SELECT model_id, '1min', p, {text('last + to_minutes(p)')}
    FROM (SELECT model_id, max(timestamp) AS last FROM metrics GROUP BY model_id), (SELECT unnest(range(1, 31))::INTEGER AS p)""",
)
def future_grid(t: Tables) -> DataFrame:
    five = clean.future_grid(t.metrics, horizon_minutes=30)
    one = clean.future_grid(t.metrics, horizon_minutes=30, step_minutes=1, include_start=False)
    return five.withColumn("grid", F.lit("5min")).unionByName(one.withColumn("grid", F.lit("1min")))
