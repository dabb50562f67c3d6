"""Forecasting and model scoring."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.catalog.registry import query
from fleetlens.catalog.sql import r6, text, view
from fleetlens.catalog.tables import Tables
from fleetlens.functions.scalars import literal_map, moment
from fleetlens.functions.timeline import matched
from fleetlens.operators import forecast, scoring
from fleetlens.operators.clean import fill_gaps
from fleetlens.schemas import BASIC_METRICS, FORECAST_FLOORS, VALUE_RANGES
from fleetlens.session import fresh_folder, shared_folder

TS = f"{text('timestamp')} AS timestamp"


BASE = forecast.SEASONS[:2]


def _terms_sql(seasons: forecast.Seasons, sec: str = "sec", t: str = "t") -> str:
    waves = [f"{fn}(2 * pi() * {k} * ({sec} % {period}) / {period})" for period, order in seasons for k in range(1, order + 1) for fn in ("sin", "cos")]
    return f"[1, ({t} - center) / scale, {', '.join(waves)}]"


view(
    "timed",
    """
    SELECT *, avg(t) OVER s AS center, CASE WHEN var_pop(t) OVER s > 0 THEN sqrt(var_pop(t) OVER s) ELSE 1 END AS scale,
           count(*) OVER s AS points, max(timestamp) OVER s AS last_time
    FROM (SELECT model_id, metric_name, timestamp, value AS y, epoch_us(timestamp) / 86400e6::DOUBLE AS t, epoch_us(timestamp) // 1000000 // 300 * 300 AS sec
          FROM hourly WHERE value IS NOT NULL) WINDOW s AS (PARTITION BY model_id, metric_name)""",
)


# A ridge fit meets its normal equations: for each term x, sum(x * fitted) + penalty * coefficient = sum(x * observed).
def moments_sql(seasons: forecast.Seasons) -> str:
    return f"""
    SELECT model_id, metric_name, any_value(points) AS points, {text('any_value(last_time)')} AS last_time, (i - 1)::INTEGER AS term, {r6('avg(x * y)')} AS moment
    FROM (SELECT model_id, metric_name, points, last_time, y, unnest(terms)::DOUBLE AS x, generate_subscripts(terms, 1) AS i
          FROM (SELECT *, {_terms_sql(seasons)} AS terms FROM timed WHERE points >= 8))
    GROUP BY model_id, metric_name, i"""


def _moments(t: Tables, fits: DataFrame, seasons: forecast.Seasons) -> DataFrame:
    """Size and end of each fit with the left side of its normal equations over the observed times."""
    rows = t.hourly.where("value IS NOT NULL").join(fits, ["model_id", "metric_name"])
    terms = forecast.model_terms("timestamp", seasons=seasons)
    fitted = F.aggregate(F.zip_with("coefficients", "x", lambda b, x: b * x), F.lit(0.0), lambda a, x: a + x)
    rows = rows.withColumn("x", terms).select("model_id", "metric_name", "points", "last_time", fitted.alias("yhat"), F.posexplode(F.arrays_zip("x", "coefficients")).alias("term", "z"))
    penalty = F.when(F.col("term") > 0, F.first("z.coefficients") * forecast.RIDGE / F.first("points")).otherwise(0.0)
    keys = ["model_id", "metric_name", "points", "last_time", "term"]
    return rows.groupBy(*keys).agg((F.avg(F.col("z.x") * F.col("yhat")) + penalty).alias("moment"))


@query("fc_seasonal_fit", moments_sql(forecast.SEASONS_24_DAYS))
def seasonal_fit(t: Tables) -> DataFrame:
    """Day, week, year and 24 days, whatever the series span."""
    seasons = forecast.SEASONS_24_DAYS
    return _moments(t, forecast.seasonal_fit(t.hourly, seasons=seasons, whole_cycles=False), seasons)


def solved_sql(source: str, seasons: forecast.Seasons) -> tuple[str, str]:
    """Steps of a ridge fit of ``source`` (as ``timed``) by elimination, as views for a WITH, and the name of the last: its column v at
    j = number of terms are the coefficients."""
    n = 2 + 2 * sum(order for _, order in seasons)
    steps = [
        f"""terms AS MATERIALIZED (
        SELECT model_id, metric_name, y, {_terms_sql(seasons)} AS x FROM {source} WHERE points >= 8
    ), sums_0 AS MATERIALIZED (
        SELECT model_id, metric_name, i, j, sum(CASE WHEN j = {n} THEN y ELSE x[j + 1] END * x[i + 1]::DOUBLE) + CASE WHEN i = j AND i > 0 THEN {forecast.RIDGE}::DOUBLE ELSE 0 END AS v
        FROM terms, (SELECT unnest(range({n})) AS i), (SELECT unnest(range({n + 1})) AS j) GROUP BY model_id, metric_name, i, j)"""
    ]
    for p in range(n):
        steps.append(
            f"""sums_{p + 1} AS MATERIALIZED (
        SELECT r.model_id, r.metric_name, r.i, r.j, CASE WHEN r.i = {p} THEN r.v / d.v ELSE r.v - c.v * q.v / d.v END AS v
        FROM sums_{p} r JOIN sums_{p} d ON (r.model_id, r.metric_name, {p}, {p}) = (d.model_id, d.metric_name, d.i, d.j)
        JOIN sums_{p} c ON (r.model_id, r.metric_name, r.i, {p}) = (c.model_id, c.metric_name, c.i, c.j)
        JOIN sums_{p} q ON (r.model_id, r.metric_name, {p}, r.j) = (q.model_id, q.metric_name, q.i, q.j))"""
        )
    steps.append(
        f"""fitted AS MATERIALIZED (
        SELECT model_id, metric_name, list(v ORDER BY i) AS b FROM sums_{n} WHERE j = {n} GROUP BY model_id, metric_name)"""
    )
    return ",\n".join(steps), "fitted"


def forecast_sql(source: str, seasons: forecast.Seasons, points: int = 6) -> str:
    """Forecasts of the next half hour (yhat, sigma, not rounded) from a fit made in SQL."""
    views, fitted = solved_sql(source, seasons)
    dot = "list_dot_product(b, {}::DOUBLE[])"
    return f"""
    WITH {views}, noise AS (
        SELECT model_id, metric_name, sqrt(avg((y - {dot.format('x')}) ** 2)) AS sigma FROM terms JOIN {fitted} USING (model_id, metric_name) GROUP BY model_id, metric_name
    )
    SELECT model_id, metric_name, ahead AS timestamp, {dot.format(_terms_sql(seasons, 'epoch_us(ahead) // 1000000 // 300 * 300', '(epoch_us(ahead) / 86400e6::DOUBLE)'))} AS yhat, sigma
    FROM (SELECT *, last_time + to_minutes(5 * p) AS ahead
          FROM (SELECT DISTINCT model_id, metric_name, center, scale, last_time FROM {source} WHERE points >= 8), (SELECT unnest(range({points}))::INTEGER AS p))
    JOIN {fitted} USING (model_id, metric_name) JOIN noise USING (model_id, metric_name)"""


FLOOR_SQL = "CASE metric_name " + " ".join(f"WHEN '{m}' THEN {v}::DOUBLE" for m, v in FORECAST_FLOORS.items()) + " ELSE 0 END"


@query(
    "fc_seasonal_predict",
    f"""
    SELECT model_id, metric_name, {TS}, round(y, 4) AS yhat, round(least(lo, y), 4) AS yhat_lower, round(greatest(hi, y, lo), 4) AS yhat_upper
    FROM (SELECT *, greatest(yhat, {FLOOR_SQL}) AS y, greatest(yhat - 1.96 * sigma, {FLOOR_SQL}) AS lo, greatest(yhat + 1.96 * sigma, {FLOOR_SQL}) AS hi
          FROM ({forecast_sql('timed', BASE)}))""",
)
def seasonal_predict(t: Tables) -> DataFrame:
    """Forecasts to four decimals, as its twin solves the same equations in another order."""
    shown = forecast.postprocess(forecast.seasonal_predict(forecast.seasonal_fit(t.hourly)))
    return shown.withColumns({c: F.round(c, 4) for c in ("yhat", "yhat_lower", "yhat_upper")})


@query(
    "fc_postprocess",
    f"""
    SELECT model_id, metric_name, {TS}, {r6('y')} AS yhat, {r6('least(lo, y)')} AS yhat_lower, {r6('greatest(hi, y, lo)')} AS yhat_upper
    FROM (SELECT *, greatest(value - 20, {FLOOR_SQL}) AS y, greatest(value - 10, {FLOOR_SQL}) AS lo, greatest(value - 30, {FLOOR_SQL}) AS hi
          FROM hourly WHERE value IS NOT NULL)""",
)
def postprocess(t: Tables) -> DataFrame:
    """Forecasts whose bounds lie on the wrong sides."""
    rows = t.hourly.where("value IS NOT NULL").select(
        "model_id",
        "metric_name",
        "timestamp",
        (F.col("value") - 20).alias("yhat"),
        (F.col("value") - 10).alias("yhat_lower"),
        (F.col("value") - 30).alias("yhat_upper"),
    )
    return forecast.postprocess(rows)


# A forest is no SQL. Its twins have what is exact: the grid, the series with a forecast, means where rows are few, zeros where
# a metric is absent, and that a forecast stays inside what its series' mean and deviation make of the values it was trained on.
FORESTED = (*BASIC_METRICS, "cpu_usage_real", "memory_usage_real")
MANY = 100
view(
    "forested",
    f"""
    SELECT *, count(*) OVER s AS n, avg(value) OVER s AS level, CASE WHEN stddev_pop(value) OVER s > 0 THEN stddev_pop(value) OVER s ELSE 1 END AS spread
    FROM filled WHERE metric_name IN ({', '.join(f"'{m}'" for m in FORESTED)}) WINDOW s AS (PARTITION BY model_id, metric_name)""",
)
view("forest_rows", "SELECT *, (value - level) / spread AS z, row_number() OVER (PARTITION BY model_id, metric_name ORDER BY timestamp) AS nth FROM forested")
_wanted = "(SELECT unnest([" + ", ".join(f"'{m}'" for m in FORESTED) + "]) AS metric_name)"


def _within(df: DataFrame, rows: DataFrame, ranges: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """For forecasts of trained series, whether they lie inside what they can be; ``rows`` are the rows trained on."""
    scale = rows.groupBy(*forecast.SERIES).agg(F.first("level").alias("level"), F.first("spread").alias("spread"))
    low, high = (rows.agg(f("z")).scalar() for f in (F.min, F.max))
    low, high = (F.col("level") + F.col("spread") * z for z in (low, high))
    if ranges:
        floor, top = (F.element_at(literal_map({m: r[i] for m, r in ranges.items()}), F.col("metric_name")) for i in (0, 1))
        low, high = F.greatest(low, floor), F.least(high, top)
    joined = matched(df, scale, forecast.SERIES, "left")
    return joined.withColumn("within", F.col("yhat").between(low - 1e-6, high + 1e-6)).drop("level", "spread")


def _long(wide: DataFrame) -> DataFrame:
    return wide.unpivot(["model_id", "timestamp"], list(FORESTED), "metric_name", "yhat")


def _trained(t: Tables) -> DataFrame:
    scale = forecast.series_scale(fill_gaps(t.hourly), FORESTED)
    return matched(fill_gaps(t.hourly), scale, forecast.SERIES).withColumn("z", (F.col("value") - F.col("level")) / F.col("spread"))


@query(
    "fc_forest_fit_predict",
    f"""
    SELECT g.model_id, {text('g.last + to_minutes(p)')} AS timestamp, w.metric_name,
           CASE WHEN n >= {MANY} THEN NULL ELSE {r6('coalesce(level, 0)')} END AS level,
           CASE WHEN n >= {MANY} THEN true END AS within
    FROM (SELECT model_id, max(timestamp) AS last FROM forested GROUP BY model_id) g, (SELECT unnest(range(1, 31))::INTEGER AS p), {_wanted} w
    LEFT JOIN (SELECT model_id, metric_name, any_value(n) AS n, any_value(level) AS level FROM forested GROUP BY ALL) s
      ON s.model_id = g.model_id AND s.metric_name = w.metric_name""",
)
def forest_forecast(t: Tables) -> DataFrame:
    """Grid, means of series with few rows, zeros of absent metrics; whether forecasts are possible values."""
    shown = _long(forecast.to_wide(forecast.forest_forecast(fill_gaps(t.hourly), FORESTED, min_rows=MANY), FORESTED))
    judged = _within(shown, _trained(t).where(F.col("rows") >= MANY))
    return judged.select("model_id", "timestamp", "metric_name", F.when(F.col("within").isNull(), F.col("yhat")).alias("level"), "within")


@query(
    "fc_forest_lag_recursive",
    f"""
    SELECT model_id, {text('last + to_minutes(5 * p)')} AS timestamp, metric_name, true AS within
    FROM (SELECT model_id, metric_name, max(timestamp) AS last FROM forest_rows WHERE nth > 12 GROUP BY ALL), (SELECT unnest(range(1, 31))::INTEGER AS p)""",
)
def forest_recursive(t: Tables) -> DataFrame:
    """Thirty steps of every metric; whether each is a possible value."""
    shared_folder(t.spark)
    steps = forecast.forest_recursive(fill_gaps(t.hourly), FORESTED)
    return _within(steps, _trained(t), VALUE_RANGES).drop("yhat")


view(
    "last_hour",
    "SELECT model_id, metric_name, max(timestamp) AS last, avg(value) AS mean FROM hourly GROUP BY model_id, metric_name",
)


@query(
    "fc_mean_fallback",
    f"""
    SELECT model_id, metric_name, {text('last + to_minutes(p)')} AS timestamp, {r6('mean')} AS yhat,
           {r6('mean * 0.9')} AS yhat_lower, {r6('mean * 1.1')} AS yhat_upper
    FROM last_hour, (SELECT unnest(range(1, 31))::INTEGER AS p)""",
)
def mean_fallback(t: Tables) -> DataFrame:
    return forecast.mean_forecast(t.hourly)


@query(
    "fc_override_latest_real",
    f"""
    SELECT model_id, metric_name, {text('last + to_minutes(p)')} AS timestamp,
           {r6("CASE WHEN metric_name = 'cpu_usage_real' THEN newest ELSE mean END")} AS yhat
    FROM last_hour JOIN (SELECT model_id, metric_name, arg_max(value, timestamp) AS newest FROM hourly
                         WHERE value IS NOT NULL GROUP BY ALL) USING (model_id, metric_name),
         (SELECT unnest(range(1, 31))::INTEGER AS p)""",
)
def override_latest(t: Tables) -> DataFrame:
    return forecast.override_latest(forecast.mean_forecast(t.hourly), t.hourly).select("model_id", "metric_name", "timestamp", "yhat")


@query(
    "fc_flat_from_latest",
    f"""
    SELECT model_id, metric_name, 'latest' AS kind, 0 AS anchor, p AS point, {text("TIMESTAMP '2024-01-31' + to_minutes(5 * p)")} AS timestamp, value
    FROM (SELECT model_id, metric_name, arg_max(value, event_id) AS value FROM metrics GROUP BY ALL), (SELECT unnest(range(5))::INTEGER AS p)
    UNION ALL
    SELECT model_id, metric_name, 'history', a, p, {text("TIMESTAMP '2024-01-31' - to_minutes(15 * a) + to_minutes(5 * p)")}, value
    FROM (SELECT model_id, metric_name, arg_max(value, event_id) AS value FROM metrics GROUP BY ALL),
         (SELECT unnest(range(5))::INTEGER AS a), (SELECT unnest(range(3))::INTEGER AS p)""",
)
def flat_from_latest(t: Tables) -> DataFrame:
    as_of = moment("2024-01-31")
    now = forecast.flat_from_latest(t.metrics, as_of, tie="event_id").withColumn("kind", F.lit("latest"))
    past = forecast.flat_from_latest(t.metrics, as_of, anchors=5, points=3, tie="event_id").withColumn("kind", F.lit("history"))
    return now.unionByName(past)


@query(
    "fc_flat_allocation",
    f"""
    SELECT model_id, 100.0::DOUBLE AS cpu_allocation, 1024.0::DOUBLE AS memory_allocation, 1024.0::DOUBLE AS network_allocation,
           {r6("coalesce(max(value) FILTER (metric_name = 'cpu_usage_real'), 0)")} AS utilization_cpu,
           0.0::DOUBLE AS utilization_memory, 0.0::DOUBLE AS utilization_network
    FROM (SELECT model_id, metric_name, arg_max(value, event_id) AS value FROM metrics GROUP BY ALL) GROUP BY model_id""",
)
def flat_allocation(t: Tables) -> DataFrame:
    """The allocation shown beside a flat forecast."""
    return forecast.flat_allocation(t.metrics, tie="event_id")


@query("fc_model_store", moments_sql(BASE))
def model_store(t: Tables) -> DataFrame:
    """Two fits are stored; the newer one is loaded and used."""
    path = fresh_folder(t.spark, "fits")
    early = t.hourly.where(F.col("timestamp") < moment("2024-01-15"))
    forecast.save_fits(forecast.seasonal_fit(early), path, "2024-01-15")
    forecast.save_fits(forecast.seasonal_fit(t.hourly), path, "2024-01-31")
    return _moments(t, forecast.load_fits(t.spark, path), BASE)


@query(
    "ml_linear_fit",
    f"""
    SELECT 'x' || (i - 1) AS term, {r6('avg(x * label)')} AS moment
    FROM (SELECT label::DOUBLE AS label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY i
    UNION ALL SELECT 'intercept', {r6('avg(label::DOUBLE)')} FROM embeddings""",
)
def linear_fit(t: Tables) -> DataFrame:
    """Mean of prediction times each feature. Least squares makes it that of label times feature."""
    model = scoring.linear_fit(t.vectors)
    fitted = t.spark.createDataFrame([([float(w) for w in model.coefficients], float(model.intercept))], "w ARRAY<DOUBLE>, b DOUBLE")
    models = fitted.select(F.lit("all").alias("model_id"), F.col("w").alias("coefficients"), F.col("b").alias("intercept"))
    scored = scoring.batch_score(t.vectors.withColumn("model_id", F.lit("all")), models, ["features"])
    terms = scored.select("prediction", F.posexplode("features").alias("i", "x"))
    moments = terms.groupBy(F.concat(F.lit("x"), F.col("i").cast("string")).alias("term")).agg(F.avg(F.col("x") * F.col("prediction")).alias("moment"))
    return moments.unionByName(scored.agg(F.lit("intercept").alias("term"), F.avg("prediction").alias("moment")))


view(
    "weights",
    """
    SELECT model_id, i, avg(x * label) AS w
    FROM (SELECT 'm' || (vec_id % 8) AS model_id, label::DOUBLE AS label, unnest(embedding)::DOUBLE AS x,
                 generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL""",
)
view(
    "asked",
    """
    SELECT vec_id, 'm' || (vec_id % 10) AS model_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings""",
)


@query(
    "ml_batch_score",
    f"""
    SELECT a.model_id, vec_id, {r6('CASE WHEN vec_id % 13 <> 0 THEN sum(x * w) + 0.5 END')} AS prediction,
           CASE WHEN count(w) = 0 THEN 'Model not registered' WHEN vec_id % 13 = 0 THEN 'Feature count mismatch' END AS error,
           CASE WHEN count(w) = 0 THEN 404 WHEN vec_id % 13 = 0 THEN 500 ELSE 200 END AS status_code
    FROM asked a LEFT JOIN weights b ON a.model_id = b.model_id AND a.i = b.i GROUP BY a.model_id, vec_id""",
)
def batch_score(t: Tables) -> DataFrame:
    """Some requests name unknown models, some bring too few features."""
    cut = F.when(F.col("vec_id") % 13 == 0, F.slice("features", 1, 10)).otherwise(F.col("features"))
    return scoring.batch_score(t.vectors.withColumn("features", cut), t.linear_models, ["vec_id"])


def _fit_mean(pdf: pd.DataFrame) -> dict[str, float]:
    return {"mean": float(pdf["value"].mean()), "last": float(pdf.sort_values("timestamp")["value"].iloc[-1])}


def _predict_mean(model: dict[str, float], pdf: pd.DataFrame) -> pd.DataFrame:
    first = pdf.iloc[0]
    return pd.DataFrame(
        {"model_id": [first["model_id"]], "metric_name": [first["metric_name"]], "forecast": [0.5 * (model["mean"] + model["last"])], "n": [len(pdf)]}
    )


@query(
    "udf_custom_model",
    f"""
    SELECT model_id, metric_name, {r6('0.5 * (avg(value) + arg_max(value, timestamp))')} AS forecast, count(*) AS n
    FROM filled GROUP BY model_id, metric_name""",
)
def custom_model(t: Tables) -> DataFrame:
    """A user's model per series: half the mean, half the last value."""
    schema = "model_id STRING, metric_name STRING, forecast DOUBLE, n BIGINT"
    return forecast.series_model(fill_gaps(t.hourly), _fit_mean, _predict_mean, schema)


def _norm(pdf: pd.DataFrame) -> pd.DataFrame:
    vectors = np.stack(pdf["features"].to_numpy()) if len(pdf) else np.empty((0, 0))
    return pd.DataFrame({"vec_id": pdf["vec_id"], "score": (vectors * vectors).sum(axis=1)})


@query(
    "udf_row_scorer",
    f"SELECT vec_id, {r6('list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))')} AS score FROM embeddings",
)
def row_scorer(t: Tables) -> DataFrame:
    """A user's scorer over Arrow batches: the squared length of each vector."""
    return forecast.score_rows(t.vectors.select("vec_id", "features"), _norm, "vec_id BIGINT, score DOUBLE")
