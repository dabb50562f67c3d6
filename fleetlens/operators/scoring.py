"""Linear models over feature vectors: fit and batch scoring."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def linear_fit(df: DataFrame, features: str = "features", label: str = "label") -> LinearRegressionModel:
    """Least squares on an array column."""
    rows = df.select(array_to_vector(F.col(features).cast("array<double>")).alias("x"), F.col(label).cast("double").alias("y"))
    return LinearRegression(featuresCol="x", labelCol="y", solver="normal").fit(rows)


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, p: total + p)


def batch_score(requests: DataFrame, models: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Prediction of the model each request names, or the error it is answered with.

    ``requests``: model_id, features. ``models``: model_id, coefficients, intercept.
    """
    known = models.select("model_id", "coefficients", "intercept")
    joined = requests.join(known, "model_id", "left")
    error = (
        F.when(F.col("model_id").isNull(), "Missing model_id")
        .when(F.col("coefficients").isNull(), "Model not registered")
        .when(F.col("features").isNull(), "Missing features in request")
        .when(F.size("features") != F.size("coefficients"), "Feature count mismatch")
    )
    score = dot(F.col("coefficients"), F.col("features")) + F.col("intercept")
    return joined.withColumn("error", error).select(
        "model_id",
        *keep,
        F.when(F.col("error").isNull(), score).alias("prediction"),
        "error",
        F.when(F.col("error").isNull(), 200)
        .when(F.col("error") == "Model not registered", 404)
        .when(F.col("error").startswith("Missing"), 400)
        .otherwise(500)
        .alias("status_code"),
    )
