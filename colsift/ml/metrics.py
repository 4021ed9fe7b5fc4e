"""Scores of predictions, from a table of (label, prediction)."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F


def classification_metrics(predictions: DataFrame) -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1; a class without predictions has precision 0."""
    counts = predictions.groupBy("label", "prediction").agg(F.count("*").alias("cnt"))
    # from here on one row per pair of classes
    hit = F.when(F.col("label") == F.col("prediction"), F.col("cnt")).otherwise(0)
    actual = counts.groupBy(F.col("label").alias("class")).agg(F.sum("cnt").alias("support"), F.sum(hit).alias("hits"))
    predicted = counts.groupBy(F.col("prediction").alias("class")).agg(F.sum("cnt").alias("predicted"))
    per_class = actual.join(predicted, "class", "left").select(
        "support", "hits", F.coalesce(F.try_divide("hits", "predicted"), F.lit(0.0)).alias("precision"),
        F.try_divide("hits", "support").alias("recall"))
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    n = F.sum("support")
    return per_class.withColumn("f1", f1).agg(
        F.try_divide(F.sum("hits"), n).alias("accuracy"),
        F.try_divide(F.sum(F.col("precision") * F.col("support")), n).alias("precision"),
        F.try_divide(F.sum(F.col("recall") * F.col("support")), n).alias("recall"),
        F.try_divide(F.sum(F.col("f1") * F.col("support")), n).alias("f1_score"))


def regression_metrics(predictions: DataFrame) -> DataFrame:
    """Mean squared error, its root, R2 and mean absolute error."""
    error = F.col("label") - F.col("prediction")
    mse = F.avg(error * error)
    return predictions.agg(mse.alias("mse"), F.avg(F.abs(error)).alias("mae"), F.var_pop("label").alias("var")).select(
        "mse", F.sqrt("mse").alias("rmse"), (1 - F.try_divide("mse", "var")).alias("r2"), "mae")


def clustering_metrics(predictions: DataFrame, features: str, centres: list) -> DataFrame:
    """The sum of squared distances to the rows' own centres, and how many clusters have rows."""
    table = F.array(*[F.array(*[F.lit(float(v)) for v in centre]) for centre in centres])
    own = F.element_at(table, F.col("prediction") + 1)
    squares = F.aggregate(F.zip_with(vector_to_array(features), own, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, d: s + d)
    return predictions.agg(F.sum(squares).alias("inertia"), F.count_distinct("prediction").alias("n_clusters"))
