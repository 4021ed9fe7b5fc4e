"""Aggregates ready to be drawn."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window, functions as F

from colsift.functions.values import ref
from colsift.operators.correlate import correlation_matrix
from colsift.operators.distribution import histogram
from colsift.operators.validate import outlier_samples
from colsift.plans.stats import TableStats

CHART_COLUMNS = 5
SCATTER_COLUMNS = 3


def histograms(stats: TableStats) -> DataFrame:
    return histogram(stats, stats.roles.numeric[:CHART_COLUMNS], 20)


def _charted(stats: TableStats) -> TableStats:
    names = stats.roles.numeric[:CHART_COLUMNS]
    return TableStats(stats.df.select(*[ref(c) for c in names]), stats.flavor, stats.small_count)


def boxplots(stats: TableStats) -> DataFrame:
    """Five-number summary of the first numeric columns."""
    names = stats.roles.numeric[:CHART_COLUMNS]
    drawn = _charted(stats).need("moments").need_quantiles(0.25, 0.5, 0.75)
    return drawn.frame(["min", "q0.25", "q0.5", "q0.75", "max"], [c for c in names if drawn.fact(c, "n")]).toDF(
        "position", "column_name", "min", "q1", "median", "q3", "max").drop("position")


def boxplot_outliers(stats: TableStats, order_by: list[str], limit: int = 50) -> DataFrame:
    """The first outliers per drawn column in the order of `order_by`."""
    return outlier_samples(stats, order_by, limit).filter(F.col("column_name").isin(stats.roles.numeric[:CHART_COLUMNS]))


def bars(stats: TableStats, k: int = 10) -> DataFrame:
    return stats.top_values(stats.roles.categorical[:CHART_COLUMNS], k)


def heatmap(stats: TableStats) -> DataFrame:
    return correlation_matrix(stats)


def scatter(stats: TableStats, order_by: list[str], limit: int = 500) -> DataFrame:
    """Per pair of the first three numeric columns the first complete points in the order of `order_by`."""
    if not order_by:
        raise ValueError("order_by is required: a DataFrame has no row order")
    keys = [ref(k).alias(f"_k{i}") for i, k in enumerate(order_by)]
    pairs = list(combinations(stats.roles.numeric[:SCATTER_COLUMNS], 2))
    if not pairs:
        return stats.rows([], "x_column string, y_column string, place bigint, x double, y double")
    cells = [F.struct(F.lit(a).alias("x_column"), F.lit(b).alias("y_column"), stats.numeric(a).alias("x"),
                      stats.numeric(b).alias("y")) for a, b in pairs]
    flat = stats.df.select(*keys, F.explode(F.array(*cells)).alias("t")).filter("t.x is not null and t.y is not null")
    # the rank filter is applied before the shuffle as well: each task passes on `limit` points per pair
    order = Window.partitionBy("t.x_column", "t.y_column").orderBy(*[f"_k{i}" for i in range(len(order_by))])
    return (flat.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)
            .select("t.x_column", "t.y_column", F.col("place").cast("bigint").alias("place"), "t.x", "t.y"))
