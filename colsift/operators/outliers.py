"""Outlier counts by fences and by z-score."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from colsift.operators.validate import percent
from colsift.plans.stats import TableStats


def iqr_outliers(stats: TableStats) -> DataFrame:
    """Numeric columns with values outside the fences; the percentage is of the non-missing values."""
    stats.need_outliers()
    names = [c for c in stats.roles.numeric if stats.fact(c, "n_outlier")]
    return stats.frame(["n", "n_outlier", "lower", "upper"], names).select(
        "column_name", F.col("n_outlier").alias("outlier_count"), percent(F.col("n_outlier"), F.col("n")).alias("outlier_pct"),
        F.col("lower").alias("lower_bound"), F.col("upper").alias("upper_bound"))


def zscore_outliers(stats: TableStats) -> DataFrame:
    """Numeric columns with values more than three population standard deviations from the mean."""
    stats.need_outliers()
    names = [c for c in stats.roles.numeric if stats.fact(c, "n_z3")]
    return stats.frame(["n", "n_z3"], names).select(
        "column_name", F.col("n_z3").alias("outlier_count"), percent(F.col("n_z3"), F.col("n")).alias("outlier_pct"))


def outlier_analysis(stats: TableStats) -> DataFrame:
    """Every numeric column with its fence and z-score counts and the table's fence total."""
    stats.need_outliers()
    total = sum(stats.fact(c, "n_outlier") or 0 for c in stats.roles.numeric)
    return stats.frame(["n_outlier", "n_z3"], stats.roles.numeric).select(
        "column_name", F.coalesce("n_outlier", F.lit(0)).alias("n_outliers"), F.coalesce("n_z3", F.lit(0)).alias("n_zscore"),
        F.lit(total).cast("bigint").alias("total_outliers"))


def outlier_advice(stats: TableStats) -> DataFrame:
    """What to do about columns with more than 5 % outliers, or one row saying there is no need."""
    stats.need_outliers()
    names = [c for c in stats.roles.numeric if stats.fact(c, "n") and stats.fact(c, "n_outlier") / stats.fact(c, "n") > 0.05]
    if not names:
        return stats.rows([{"recommendation": "Outliers are minimal - no treatment needed"}],
                          "column_name string, recommendation string")
    text = (F.when(F.col("outlier_pct") > 10,
                   F.format_string("Column '%s' has %.1f%% outliers - use robust methods", "column_name", "outlier_pct"))
            .otherwise(F.format_string("Column '%s' has moderate outliers (%.1f%%)", "column_name", "outlier_pct")))
    return iqr_outliers(stats).filter(F.col("column_name").isin(names)).select("column_name", text.alias("recommendation"))
