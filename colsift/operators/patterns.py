"""Patterns in dates, categories, numbers and missing values, as (type, column_name, pattern)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from colsift.operators.correlate import missing_cooccurrence
from colsift.operators.validate import percent
from colsift.plans.stats import TableStats

SCHEMA = "type string, column_name string, pattern string"


def _labelled(frame: DataFrame, kind: str, *labels) -> DataFrame:
    """One row per label that applies."""
    found = frame.select(F.lit(kind).alias("type"), "column_name", F.explode(F.array_compact(F.array(*labels))).alias("pattern"))
    return found


def temporal_gaps(stats: TableStats) -> DataFrame:
    """Mean gap in days of the sorted values: (latest - earliest) / (n - 1), no sort needed."""
    stats.need("dates")
    names = [c for c in stats.roles.datetime if stats.n_rows - stats.fact(c, "n_null") > 1]
    span = F.timestamp_diff("MICROSECOND", F.col("earliest"), F.col("latest")) / 86_400_000_000
    return stats.frame(["earliest", "latest", "n_null"], names).select(
        "column_name", (span / (F.lit(stats.n_rows) - F.col("n_null") - 1)).alias("mean_gap_days"))


def temporal_patterns(stats: TableStats) -> DataFrame:
    gap = F.col("mean_gap_days")
    inside = lambda low, high: (gap > low) & (gap < high)
    return _labelled(temporal_gaps(stats), "temporal", F.when(inside(0.9, 1.1), "daily frequency")
                     .when(inside(6.5, 7.5), "weekly frequency").when(inside(28, 32), "monthly frequency"))


def categorical_patterns(stats: TableStats) -> DataFrame:
    texts = stats.roles.categorical
    stats.need("nulls").need_cardinality(texts)
    top = percent(F.col("top_count"), F.lit(stats.n_rows) - F.col("n_null"))
    even = (F.col("n_unique") > 5) & (F.col("top_count") / F.col("low_count") < 2)
    return _labelled(stats.frame(["n_null", "n_unique", "top_count", "low_count"], texts), "categorical",
                     F.when(top > 80, F.format_string("dominated by one category (%.1f%%)", top)),
                     F.when(even, "relatively uniform distribution"))


def numeric_patterns(stats: TableStats) -> DataFrame:
    names = stats.roles.numeric
    stats.need("moments", "whole").need_cardinality(names)
    found = stats.frame(["n", "n_whole", "n_unique"], names).filter("n > 10")
    return _labelled(found, "numerical", F.when(F.col("n_whole") / F.col("n") > 0.8, "mostly whole numbers"),
                     F.when(F.col("n_unique") == 1, "constant value").when(F.col("n_unique") == 2, "binary"))


def missing_patterns(stats: TableStats) -> DataFrame:
    if not stats.missing_cells:
        return stats.rows([], SCHEMA)
    return missing_cooccurrence(stats).select(
        F.lit("missing").alias("type"), F.col("c1").alias("column_name"),
        F.format_string("missing values occur together with '%s'", "c2").alias("pattern"))


KINDS = {"temporal": temporal_patterns, "categorical": categorical_patterns, "numerical": numeric_patterns,
         "missing": missing_patterns}


def detect_patterns(stats: TableStats, kind: str = "all") -> DataFrame:
    if kind != "all" and kind not in KINDS:
        raise ValueError(f"unknown pattern type: {kind}")
    found = stats.rows([], SCHEMA)
    for name, operator in KINDS.items():
        if kind in ("all", name):
            found = found.unionAll(operator(stats))
    return found
