"""Whole reports in long form (section, column_name, metric, value), over statistics that are computed once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from colsift.operators import correlate, distribution, insights, outliers, patterns, profile, scores
from colsift.operators.profile import long_form
from colsift.plans.stats import TableStats


def _stack(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionAll, frames)


def _texts(section: str, frame: DataFrame, *parts: str) -> DataFrame:
    """Statements as rows: the text is the metric, the value its rank."""
    return frame.select(F.lit(section), F.lit("*"), F.concat_ws(": ", *parts), F.col("rank").cast("double"))


def _pairs(frame: DataFrame, name: str) -> DataFrame:
    return frame.select(F.lit("correlation"), F.concat_ws(" ~ ", "c1", "c2"), F.lit("r"), F.col(name))


def full_report(stats: TableStats) -> DataFrame:
    """Overview, columns, describe, correlations, normality, categories, quality, insights and readiness."""
    stats.need("moments", "shape", "dates").gather("quantiles", "cardinality", "duplicates", "pairs")
    table = profile.overview(stats).withColumn("column_name", F.lit("*"))
    quality = scores.quality_score(stats).withColumn("column_name", F.lit("*"))
    ready = scores.ml_readiness(stats).withColumn("column_name", F.lit("*"))
    described = profile.describe(stats)
    return _stack([
        long_form("overview", table, "column_name", ["total_rows", "total_columns", "numeric_columns",
                                                     "categorical_columns", "datetime_columns"]),
        long_form("columns", profile.column_profile(stats), "column_name",
                  ["non_null_count", "null_count", "null_pct", "unique_values", "uniqueness_ratio"]),
        long_form("describe", described, "column_name", described.columns[2:]),
        _pairs(correlate.strong_pairs(stats), "correlation"),
        long_form("normality", distribution.normality_k2(stats), "column_name", ["p_value"]),
        long_form("categories", profile.category_cardinality(stats), "column_name", ["unique_count", "cardinality_ratio"]),
        long_form("quality", quality, "column_name", ["completeness", "uniqueness", "validity", "overall_score"]),
        _texts("insight", insights.insights(stats), "title", "message"),
        long_form("readiness", ready, "column_name", ["readiness_score"]),
    ])


def quick_analysis(stats: TableStats) -> DataFrame:
    """Overview, deducting score, numeric summary, key insights and recommendations."""
    stats.need("moments", "shape", "text").gather("outliers", "duplicates", "pairs")
    table = profile.overview(stats).withColumn("column_name", F.lit("*"))
    quality = scores.deducting_score(stats).withColumn("column_name", F.lit("*"))
    numeric = profile.numeric_summary(stats)
    return _stack([
        long_form("overview", table, "column_name", ["total_rows", "total_columns", "numeric_columns",
                                                     "categorical_columns", "datetime_columns"]),
        long_form("data_quality", quality, "column_name",
                  ["quality_score", "n_issues", "duplicate_rows", "total_missing_cells"]),
        long_form("summary", numeric, "column_name", numeric.columns[2:]),
        _texts("key_insight", insights.key_insights(stats), "message"),
        _texts("recommendation", insights.recommendations(stats), "message"),
    ])


def comprehensive_analysis(stats: TableStats) -> DataFrame:
    """The quick analysis with high correlations and patterns."""
    stats.need("moments", "shape", "text", "whole", "dates").gather("outliers", "cardinality", "duplicates", "pairs")
    found = patterns.detect_patterns(stats)
    return _stack([
        quick_analysis(stats),
        _pairs(correlate.high_correlations(stats), "correlation"),
        found.select(F.lit("pattern"), "column_name", F.concat_ws(": ", "type", "pattern"), F.lit(1.0)),
    ])


def statistical_analysis(stats: TableStats) -> DataFrame:
    """Descriptive statistics, distributions, fence outliers and normality."""
    stats.need("moments", "shape").gather("outliers", "text_cardinality")
    shapes = distribution.distributions(stats)
    bins = shapes.withColumn("column_name", F.format_string("%s[%d]", "column_name", "bin"))
    return _stack([
        profile.descriptive_stats(stats),
        long_form("histogram", bins, "column_name", ["lower", "upper", "cnt"]),
        long_form("outliers", outliers.iqr_outliers(stats), "column_name",
                  ["outlier_count", "outlier_pct", "lower_bound", "upper_bound"]),
        long_form("normality", distribution.normality_k2_gated(stats), "column_name", ["statistic", "p_value"]),
        long_form("normality", distribution.shapiro(stats), "column_name", ["w", "p_value"]),
    ])


def append_history(result: DataFrame, kind: str, run_id: str, folder: str) -> None:
    """Add a report's rows to the history table with its kind, run and time."""
    (result.withColumns({"type": F.lit(kind), "run_id": F.lit(run_id), "at": F.current_timestamp()})
     .write.mode("append").partitionBy("run_id").parquet(folder))
