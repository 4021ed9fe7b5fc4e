"""Profiles of a table and its columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from colsift.functions.values import is_missing, ref
from colsift.operators.validate import percent
from colsift.plans import frequencies
from colsift.plans.stats import TableStats

DETAIL_PROBS = [0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]


def overview(stats: TableStats) -> DataFrame:
    roles = stats.roles
    rows = [{"total_rows": stats.n_rows, "total_columns": len(stats.df.columns), "numeric_columns": len(roles.numeric),
             "categorical_columns": len(roles.categorical), "datetime_columns": len(roles.datetime),
             "column_names": ",".join(stats.df.columns)}]
    return stats.rows(rows, "total_rows bigint, total_columns bigint, numeric_columns bigint, "
                            "categorical_columns bigint, datetime_columns bigint, column_names string")


def column_profile(stats: TableStats) -> DataFrame:
    """Type, missing and distinct counts of every column; distinct is NULL for arrays, maps and structs."""
    stats.need("nulls").need_cardinality()
    dtypes = {f.name: f.dataType.simpleString() for f in stats.df.schema}
    dtype = F.try_element_at(F.create_map(*[F.lit(x) for kv in dtypes.items() for x in kv]), F.col("column_name"))
    rows = F.lit(stats.n_rows)
    return stats.frame(["n_null", "n_unique"]).select(
        "position", "column_name", dtype.alias("data_type"), (rows - F.col("n_null")).cast("bigint").alias("non_null_count"),
        F.col("n_null").alias("null_count"), F.round(percent(F.col("n_null"), rows), 2).alias("null_pct"),
        F.col("n_unique").alias("unique_values"),
        F.round(F.try_divide(F.col("n_unique").cast("double"), rows.cast("double")), 4).alias("uniqueness_ratio"))


def unbiased_skew(n: Column, skew: Column) -> Column:
    """Sample skewness G1 from the biased g1; 0 for a constant column, NULL below three values."""
    n = n.cast("double")
    return F.when(n > 2, F.coalesce(skew, F.lit(0.0)) * F.sqrt(n * (n - 1)) / (n - 2))


# The labels of distribution_label and concentration_label.
def distribution_label(mean: Column, median: Column, std: Column, skew: Column) -> Column:
    return (F.when(F.abs(mean - median) < std * 0.1, "symmetric (balanced)")
            .when(skew > 1, "right-skewed (tail on right)").when(skew < -1, "left-skewed (tail on left)")
            .otherwise("slightly skewed"))


def numeric_profile(stats: TableStats) -> DataFrame:
    """Per numeric column with values: centre, spread, sample skewness, label, outliers (percent of values)."""
    stats.need("moments", "shape").need_quantiles(0.5).need_outliers()
    names = [c for c in stats.roles.numeric if stats.fact(c, "n")]
    skew = F.coalesce(unbiased_skew(F.col("n"), F.col("skew")), F.lit(0.0))
    std = F.coalesce("std_samp", F.lit(0.0))
    found = stats.frame(["n", "mean", "q0.5", "std_samp", "min", "max", "skew", "n_outlier"], names)
    return found.withColumnRenamed("q0.5", "median").select(
        "position", "column_name", F.round("mean", 2).alias("mean"), F.round("median", 2).alias("median"),
        F.round(std, 2).alias("std_dev"), F.round("min", 2).alias("min"), F.round("max", 2).alias("max"),
        F.round(F.col("max") - F.col("min"), 2).alias("range"), F.round(skew, 2).alias("skewness"),
        distribution_label(F.col("mean"), F.col("median"), std, skew).alias("distribution_type"),
        F.col("n_outlier").alias("outlier_count"), F.round(percent(F.col("n_outlier"), F.col("n")), 2).alias("outlier_pct"))


def concentration_label(top_pct: Column) -> Column:
    return (F.when(top_pct > 50, "highly concentrated").when(top_pct > 25, "moderately concentrated")
            .otherwise("well distributed"))


def categorical_profile(stats: TableStats, k: int = 5) -> DataFrame:
    """Per text column its k top values with the column's distinct count, share of the top value and label."""
    texts = stats.roles.categorical
    stats.need("nulls").need_cardinality(texts, top=k)
    rows = F.lit(stats.n_rows)
    totals = stats.frame(["n_null", "n_unique", "top_count"], texts)
    top = percent(F.col("top_count"), rows - F.col("n_null"))
    return stats.top_values(texts, k).join(F.broadcast(totals), "column_name").select(
        "column_name", "value_rank", "value", "cnt", F.col("n_unique").alias("unique_count"),
        F.round(top, 2).alias("top_pct"), concentration_label(top).alias("concentration"))


def datetime_profile(stats: TableStats) -> DataFrame:
    stats.need("dates")
    names = [c for c in stats.roles.datetime if stats.fact(c, "earliest") is not None]
    days = F.timestamp_diff("DAY", F.col("earliest"), F.col("latest"))
    return stats.frame(["earliest", "latest"], names).select(
        "position", "column_name", "earliest", "latest", days.alias("range_days"),
        F.round(days / 365.25, 2).alias("range_years"))


def describe(stats: TableStats) -> DataFrame:
    """Count, mean, sample deviation, extremes and quartiles per numeric column."""
    stats.need("moments").need_quantiles(0.25, 0.5, 0.75)
    return stats.frame(["n", "mean", "std_samp", "min", "q0.25", "q0.5", "q0.75", "max"], stats.roles.numeric).toDF(
        "position", "column_name", "count", "mean", "std", "min", "p25", "p50", "p75", "max")


def numeric_summary(stats: TableStats) -> DataFrame:
    """Per numeric column with values: population deviation, quartiles, range, IQR, biased skewness and kurtosis."""
    stats.need("moments", "shape").need_quantiles(0.25, 0.5, 0.75)
    names = [c for c in stats.roles.numeric if stats.fact(c, "n")]
    found = stats.frame(["n", "mean", "std_pop", "min", "q0.25", "q0.5", "q0.75", "max", "skew", "kurtosis"], names).toDF(
        "position", "column_name", "count", "mean", "std", "min", "p25", "median", "p75", "max", "skewness", "kurtosis")
    return found.withColumn("range", F.expr("max - min")).withColumn("iqr", F.expr("p75 - p25"))


def categorical_summary(stats: TableStats, k: int = 5) -> DataFrame:
    """Per text column its k top values, distinct count and missing count."""
    texts = stats.roles.categorical
    stats.need("nulls").need_cardinality(texts, top=k)
    totals = stats.frame(["n_unique", "n_null"], texts)
    return totals.join(F.broadcast(stats.top_values(texts, k)), "column_name", "left").select(
        "column_name", "value_rank", "value", "cnt", F.col("n_unique").alias("unique_values"),
        F.col("n_null").alias("missing_values"))


def missing_summary(stats: TableStats) -> DataFrame:
    """Missing per column where there is any, with the table's total and its percent of all cells."""
    cells = F.lit(stats.n_rows * len(stats.df.columns))
    total = F.lit(stats.missing_cells)
    return stats.frame(["n_null"]).filter("n_null > 0").select(
        "position", "column_name", F.col("n_null").alias("missing_count"), total.cast("bigint").alias("total_missing"),
        F.round(percent(total, cells), 2).alias("missing_pct_total"))


def long_form(section: str, frame: DataFrame, key: str, measures: list[str]) -> DataFrame:
    """(section, column_name, metric, value): one row per measure, so that different sections can be stacked."""
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), ref(m).cast("double").alias("value")) for m in measures])
    return frame.select(F.lit(section).alias("section"), ref(key).cast("string").alias("column_name"),
                        F.explode(cells).alias("t")).select("section", "column_name", "t.metric", "t.value")


def descriptive_stats(stats: TableStats) -> DataFrame:
    """Numeric summary, value counts of the text columns and missing summary, stacked."""
    numeric = numeric_summary(stats)
    values = categorical_summary(stats).filter("value is not null")
    values = values.withColumn("column_name", F.concat_ws("=", "column_name", "value"))
    return reduce(DataFrame.unionAll, [
        long_form("numerical", numeric, "column_name", [c for c in numeric.columns if c not in ("position", "column_name")]),
        long_form("categorical", values, "column_name", ["cnt", "unique_values", "missing_values"]),
        long_form("missing", missing_summary(stats), "column_name", ["missing_count", "total_missing", "missing_pct_total"]),
    ])


def column_basic(stats: TableStats, column: str) -> DataFrame:
    """One column: (metric, value) of a numeric one; count, distinct and missing of another."""
    if column not in stats.df.columns:
        raise ValueError(f"unknown column: {column}")
    missing = percent(F.col("n_null"), F.lit(stats.n_rows))
    if column in stats.roles.numeric:
        stats.need("moments").need_quantiles(0.5)
        found = stats.frame(["n", "mean", "std_pop", "min", "max", "q0.5", "n_null"], [column])
        found = found.withColumn("missing_pct", missing).toDF(
            "position", "column_name", "count", "mean", "std", "min", "max", "median", "missing", "missing_pct")
    else:
        stats.need_cardinality([column])
        count = (F.lit(stats.n_rows) - F.col("n_null")).alias("count")
        found = stats.frame(["n_null", "n_unique"], [column]).select(
            "position", "column_name", count, F.col("n_unique").alias("unique_values"),
            F.col("n_null").alias("missing"), missing.alias("missing_pct"))
    kind = "numerical" if column in stats.roles.numeric else "categorical"
    return long_form(kind, found, "column_name", found.columns[2:]).withColumnRenamed("section", "type")


def column_top_values(df: DataFrame, column: str, k: int = 3) -> DataFrame:
    return frequencies.top_values(df, [column], k).select("value_rank", "value", "cnt")


def column_detailed(stats: TableStats, column: str) -> DataFrame:
    """`column_basic` of a numeric column with percentiles, shape, fences and outliers."""
    basic = column_basic(stats, column)
    if column not in stats.roles.numeric or not stats.need("moments").fact(column, "n"):
        return basic
    stats.need("shape").need_quantiles(*DETAIL_PROBS).need_outliers()
    names = {f"q{p:g}": f"p{p * 100:.0f}" for p in DETAIL_PROBS}
    found = stats.frame([*names, "skew", "kurtosis", "n_outlier", "lower", "upper", "n"], [column])
    found = found.select("column_name", *[ref(q).alias(p) for q, p in names.items()], F.col("skew").alias("skewness"),
                         "kurtosis", F.col("n_outlier").alias("outlier_count"),
                         percent(F.col("n_outlier"), F.col("n")).alias("outlier_pct"),
                         F.col("lower").alias("lower_bound"), F.col("upper").alias("upper_bound"))
    more = long_form("numerical", found, "column_name", found.columns[1:]).withColumnRenamed("section", "type")
    return basic.unionAll(more)


def value_counts(df: DataFrame, column: str, n: int | None = None) -> DataFrame:
    """Values of one column by descending count, ties by value; missing excluded."""
    counts = frequencies.frequencies_of(df, column).orderBy(F.desc("cnt"), F.asc("value"))
    return counts if n is None else counts.limit(n)


def category_cardinality(stats: TableStats) -> DataFrame:
    texts = stats.roles.categorical
    ratio = F.try_divide(F.col("n_unique").cast("double"), F.lit(stats.n_rows).cast("double"))
    label = F.when(ratio > 0.5, "very high").when(ratio > 0.1, "high").otherwise("good")
    return stats.need_cardinality(texts).frame(["n_unique"], texts).select(
        "position", "column_name", F.col("n_unique").alias("unique_count"), label.alias("cardinality"),
        F.round(ratio, 4).alias("cardinality_ratio"))


def missing_count(df: DataFrame, column: str) -> int:
    return df.agg(F.count_if(is_missing(ref(column), df.schema[column].dataType))).first()[0]
