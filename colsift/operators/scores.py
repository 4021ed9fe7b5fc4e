"""Quality scores, readiness for modelling, target candidates and problem type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from colsift.functions.values import ref
from colsift.operators.validate import has_word
from colsift.plans.frequencies import countable, frequencies_of
from colsift.plans.stats import TableStats

# Name parts that mark a column as a likely prediction target.
TARGET_WORDS = ["target", "label", "class", "category", "outcome", "result", "prediction", "fraud", "churn", "price",
                "sales", "revenue", "risk"]

# The three models suggested per problem type, simplest first.
SUGGESTED_MODELS = {
    "Regression": ["Linear Regression", "Random Forest Regressor", "XGBoost Regressor"],
    "Binary Classification": ["Logistic Regression", "Random Forest Classifier", "XGBoost Classifier"],
    "Multi-Class Classification": ["Logistic Regression (Multi-class)", "Random Forest Classifier", "XGBoost Classifier"],
}

# The next step per readiness check that warned or failed.
NEXT_STEPS = {
    ("Missing Values", "fail"): "Fill or remove missing values using data cleaning tools",
    ("Numeric Features", "fail"): "Convert categorical columns to numbers (encoding)",
    ("Duplicates", "warning"): "Remove duplicate rows",
    ("Sample Size", "warning"): "Consider collecting more data if possible",
    ("Categorical Encoding", "warning"): "Encode categorical columns (one-hot or label encoding)",
}


def _table_facts(stats: TableStats) -> DataFrame:
    """One row: rows, cells, missing cells, duplicates and column counts."""
    stats.need("nulls")
    rows = [{"n_rows": stats.n_rows, "n_cells": stats.n_rows * len(stats.df.columns), "n_missing": stats.missing_cells,
             "n_duplicate": stats.duplicate_rows, "n_numeric": len(stats.roles.numeric),
             "n_text": len(stats.roles.categorical)}]
    return stats.rows(rows, "n_rows bigint, n_cells bigint, n_missing bigint, n_duplicate bigint, n_numeric bigint, "
                            "n_text bigint")


def grade(score: Column) -> Column:
    return (F.when(score >= 90, "A (Excellent)").when(score >= 80, "B (Good)").when(score >= 70, "C (Fair)")
            .when(score >= 60, "D (Poor)").otherwise("F (Failing)"))


def quality_score(stats: TableStats) -> DataFrame:
    """Completeness, uniqueness and validity in percent, weighted 0.4 / 0.3 / 0.3, with a grade.

    Columns are typed, so every numeric column passes the numeric check and validity is 100.
    """
    completeness = F.try_divide((F.col("n_cells") - F.col("n_missing")).cast("double"), F.col("n_cells").cast("double")) * 100
    uniqueness = F.try_divide((F.col("n_rows") - F.col("n_duplicate")).cast("double"), F.col("n_rows").cast("double")) * 100
    scored = _table_facts(stats).select(completeness.alias("c"), uniqueness.alias("u"), F.lit(100.0).alias("v"))
    overall = F.col("c") * 0.4 + F.col("u") * 0.3 + F.col("v") * 0.3
    return scored.select(F.round("c", 2).alias("completeness"), F.round("u", 2).alias("uniqueness"),
                         F.round("v", 2).alias("validity"), F.round(overall, 2).alias("overall_score"),
                         grade(overall).alias("grade"))


# How each issue is worded.
ISSUES = {
    "critical": "Column '%s' has %.1f%% missing values (critical)",
    "missing": "Column '%s' has %.1f%% missing values",
    "minor": "Column '%s' has %.1f%% missing values (minor)",
    "duplicates": "Found %d duplicate rows (%.1f%%)",
    "numeric_text": "Column '%s' appears to be numeric but stored as text",
}


def quality_issues(stats: TableStats) -> DataFrame:
    """What lowers the deducting score: (position, column_name, issue, deduction)."""
    stats.need("text")
    pct = F.col("n_null") * 100.0 / F.lit(stats.n_rows)
    gaps = stats.frame(["n_null"]).filter((F.col("n_null") > 0) & (pct > 5)).select(
        "position", "column_name",
        F.when(pct > 50, F.format_string(ISSUES["critical"], "column_name", pct))
        .when(pct > 20, F.format_string(ISSUES["missing"], "column_name", pct))
        .otherwise(F.format_string(ISSUES["minor"], "column_name", pct)).alias("issue"),
        F.when(pct > 50, 15).when(pct > 20, 10).otherwise(5).cast("bigint").alias("deduction"))
    repeated = _table_facts(stats).filter("n_duplicate > 0").select(
        F.lit(None).cast("bigint"), F.lit("*"),
        F.format_string(ISSUES["duplicates"], "n_duplicate", F.expr("n_duplicate * 100.0D / n_rows")),
        F.lit(10).cast("bigint"))
    stored = stats.frame(["n_not_number"], stats.roles.categorical).filter("n_not_number = 0").select(
        "position", "column_name", F.format_string(ISSUES["numeric_text"], "column_name"),
        F.lit(5).cast("bigint"))
    return gaps.unionAll(repeated).unionAll(stored)


def deducting_score(stats: TableStats) -> DataFrame:
    """100 minus the deductions, at least 0, with the number of issues."""
    return quality_issues(stats).agg(
        F.greatest(F.lit(0), F.lit(100) - F.coalesce(F.sum("deduction"), F.lit(0))).cast("bigint").alias("quality_score"),
        F.count("*").alias("n_issues")).select(
        "quality_score", "n_issues", F.lit(stats.duplicate_rows).cast("bigint").alias("duplicate_rows"),
        F.lit(stats.missing_cells).cast("bigint").alias("total_missing_cells"))


def readiness_checks(stats: TableStats) -> DataFrame:
    """Five checks with status, message and how many points each costs."""
    texts = stats.roles.categorical
    stats.gather("text_cardinality", "duplicates")
    wide = sum((stats.fact(c, "n_unique") or 0) > 50 for c in texts)
    facts = _table_facts(stats).withColumn("n_wide", F.lit(wide))
    missing = F.coalesce(F.try_divide(F.col("n_missing") * 100.0, F.col("n_cells").cast("double")), F.lit(0.0))
    repeated = F.coalesce(F.try_divide(F.col("n_duplicate") * 100.0, F.col("n_rows").cast("double")), F.lit(0.0))
    n = F.col("n_rows")

    def check(rank, name, status, message, cost):
        return F.struct(F.lit(rank).cast("bigint").alias("rank"), F.lit(name).alias("check_name"), status.alias("status"),
                        message.alias("message"), cost.cast("double").alias("cost"))

    checks = [
        check(1, "Missing Values", F.when(missing == 0, "pass").when(missing < 5, "warning").otherwise("fail"),
              F.when(missing > 0, F.format_string("%.1f%% missing data", missing)).otherwise("No missing values"),
              F.least(missing, F.lit(30.0))),
        check(2, "Duplicates", F.when(F.col("n_duplicate") > 0, "warning").otherwise("pass"),
              F.when(F.col("n_duplicate") > 0, F.format_string("%d duplicate rows", "n_duplicate"))
              .otherwise("No duplicates"), F.least(repeated * 2, F.lit(20.0))),
        check(3, "Sample Size", F.when(n < 1000, "warning").otherwise("pass"),
              F.when(n < 100, F.format_string("Only %d rows", n)).when(n < 1000, F.format_string("%d rows (small)", n))
              .otherwise(F.format_string("%d rows", n)), F.when(n < 100, 25.0).when(n < 1000, 10.0).otherwise(0.0)),
        check(4, "Numeric Features", F.when(F.col("n_numeric") == 0, "fail").otherwise("pass"),
              F.when(F.col("n_numeric") == 0, "No numeric columns").otherwise(F.format_string("%d numeric columns", "n_numeric")),
              F.when(F.col("n_numeric") == 0, 30.0).otherwise(0.0)),
        check(5, "Categorical Encoding", F.when(F.col("n_text") > 0, "warning").otherwise("pass"),
              F.when(F.col("n_wide") > 0, F.format_string("%d high cardinality columns", "n_wide"))
              .when(F.col("n_text") > 0, F.format_string("%d categorical columns", "n_text"))
              .otherwise("No categorical columns"),
              F.when(F.col("n_wide") > 0, 15.0).when(F.col("n_text") > 0, 5.0).otherwise(0.0)),
    ]
    return facts.select(F.explode(F.array(*checks)).alias("t")).select("t.*")


def ml_readiness(stats: TableStats) -> DataFrame:
    """Score, at least 0, and level."""
    score = F.lit(100.0) - F.sum("cost")
    return readiness_checks(stats).agg(score.alias("raw")).select(
        F.greatest(F.lit(0.0), F.round("raw", 2)).alias("readiness_score"),
        F.when(F.col("raw") >= 85, "Ready").when(F.col("raw") >= 70, "Nearly Ready").when(F.col("raw") >= 50, "Needs Work")
        .otherwise("Not Ready").alias("readiness_level"))


def ml_next_steps(stats: TableStats) -> DataFrame:
    """The step each warned or failed check asks for, or one saying that nothing is left to do."""
    table = F.create_map(*[F.lit(x) for (name, status), step in NEXT_STEPS.items() for x in (f"{name}/{status}", step)])
    steps = readiness_checks(stats).withColumn("step", F.try_element_at(table, F.concat_ws("/", "check_name", "status")))
    steps = steps.filter("step is not null").select("rank", "step")
    if steps.isEmpty():
        return stats.rows([{"rank": 1, "step": "Your data is ready! Proceed to ML model selection"}], "rank bigint, step string")
    return steps


def target_candidates(stats: TableStats, max_values: int = 10) -> DataFrame:
    """Columns one may want to predict: by name, with two values, or text with at most ten values."""
    names = [c for c in stats.df.columns if countable(stats.roles.types[c])]
    stats.need_cardinality(names)
    is_text = F.col("column_name").isin(stats.roles.categorical)
    named = has_word(F.col("column_name"), TARGET_WORDS)
    few = (F.col("n_unique") == 2) | (is_text & (F.col("n_unique") <= max_values))
    reason = (F.when(named, "name suggests a target").when(F.col("n_unique") == 2, "binary column")
              .otherwise("few categories"))
    found = stats.frame(["n_unique"], names).filter(named | few).select(
        "position", "column_name", reason.alias("reason"),
        F.when(named & ~is_text, "regression").otherwise("classification").alias("type"),
        F.when(named, "high").otherwise("medium").alias("confidence"), "n_unique",
        F.when(~named, F.col("column_name")).alias("_listed"))
    listed = [r["_listed"] for r in found.select("_listed").dropna().collect()]
    if not listed:
        return found.withColumn("_listed", F.lit(None).cast("array<string>")).withColumnRenamed("_listed", "unique_values")
    # only columns with at most max_values distinct values are collected
    row = stats.df.agg(*[F.array_sort(F.collect_set(ref(c).cast("string"))).alias(f"v{i}") for i, c in enumerate(listed)]).first()
    values = stats.rows([{"_listed": c, "unique_values": row[i]} for i, c in enumerate(listed)],
                        "_listed string, unique_values array<string>")
    return found.join(F.broadcast(values), "_listed", "left").drop("_listed")


def suggest_models(stats: TableStats, target: str, sample: int = 5) -> DataFrame:
    """Problem type of the target, its distinct count, its first values in sorted order, and three models by rank."""
    if target not in stats.df.columns:
        raise ValueError(f"unknown column: {target}")
    stats.need_cardinality([target])
    unique, numeric = stats.fact(target, "n_unique"), target in stats.roles.numeric
    problem = "Regression" if numeric else "Binary Classification" if unique == 2 else "Multi-Class Classification"
    first = [str(r[0]) for r in frequencies_of(stats.df, target).orderBy("value").limit(sample)
             .select(F.col("value").cast("string")).collect()]
    rows = [{"column_name": target, "problem_type": problem, "n_unique": unique, "is_numeric": numeric,
             "samples": ",".join(first), "rank": i + 1, "model": m} for i, m in enumerate(SUGGESTED_MODELS[problem])]
    return stats.rows(rows, "column_name string, problem_type string, n_unique bigint, is_numeric boolean, "
                            "samples string, rank bigint, model string")
