"""Insights, recommendations and short texts, each one row per statement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from colsift.operators import scores
from colsift.operators.correlate import high_correlations
from colsift.operators.outliers import iqr_outliers
from colsift.plans.stats import TableStats

SCHEMA = "rank bigint, message string"

# Titles and statements of the findings of both flavors.
FINDINGS = {
    "missing": ("High Missing Data", "{:.1f}% of your data is missing"),
    "duplicates": ("Duplicate Rows Detected", "Found {} duplicate rows"),
    "cardinality": ("High Cardinality Columns", "Columns with too many unique values: {}"),
    "correlation": ("Strong Correlations Found", "Found {} strong relationships between columns"),
    "imbalance": ("Imbalanced Categories", "Column '{}' is heavily imbalanced"),
    "nothing": ("Data Looks Great!", "No major issues detected"),
}
STATEMENTS = {
    "large": "Large dataset suitable for complex modeling",
    "small": "Small dataset - consider collecting more data",
    "gaps_high": "High missing data ({:.1f}%) - consider imputation",
    "gaps_some": "Moderate missing data ({:.1f}%)",
    "gaps_few": "Minimal missing data - good quality",
    "numbers_many": "Many numerical features ({})",
    "numbers_some": "Suitable numerical features ({})",
    "texts_many": "Multiple categorical variables ({})",
    "close_pairs": "Found {} highly correlated pairs",
    "outliers": "Outliers in {} columns",
    "fix_quality": "Address data quality issues",
    "fix_duplicates": "Remove {} duplicates",
    "fix_gaps": "Handle high missing values in: {}",
    "fix_outliers": "Investigate outliers in: {}",
    "fix_pairs": "Remove highly correlated features",
    "scale": "Scale numerical features for ML",
    "encode": "Encode categorical variables",
    "split": "Split data for model validation",
    "size": "Dataset contains {:,} records with {} features",
    "quality_best": "Excellent data quality - ready for analysis",
    "quality_good": "Good data quality - minor issues detected",
    "quality_poor": "Data quality needs improvement - consider cleaning",
    "issues": "{} data quality issues to address",
    "columns_with_gaps": "{} columns have >20% missing values",
    "strong_pairs": "{} strong correlations found",
}

# what can be done about each finding
ACTIONS = {
    "missing": "Fill the gaps or drop the emptiest columns and rows",
    "duplicates": "Drop the repeated rows before any statistics",
    "cardinality": "Leave these columns out, or merge their rare values",
    "correlation": "Keep one column of each close pair",
    "imbalance": "Weight the classes or sample them evenly when training",
    "nothing": "Go on to model building",
}


def _share(stats: TableStats) -> float:
    cells = stats.n_rows * len(stats.df.columns)
    return stats.missing_cells * 100 / cells if cells else 0.0


def _count_pairs(stats: TableStats, condition: Column) -> int:
    return stats.pairs.filter(condition).count()


def insights(stats: TableStats) -> DataFrame:
    """Flavor E: (rank, type, title, message, action) for missing data, duplicates, cardinality, correlation, imbalance."""
    texts = stats.roles.categorical
    stats.gather("text_cardinality", "duplicates", "pairs")
    found = []

    def add(level, kind, *values):
        title, statement = FINDINGS[kind]
        found.append({"rank": len(found) + 1, "type": level, "title": title, "message": statement.format(*values), "action": ACTIONS[kind]})

    if _share(stats) > 10:
        add("warning", "missing", _share(stats))
    if stats.duplicate_rows:
        add("warning", "duplicates", stats.duplicate_rows)
    unlike = [c for c in texts if stats.fact(c, "n_unique") > 0.5 * stats.n_rows]
    if unlike:
        add("info", "cardinality", ", ".join(unlike))
    strong = _count_pairs(stats, F.abs("r") > 0.8)
    if strong:
        add("success", "correlation", strong)
    uneven = [c for c in texts if stats.fact(c, "n_unique") == 2 and stats.fact(c, "top_count") > 5 * stats.fact(c, "low_count")]
    if uneven:
        add("warning", "imbalance", uneven[0])
    if not found:
        add("success", "nothing")
    return stats.rows(found, "rank bigint, type string, title string, message string, action string")


def _numbered(stats: TableStats, messages: list[str]) -> DataFrame:
    return stats.rows([{"rank": i + 1, "message": m} for i, m in enumerate(messages)], SCHEMA)


def _speaker(said: list[str]):
    """Adds a statement by its name and values."""
    return lambda name, *values: said.append(STATEMENTS[name].format(*values))


def _many_outliers(stats: TableStats) -> list[str]:
    return [r["column_name"] for r in iqr_outliers(stats).filter("outlier_pct > 5").collect()]


def key_insights(stats: TableStats) -> DataFrame:
    """Flavor A: short statements on size, missing data, features, correlation and outliers."""
    stats.gather("pairs", "outliers")
    said, share = [], _share(stats)
    say = _speaker(said)
    numbers, texts = len(stats.roles.numeric), len(stats.roles.categorical)
    if stats.n_rows > 10_000:
        say("large")
    elif stats.n_rows < 100:
        say("small")
    if share > 20:
        say("gaps_high", share)
    elif share > 5:
        say("gaps_some", share)
    else:
        say("gaps_few")
    if numbers > 10:
        say("numbers_many", numbers)
    elif numbers:
        say("numbers_some", numbers)
    if texts > 5:
        say("texts_many", texts)
    close = high_correlations(stats, 0.8).count()
    if close:
        say("close_pairs", close)
    outlying = _many_outliers(stats)
    if outlying:
        say("outliers", len(outlying))
    return _numbered(stats, said)


def recommendations(stats: TableStats) -> DataFrame:
    stats.gather("pairs", "outliers", "duplicates")
    said = []
    say = _speaker(said)
    if scores.deducting_score(stats).first()["quality_score"] < 70:
        say("fix_quality")
    if stats.duplicate_rows:
        say("fix_duplicates", stats.duplicate_rows)
    # the share is rounded to two places before the comparison
    gaps = [c for c in stats.df.columns if stats.n_rows and round(stats.fact(c, "n_null") * 100 / stats.n_rows, 2) > 20]
    if gaps:
        say("fix_gaps", ", ".join(gaps[:3]))
    outlying = _many_outliers(stats)
    if outlying:
        say("fix_outliers", ", ".join(outlying[:3]))
    if high_correlations(stats, 0.9).count():
        say("fix_pairs")
    if stats.roles.numeric:
        say("scale")
    if stats.roles.categorical:
        say("encode")
    say("split")
    return _numbered(stats, said)


def insights_summary(stats: TableStats) -> DataFrame:
    """Size, quality band, issues, gaps, strong pairs and the first three key insights."""
    stats.gather("pairs", "outliers", "duplicates")
    score = scores.deducting_score(stats).first()
    said = []
    say = _speaker(said)
    say("size", stats.n_rows, len(stats.df.columns))
    if score["quality_score"] >= 90:
        say("quality_best")
    elif score["quality_score"] >= 70:
        say("quality_good")
    else:
        say("quality_poor")
    if score["n_issues"]:
        say("issues", score["n_issues"])
    gaps = sum(round(stats.fact(c, "n_null") * 100 / stats.n_rows, 2) > 20 for c in stats.df.columns) if stats.n_rows else 0
    if gaps:
        say("columns_with_gaps", gaps)
    strong = min(5, _count_pairs(stats, F.abs("r") > 0.7))
    if strong:
        say("strong_pairs", strong)
    said += [r["message"] for r in key_insights(stats).orderBy("rank").limit(3).collect()]
    return _numbered(stats, said)


# One message per kind of finding or cleaning action: a format and the columns it takes.
MESSAGES = {
    "dataset_overview": ("Dataset of %d rows and %d columns", ["total_rows", "total_columns"]),
    "data_quality": ("Quality score %d of 100, %d issues", ["quality_score", "n_issues"]),
    "key_insights": ("%d. %s", ["rank", "message"]),
    "recommendations": ("%d. %s", ["rank", "message"]),
    "column_stats": ("Column '%s': mean %.2f, deviation %.2f", ["column_name", "mean", "std"]),
    "patterns": ("Column '%s': %s", ["column_name", "pattern"]),
    "correlation": ("'%s' and '%s' correlate at %.2f", ["c1", "c2", "correlation"]),
    "outliers": ("Column '%s' has %d outliers of %d in the table", ["column_name", "n_outliers", "total_outliers"]),
    "analysis_summary": ("%s: %d records, %d columns analysed", ["type", "total_rows", "total_columns"]),
    "handle_missing": ("Filled %d missing values of '%s' by %s", ["n_changed", "column_name", "method"]),
    "remove_duplicates": ("Removed %d duplicate rows of %d", ["n_changed", "rows_before"]),
    "fix_datatypes": ("Converted '%s' from %s to %s", ["column_name", "from_type", "to_type"]),
    "remove_outliers": ("Removed %d rows with outliers in '%s' by %s", ["n_changed", "column_name", "method"]),
    "standardize_format": ("Cleaned the text of '%s': %s", ["column_name", "method"]),
}


def finding_text(frame: DataFrame, kind: str) -> DataFrame:
    """The frame with a `message` column in plain words."""
    if kind not in MESSAGES:
        raise ValueError(f"unknown kind of finding: {kind}")
    pattern, columns = MESSAGES[kind]
    return frame.withColumn("message", F.format_string(pattern, *columns))
