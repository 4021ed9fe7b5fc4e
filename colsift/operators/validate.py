"""Read-only checks. Each returns one row per finding; `validate_all` puts them together."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from colsift.functions.values import ref, to_number, to_time, value_class
from colsift.plans import frequencies
from colsift.plans.fingerprints import fingerprint
from colsift.plans.roles import column_roles
from colsift.plans.session import small_frame
from colsift.plans.stats import TableStats

# Name parts that mark a column as an identifier or as a date.
IDENTIFIER_WORDS = ["id", "email", "phone", "ssn", "passport", "username", "account"]
DATE_WORDS = ["date", "time"]

# What is advised per severity of missing values.
MISSING_ADVICE = {
    "low": ["Fill with mean/median (for numbers)", "Fill with mode (most common value)",
            "Use 'forward fill' (copy previous value)"],
    "medium": ["Analyze if missing values have a pattern", "Consider predictive imputation (ML-based filling)",
               "Create a 'missing' category if meaningful"],
    "high": ["Consider removing this column", "Check if missing data is 'informative' (means something)",
             "Collect more data if possible"],
    "critical": ["Remove this column - too much missing data", "Or collect new data for this field"],
}


def percent(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double") * 100, whole.cast("double"))


def has_word(name: Column, words: list[str]) -> Column:
    return F.lower(name).rlike("|".join(words))


def basic_info(stats: TableStats) -> DataFrame:
    """One row per column with the table's size beside it."""
    rows = [{"position": i, "column_name": f.name, "dtype": f.dataType.simpleString(), "n_rows": stats.n_rows,
             "n_columns": len(stats.df.columns)} for i, f in enumerate(stats.df.schema)]
    return stats.rows(rows, "position bigint, column_name string, dtype string, n_rows bigint, n_columns bigint")


def missing_severity(pct: Column) -> Column:
    return F.when(pct < 5, "low").when(pct < 20, "medium").when(pct < 50, "high").otherwise("critical")


def missing_advice(severity: Column) -> Column:
    table = F.create_map(*[F.lit(x) for k, v in MISSING_ADVICE.items() for x in (k, v)])
    return F.try_element_at(table, severity)


def missing_values(stats: TableStats) -> DataFrame:
    """Columns with missing values: count, percent of rows, severity, advice and finding level."""
    pct = percent(F.col("n_null"), F.lit(stats.n_rows))
    found = stats.need("nulls").frame(["n_null"]).filter("n_null > 0").withColumn("raw", pct)
    return found.select(
        "position", "column_name", F.col("n_null").alias("missing_count"),
        F.round("raw", 2).alias("missing_pct"), missing_severity(F.col("raw")).alias("severity"),
        missing_advice(missing_severity(F.col("raw"))).alias("advice"),
        F.when(F.col("raw") > 50, "issue").when(F.col("raw") > 5, "warning").otherwise("info").alias("level"))


def missing_counts(stats: TableStats) -> DataFrame:
    """Missing per column where there is any, and the number of duplicate rows beside it."""
    return (stats.need("nulls").frame(["n_null"]).filter("n_null > 0")
            .select("column_name", F.col("n_null").alias("missing_count"),
                    F.lit(stats.duplicate_rows).cast("bigint").alias("duplicate_rows")))


def duplicate_rows(stats: TableStats) -> DataFrame:
    n = stats.duplicate_rows
    rows = [{"n_rows": stats.n_rows, "duplicate_rows": n, "level": "issue" if n else "info"}]
    return stats.rows(rows, "n_rows bigint, duplicate_rows bigint, level string")


def duplicate_positions(df: DataFrame, order_by: list[str], limit: int = 100, salts: int = 64) -> DataFrame:
    """The `limit` first rows, in the order of `order_by`, that repeat an earlier row.

    Of a group of copies only the first limit + 1 can matter. They are found per salt and then per group; both filters
    become window group limits, so a group that holds a third of the table never meets in one task.
    """
    if not order_by:
        raise ValueError("order_by is required: a DataFrame has no row order")
    keys = [ref(k) for k in order_by]
    group = ["_h1", "_h2"]
    marked = df.select("*", *fingerprint(df))
    # copies are equal in every column, so the salt comes from outside the row; it cannot change the result
    salted = marked.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)))
    per_salt = Window.partitionBy(*group, "_salt").orderBy(*keys)
    few = salted.withColumn("_place", F.row_number().over(per_salt)).filter(F.col("_place") <= limit + 1)
    per_group = Window.partitionBy(*group).orderBy(*keys)
    repeats = few.withColumn("_place", F.row_number().over(per_group)).filter(F.col("_place") <= limit + 1)
    return repeats.filter("_place > 1").orderBy(*keys).limit(limit).select(*[ref(c) for c in df.columns])


def column_duplicates(stats: TableStats) -> DataFrame:
    """Per column with repeats: distinct values, rows, rows - distinct, percent, and whether it is an identifier."""
    names = [c for c in stats.df.columns if frequencies.countable(stats.roles.types[c])]
    found = stats.need_cardinality().frame(["n_unique"], names)
    rows = F.lit(stats.n_rows)
    return (found.withColumn("duplicate_count", rows - F.col("n_unique")).filter("duplicate_count > 0")
            .select("position", "column_name", F.col("n_unique").alias("unique_values"),
                    rows.cast("bigint").alias("total_values"), "duplicate_count",
                    F.round(percent(F.col("duplicate_count"), rows), 2).alias("duplicate_pct"),
                    has_word(F.col("column_name"), IDENTIFIER_WORDS).alias("is_problematic")))


def identifier_duplicates(stats: TableStats) -> DataFrame:
    return column_duplicates(stats).filter("is_problematic").drop("is_problematic")


def _samples(df: DataFrame, order_by: list[str], wanted: dict[str, Column], limit: int) -> DataFrame:
    """Per column the first `limit` values, in the order of `order_by`, for which its condition holds."""
    if not order_by:
        raise ValueError("order_by is required: a DataFrame has no row order")
    parts = [F.struct(F.lit(c).alias("column_name"), ref(c).cast("string").alias("value"), ok.alias("hit"))
             for c, ok in wanted.items()]
    keys = [ref(k).alias(f"_k{i}") for i, k in enumerate(order_by)]
    if not parts:
        return small_frame(df.sparkSession, [], "column_name string, value string, place bigint")
    hit = reduce(lambda a, b: a | b, wanted.values())
    flat = df.filter(hit).select(*keys, F.explode(F.array(*parts)).alias("t")).filter("t.hit")
    first = flat.select("t.column_name", "t.value", F.row_number().over(
        Window.partitionBy("t.column_name").orderBy(*[f"_k{i}" for i in range(len(order_by))])).alias("place"))
    return first.filter(F.col("place") <= limit).withColumn("place", F.col("place").cast("bigint"))


def type_issues(stats: TableStats, mixed_only: bool = False) -> DataFrame:
    """Text columns with values that are no numbers; `mixed_only` also asks for at least one number."""
    found = stats.need("text").frame(["n_not_number", "n_number"], stats.roles.categorical).filter("n_not_number > 0")
    if mixed_only:
        found = found.filter("n_number > 0")
    return found.select("position", "column_name", F.col("n_not_number").alias("non_numeric_count"),
                        F.lit("numeric").alias("suggested_type"), F.lit("warning").alias("level"))


def type_issue_samples(df: DataFrame, order_by: list[str], limit: int = 5) -> DataFrame:
    texts = column_roles(df).categorical
    return _samples(df, order_by, {c: ref(c).isNotNull() & to_number(ref(c)).isNull() for c in texts}, limit)


def outliers(stats: TableStats) -> DataFrame:
    """Numeric columns with values outside the fences; the percentage is of all rows."""
    stats.need_outliers()
    names = [c for c in stats.roles.numeric if stats.fact(c, "n_outlier")]
    pct = percent(F.col("n_outlier"), F.lit(stats.n_rows))
    found = stats.frame(["n_outlier", "lower", "upper", "min_outlier", "max_outlier"], names)
    return found.select("position", "column_name", F.col("n_outlier").alias("outlier_count"),
                        F.round(pct, 2).alias("outlier_pct"), F.col("lower").alias("lower_bound"),
                        F.col("upper").alias("upper_bound"), "min_outlier", "max_outlier",
                        F.when(pct > 5, "warning").otherwise("info").alias("level"))


def outlier_samples(stats: TableStats, order_by: list[str], limit: int = 10) -> DataFrame:
    wanted = {c: (stats.numeric(c) < lo) | (stats.numeric(c) > hi) for c, (lo, hi) in stats.fences().items()}
    return _samples(stats.df, order_by, wanted, limit)


def whitespace(stats: TableStats) -> DataFrame:
    return (stats.need("text").frame(["n_padded"], stats.roles.categorical).filter("n_padded > 0")
            .select("position", "column_name", F.col("n_padded").alias("affected_rows"),
                    F.lit("whitespace").alias("issue_type")))


def case_inconsistency(stats: TableStats) -> DataFrame:
    """Text columns whose values collapse when lower-cased; missing values are left out on both sides."""
    texts = stats.roles.categorical
    if not texts:
        return stats.rows([], "position bigint, column_name string, n_unique bigint, n_unique_lower bigint, issue_type string")
    stats.need_cardinality(texts)
    lowered = stats.df.select(*[F.lower(ref(c)).alias(c) for c in texts])
    lower = frequencies.cardinality(lowered, texts).select("column_name", F.col("n_unique").alias("n_unique_lower"))
    return (stats.frame(["n_unique"], texts).join(lower, "column_name").filter("n_unique_lower < n_unique")
            .select("position", "column_name", "n_unique", "n_unique_lower",
                    F.lit("case_inconsistency").alias("issue_type")))


def date_issues(stats: TableStats) -> DataFrame:
    """Text columns named like a date whose values do not parse as one; numbers and timestamps always do."""
    stats.need("dates")
    names = [c for c in stats.df.columns if stats.fact(c, "n_bad_date")]
    return stats.frame(["n_bad_date"], names).select("position", "column_name",
                                                     F.col("n_bad_date").alias("invalid_count"))


def date_issue_samples(df: DataFrame, order_by: list[str], limit: int = 5) -> DataFrame:
    types = column_roles(df).types
    named = [c for c in df.columns if any(w in c.lower() for w in DATE_WORDS) and isinstance(types[c], T.StringType)]
    return _samples(df, order_by, {c: ref(c).isNotNull() & to_time(ref(c), types[c]).isNull() for c in named}, limit)


def high_cardinality(stats: TableStats) -> DataFrame:
    """Text columns with more than half as many distinct values as rows."""
    texts = stats.roles.categorical
    ratio = percent(F.col("n_unique"), F.lit(stats.n_rows))
    return (stats.need_cardinality(texts).frame(["n_unique"], texts).filter(ratio > 50)
            .select("position", "column_name", F.col("n_unique").alias("unique_count"),
                    F.lit(stats.n_rows).cast("bigint").alias("total_rows"), F.round(ratio, 2).alias("uniqueness_pct"),
                    F.lit("warning").alias("level")))


def low_variance_categorical(stats: TableStats) -> DataFrame:
    """Text columns where one value fills more than 95 % of all rows."""
    best = stats.top_values(stats.roles.categorical, 1)
    pct = percent(F.col("cnt"), F.lit(stats.n_rows))
    return best.filter(pct > 95).select("column_name", F.col("value").alias("most_common_value"),
                                        F.round(pct, 2).alias("most_common_pct"))


def low_variance_numeric(stats: TableStats, threshold: float = 0.01) -> DataFrame:
    """Numeric and boolean columns with a sample variance below the threshold."""
    booleans = [c for c, t in stats.roles.types.items() if isinstance(t, T.BooleanType)]
    names = [c for c in stats.df.columns if c in stats.roles.numeric or c in booleans]
    wide = TableStats(stats.df, "A") if booleans and stats.flavor == "E" else stats
    return (wide.need("moments").frame(["var_samp"], names).filter(F.col("var_samp") < threshold)
            .select("position", "column_name", F.round("var_samp", 6).alias("variance")))


def mixed_types(df: DataFrame) -> DataFrame:
    """Text columns whose values look like more than one type."""
    texts = column_roles(df).categorical
    if not texts:
        return small_frame(df.sparkSession, [], "column_name string, n_classes bigint, classes string")
    kinds = df.agg(*[F.array_sort(F.collect_set(value_class(ref(c)))).alias(f"k{i}") for i, c in enumerate(texts)])
    # a set of at most five class names per column
    flat = kinds.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"k{i}").alias("kinds"))
                                            for i, c in enumerate(texts)])).alias("t")).select("t.*")
    return flat.filter(F.size("kinds") > 1).select("column_name", F.size("kinds").cast("bigint").alias("n_classes"),
                                                   F.array_join("kinds", ",").alias("classes"))


def empty_columns(stats: TableStats) -> DataFrame:
    return (stats.need("nulls").frame(["n_null"]).filter(F.col("n_null") == stats.n_rows)
            .select("position", "column_name"))


def validate_all(stats: TableStats) -> DataFrame:
    """All findings as (check_name, column_name, level, metric, message)."""
    stats.need("moments", "text", "dates").gather("cardinality", "outliers", "duplicates")
    checks = [
        missing_values(stats).select(
            F.lit("missing_values"), "column_name", "level", F.col("missing_count"),
            F.format_string("Column '%s' has %.1f%% missing values", "column_name", "missing_pct")),
        duplicate_rows(stats).filter("duplicate_rows > 0").select(
            F.lit("duplicate_rows"), F.lit("*"), "level", "duplicate_rows",
            F.format_string("Found %d duplicate rows - these should be removed", "duplicate_rows")),
        identifier_duplicates(stats).select(
            F.lit("identifier_duplicates"), "column_name", F.lit("info"), "duplicate_count",
            F.format_string("Identifier column '%s' has %d repeated values", "column_name", "duplicate_count")),
        type_issues(stats).select(
            F.lit("type_issues"), "column_name", "level", "non_numeric_count",
            F.format_string("Column '%s' has mixed numeric and text values", "column_name")),
        outliers(stats).select(
            F.lit("outliers"), "column_name", "level", "outlier_count",
            F.format_string("Column '%s' has %d outlier values", "column_name", "outlier_count")),
        whitespace(stats).select(
            F.lit("whitespace"), "column_name", F.lit("info"), "affected_rows",
            F.format_string("Column '%s' has %d values with extra spaces", "column_name", "affected_rows")),
        case_inconsistency(stats).select(
            F.lit("case_inconsistency"), "column_name", F.lit("info"), F.expr("n_unique - n_unique_lower"),
            F.format_string("Column '%s' has values that differ only in capitalization", "column_name")),
        date_issues(stats).select(
            F.lit("date_issues"), "column_name", F.lit("info"), "invalid_count",
            F.format_string("Column '%s' has %d values that are no dates", "column_name", "invalid_count")),
        high_cardinality(stats).select(
            F.lit("high_cardinality"), "column_name", "level", "unique_count",
            F.format_string("Column '%s' has very high cardinality (%d unique values)", "column_name", "unique_count")),
        low_variance_categorical(stats).select(
            F.lit("low_variance"), "column_name", F.lit("info"), F.lit(None).cast("bigint"),
            F.format_string("Column '%s' has very low variance (categorical)", "column_name")),
        low_variance_numeric(stats).select(
            F.lit("low_variance"), "column_name", F.lit("info"), F.lit(None).cast("bigint"),
            F.format_string("Column '%s' has very low variance (numeric)", "column_name")),
    ]
    named = [c.toDF("check_name", "column_name", "level", "metric", "message") for c in checks]
    return reduce(DataFrame.unionAll, named)


def validation_summary(findings: DataFrame) -> DataFrame:
    return findings.groupBy("level").agg(F.count("*").alias("n_findings"))
