"""Profiles of tables and columns."""

from pyspark.sql import functions as F

from colsift.operators import distribution, profile, reports
from colsift.plans.session import scratch_path
from colsift.plans.stats import TableStats
from querybook.base import (DIRTY, DIRTY_NUMERIC, DIRTY_TEXT, LINEITEM_NUMERIC, each, given, query, r, read, rounded)

T = "dirty_lineitem"


def _stats(spark, folder, name=T, flavor="E"):
    return TableStats(read(spark, folder, name), flavor)


@query("overview", given(T) + f"""
    SELECT count(*) AS total_rows, CAST(14 AS BIGINT) AS total_columns, CAST(10 AS BIGINT) AS numeric_columns,
           CAST(3 AS BIGINT) AS categorical_columns, CAST(1 AS BIGINT) AS datetime_columns, '{",".join(DIRTY)}' AS column_names FROM {T}""")
def overview(spark, folder):
    return profile.overview(_stats(spark, folder))


@query("column_profile", given(T) + each(DIRTY, f"""
    SELECT CAST({{i}} AS BIGINT) AS position, '{{c}}' AS column_name, count({{c}}) AS non_null_count, count(*) - count({{c}}) AS null_count,
           {r("(count(*) - count({c})) * 100.0 / count(*)", 2)} AS null_pct, count(DISTINCT {{c}}) AS unique_values,
           {r("count(DISTINCT {c}) * 1.0 / count(*)", 4)} AS uniqueness_ratio FROM {T}"""))
def column_profile(spark, folder):
    return profile.column_profile(_stats(spark, folder)).drop("data_type")


# G1, and g1 from it; both 0 or NULL on a constant column
G1 = "CASE WHEN min({c}) < max({c}) THEN skewness({c}) ELSE 0.0 END"
SMALL_G1 = "CASE WHEN min({c}) < max({c}) THEN skewness({c}) * (count({c}) - 2) / sqrt(CAST(count({c}) AS DOUBLE) * (count({c}) - 1)) END"
KURTOSIS = "CASE WHEN min({c}) < max({c}) THEN kurtosis_pop({c}) END"
OUT = "(SELECT count(*) FROM {t} WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1))"

NUMERIC_E = " UNION ALL ".join(f"""
    SELECT '{c}' AS column_name, {r("mean", 2)} AS mean, {r("median", 2)} AS median, {r("std", 2)} AS std_dev, {r("low", 2)} AS "min", {r("high", 2)} AS "max",
           {r("high - low", 2)} AS "range", {r("skew", 2)} AS skewness,
           CASE WHEN abs(mean - median) < std * 0.1 THEN 'symmetric (balanced)' WHEN skew > 1 THEN 'right-skewed (tail on right)'
                WHEN skew < -1 THEN 'left-skewed (tail on left)' ELSE 'slightly skewed' END AS distribution_type,
           {OUT.format(t=T, c=c)} AS outlier_count, {r(OUT.format(t=T, c=c) + " * 100.0 / n", 2)} AS outlier_pct
    FROM (SELECT avg({c}) AS mean, quantile_cont({c}, 0.5) AS median, stddev_samp({c}) AS std, min({c}) AS low, max({c}) AS high,
                 {G1.format(c=c)} AS skew, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3, count({c}) AS n FROM {T})"""
    for c in DIRTY_NUMERIC)


@query("numeric_profile_e", given(T) + NUMERIC_E)
def numeric_profile_e(spark, folder):
    return profile.numeric_profile(_stats(spark, folder)).drop("position")


@query("distribution_label_e", given(T) + f"SELECT column_name, distribution_type FROM ({NUMERIC_E})")
def distribution_label_e(spark, folder):
    return profile.numeric_profile(_stats(spark, folder)).select("column_name", "distribution_type")


def _top(column, k, table=T):
    return (f"(SELECT '{column}' AS column_name, row_number() OVER (ORDER BY count(*) DESC, {column}) AS value_rank, "
            f"CAST({column} AS VARCHAR) AS value, count(*) AS cnt FROM {table} WHERE {column} IS NOT NULL GROUP BY {column} "
            f"ORDER BY count(*) DESC, {column} LIMIT {k})")


@query("categorical_profile_e", given(T) + " UNION ALL ".join(f"""
    SELECT top.*, u AS unique_count, {r("m * 100.0 / n", 2)} AS top_pct, CASE WHEN m * 100.0 / n > 50 THEN 'highly concentrated'
           WHEN m * 100.0 / n > 25 THEN 'moderately concentrated' ELSE 'well distributed' END AS concentration
    FROM {_top(c, 5)} top, (SELECT count({c}) AS n, count(DISTINCT {c}) AS u FROM {T}),
         (SELECT max(k) AS m FROM (SELECT count(*) AS k FROM {T} WHERE {c} IS NOT NULL GROUP BY {c}))""" for c in DIRTY_TEXT))
def categorical_profile_e(spark, folder):
    return profile.categorical_profile(_stats(spark, folder))


@query("datetime_profile", " UNION ALL ".join(f"""
    SELECT '{c}' AS column_name, min({c}) AS earliest, max({c}) AS latest, CAST(floor(epoch(max({c}) - min({c})) / 86400) AS BIGINT) AS range_days,
           {r(f"floor(epoch(max({c}) - min({c})) / 86400) / 365.25", 2)} AS range_years FROM {t}"""
    for t, c in (("lineitem", "l_shipdate"), ("orders", "o_orderdate"), ("events", "ts"))))
def datetime_profile(spark, folder):
    found = [profile.datetime_profile(_stats(spark, folder, t)).drop("position") for t in ("lineitem", "orders", "events")]
    return found[0].unionAll(found[1]).unionAll(found[2])


QUARTILES = """quantile_cont({c}, 0.25) AS p25, quantile_cont({c}, 0.5) AS p50, quantile_cont({c}, 0.75) AS p75"""


@query("describe", each(LINEITEM_NUMERIC, f"""
    SELECT '{{c}}' AS column_name, count({{c}}) AS "count", {r("avg({c})")} AS mean, {r("stddev_samp({c})")} AS std, {r("min({c})")} AS "min",
           {r("quantile_cont({c}, 0.25)")} AS p25, {r("quantile_cont({c}, 0.5)")} AS p50, {r("quantile_cont({c}, 0.75)")} AS p75, {r("max({c})")} AS "max" FROM lineitem"""))
def describe(spark, folder):
    return rounded(profile.describe(_stats(spark, folder, "lineitem")).drop("position"))


NUMERIC_A = each(DIRTY_NUMERIC, f"""
    SELECT '{{c}}' AS column_name, count({{c}}) AS "count", {r("avg({c})")} AS mean, {r("stddev_pop({c})")} AS std, {r("min({c})")} AS "min",
           {r("quantile_cont({c}, 0.25)")} AS p25, {r("quantile_cont({c}, 0.5)")} AS median, {r("quantile_cont({c}, 0.75)")} AS p75, {r("max({c})")} AS "max",
           {r(SMALL_G1)} AS skewness, {r(KURTOSIS)} AS kurtosis, {r("max({c}) - min({c})")} AS "range",
           {r("quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)")} AS iqr FROM {T}""")
MEASURES_A = ["count", "mean", "std", "min", "p25", "median", "p75", "max", "skewness", "kurtosis", "range", "iqr"]


@query("numeric_summary_a", given(T) + NUMERIC_A)
def numeric_summary_a(spark, folder):
    return rounded(profile.numeric_summary(_stats(spark, folder, flavor="A")).drop("position"))


CATEGORICAL_A = " UNION ALL ".join(
    f"SELECT top.*, u AS unique_values, m AS missing_values FROM {_top(c, 5)} top, "
    f"(SELECT count(DISTINCT {c}) AS u, count(*) - count({c}) AS m FROM {T})" for c in DIRTY_TEXT)


@query("categorical_summary_a", given(T) + CATEGORICAL_A)
def categorical_summary_a(spark, folder):
    return profile.categorical_summary(_stats(spark, folder, flavor="A"))


GAPS = "(" + each(DIRTY, f"SELECT '{{c}}' AS column_name, count(*) - count({{c}}) AS m, count(*) AS n FROM {T}") + ")"
MISSING_A = f"""SELECT column_name, m AS missing_count, CAST((SELECT sum(m) FROM {GAPS}) AS BIGINT) AS total_missing,
    {r(f"(SELECT sum(m) * 100.0 / sum(n) FROM {GAPS})", 2)} AS missing_pct_total FROM {GAPS} WHERE m > 0"""


@query("missing_summary_a", given(T) + MISSING_A)
def missing_summary_a(spark, folder):
    return profile.missing_summary(_stats(spark, folder, flavor="A")).drop("position")


def long_sql(section, inner, measures, column="column_name"):
    """The measures of a wide SELECT as rows."""
    return " UNION ALL ".join(
        f"""SELECT '{section}' AS section, {column} AS column_name, '{m}' AS metric, {r(f'"{m}"')} AS value FROM ({inner})""" for m in measures)


DESCRIPTIVE = " UNION ALL ".join([
    long_sql("numerical", NUMERIC_A, MEASURES_A),
    long_sql("categorical", CATEGORICAL_A, ["cnt", "unique_values", "missing_values"], "concat(column_name, '=', value)"),
    long_sql("missing", MISSING_A, ["missing_count", "total_missing", "missing_pct_total"])])


@query("descriptive_stats", given(T) + DESCRIPTIVE)
def descriptive_stats(spark, folder):
    return rounded(profile.descriptive_stats(_stats(spark, folder, flavor="A")))


BASIC = f"""SELECT 'l_quantity' AS column_name, count(l_quantity) AS "count", avg(l_quantity) AS mean, stddev_pop(l_quantity) AS std, min(l_quantity) AS "min",
    max(l_quantity) AS "max", quantile_cont(l_quantity, 0.5) AS median, count(*) - count(l_quantity) AS missing,
    (count(*) - count(l_quantity)) * 100.0 / count(*) AS missing_pct FROM {T}"""
BASIC_MEASURES = ["count", "mean", "std", "min", "max", "median", "missing", "missing_pct"]
BASIC_TEXT = f"""SELECT 'l_returnflag' AS column_name, count(l_returnflag) AS "count", count(DISTINCT l_returnflag) AS unique_values,
    count(*) - count(l_returnflag) AS missing, (count(*) - count(l_returnflag)) * 100.0 / count(*) AS missing_pct FROM {T}"""


@query("column_basic", given(T) + long_sql("numerical", BASIC, BASIC_MEASURES) + " UNION ALL "
       + long_sql("categorical", BASIC_TEXT, ["count", "unique_values", "missing", "missing_pct"])
       + f" UNION ALL SELECT 'top', value, CAST(value_rank AS VARCHAR), CAST(cnt AS DOUBLE) FROM {_top('l_returnflag', 3)}")
def column_basic(spark, folder):
    stats = _stats(spark, folder, flavor="A")
    top = profile.column_top_values(stats.df, "l_returnflag")
    top = top.select(F.lit("top"), "value", F.col("value_rank").cast("string"), F.col("cnt").cast("double"))
    both = profile.column_basic(stats, "l_quantity").unionAll(profile.column_basic(stats, "l_returnflag"))
    return rounded(both.unionAll(top)).withColumnRenamed("type", "section")


DETAIL = f"""SELECT 'l_extendedprice' AS column_name, * EXCLUDE (n, q1, q3), {OUT.format(t=T, c="l_extendedprice")} AS outlier_count,
    {OUT.format(t=T, c="l_extendedprice")} * 100.0 / n AS outlier_pct, q1 - 1.5 * (q3 - q1) AS lower_bound, q3 + 1.5 * (q3 - q1) AS upper_bound
    FROM (SELECT {", ".join(f"quantile_cont(l_extendedprice, {p}) AS p{p * 100:.0f}" for p in profile.DETAIL_PROBS)},
                 {SMALL_G1.format(c="l_extendedprice")} AS skewness, {KURTOSIS.format(c="l_extendedprice")} AS kurtosis, count(l_extendedprice) AS n,
                 quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.75) AS q3 FROM {T})"""


@query("column_detailed", given(T) + long_sql("numerical", BASIC.replace("l_quantity", "l_extendedprice"), BASIC_MEASURES) + " UNION ALL "
       + long_sql("numerical", DETAIL, [f"p{p * 100:.0f}" for p in profile.DETAIL_PROBS] + [
           "skewness", "kurtosis", "outlier_count", "outlier_pct", "lower_bound", "upper_bound"]))
def column_detailed(spark, folder):
    stats = TableStats(read(spark, folder, T).select("l_extendedprice"), "A")
    return rounded(profile.column_detailed(stats, "l_extendedprice")).withColumnRenamed("type", "section")


@query("column_distribution", """
    SELECT event_type AS value, count(*) AS cnt FROM events GROUP BY event_type""")
def column_distribution(spark, folder):
    return distribution.column_distribution(_stats(spark, folder, "events", "A"), "event_type")


@query("value_counts", "SELECT p_type AS value, count(*) AS cnt FROM part GROUP BY p_type ORDER BY cnt DESC, value LIMIT 5")
def value_counts(spark, folder):
    return profile.value_counts(read(spark, folder, "part"), "p_type", 5)


TEXTS = {"documents": ["text", "lang", "source"], "customer": ["c_name", "c_mktsegment"], "conversations": ["role", "text"]}


@query("category_cardinality", " UNION ALL ".join(f"""
    SELECT '{t}' AS table_name, '{c}' AS column_name, count(DISTINCT {c}) AS unique_count, CASE WHEN count(DISTINCT {c}) * 1.0 / count(*) > 0.5 THEN 'very high'
           WHEN count(DISTINCT {c}) * 1.0 / count(*) > 0.1 THEN 'high' ELSE 'good' END AS cardinality,
           {r(f"count(DISTINCT {c}) * 1.0 / count(*)", 4)} AS cardinality_ratio FROM {t}""" for t, cs in TEXTS.items() for c in cs))
def category_cardinality(spark, folder):
    found = [profile.category_cardinality(_stats(spark, folder, t)).drop("position").select(F.lit(t).alias("table_name"), "*") for t in TEXTS]
    return found[0].unionAll(found[1]).unionAll(found[2])


@query("top_long_texts", " UNION ALL ".join(f"""
    (SELECT '{c}' AS column_name, row_number() OVER (ORDER BY count(*) DESC, k) AS value_rank, {c} AS value, count(*) AS cnt
     FROM (SELECT {c}, CASE WHEN length({c}) <= 64 THEN {c} ELSE concat(md5({c}), ':', length({c})) END AS k FROM documents)
     GROUP BY {c}, k ORDER BY count(*) DESC, k LIMIT 5)""" for c in TEXTS["documents"]))
def top_long_texts(spark, folder):
    return profile.categorical_profile(_stats(spark, folder, "documents")).select("column_name", "value_rank", "value", "cnt")


@query("analysis_history", " UNION ALL ".join(f"""
    SELECT '{run}' AS run_id, 'quick' AS type, 'overview' AS section, '{m}' AS metric, {v} AS value FROM orders HAVING count(*) > 0""" for run in ("first", "second")
    for m, v in (("total_rows", "CAST(count(*) AS DOUBLE)"), ("total_columns", "6.0::DOUBLE"))))
def analysis_history(spark, folder):
    path = scratch_path(spark, "history")
    stats = _stats(spark, folder, "orders", "A")
    for run, table in (("first", profile.overview(stats)), ("second", profile.overview(stats))):
        rows = profile.long_form("overview", table.withColumn("column_name", F.lit("*")), "column_name", ["total_rows", "total_columns"])
        reports.append_history(rows, "quick", run, path)
    return spark.read.parquet(path).select("run_id", "type", "section", "metric", "value")
