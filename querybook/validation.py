"""Read-only checks."""

from pyspark.sql import functions as F

from colsift.operators import validate
from colsift.plans.stats import TableStats
from querybook.base import DIRTY, DIRTY_NUMERIC, DIRTY_TEXT, ORDERS, each, given, query, r, read, rounded


def _stats(spark, folder, name):
    return TableStats(read(spark, folder, name))


@query("basic_info", each(ORDERS, f"""
    SELECT CAST({{i}} AS BIGINT) AS position, '{{c}}' AS column_name, count(*) AS n_rows, CAST({len(ORDERS)} AS BIGINT) AS n_columns FROM orders"""))
def basic_info(spark, folder):
    return validate.basic_info(_stats(spark, folder, "orders")).drop("dtype")


MISSING = given("dirty_lineitem")[:-1] + ", gaps AS (" + each(DIRTY, """
    SELECT CAST({i} AS BIGINT) AS position, '{c}' AS column_name, count(*) - count({c}) AS missing_count, count(*) AS n FROM dirty_lineitem""") + ") "


@query("missing_values", MISSING + f"""
    SELECT position, column_name, missing_count, {r("missing_count * 100.0 / n", 2)} AS missing_pct,
           CASE WHEN missing_count * 100.0 / n > 50 THEN 'issue' WHEN missing_count * 100.0 / n > 5 THEN 'warning' ELSE 'info' END AS level
    FROM gaps WHERE missing_count > 0""")
def missing_values(spark, folder):
    return validate.missing_values(_stats(spark, folder, "dirty_lineitem")).drop("severity", "advice")


@query("missing_severity", MISSING + """
    SELECT column_name, CASE WHEN missing_count * 100.0 / n < 5 THEN 'low' WHEN missing_count * 100.0 / n < 20 THEN 'medium'
                             WHEN missing_count * 100.0 / n < 50 THEN 'high' ELSE 'critical' END AS severity,
           CASE WHEN missing_count * 100.0 / n < 50 THEN 3 ELSE 2 END::BIGINT AS n_advice FROM gaps WHERE missing_count > 0""")
def missing_severity(spark, folder):
    return validate.missing_values(_stats(spark, folder, "dirty_lineitem")).select(
        "column_name", "severity", F.size("advice").cast("bigint").alias("n_advice"))


@query("missing_counts", MISSING + """
    SELECT column_name, missing_count, (SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty_lineitem)) FROM dirty_lineitem) AS duplicate_rows
    FROM gaps WHERE missing_count > 0""")
def missing_counts(spark, folder):
    return validate.missing_counts(_stats(spark, folder, "dirty_lineitem"))


@query("dup_rows", given("dup_orders") + """
    SELECT n AS n_rows, n - d AS duplicate_rows, CASE WHEN n > d THEN 'issue' ELSE 'info' END AS level FROM
    (SELECT count(*) AS n FROM dup_orders), (SELECT count(*) AS d FROM (SELECT DISTINCT * FROM dup_orders))""")
def dup_rows(spark, folder):
    return validate.duplicate_rows(_stats(spark, folder, "dup_orders"))


@query("dup_positions", given("dup_orders") + """
    SELECT * EXCLUDE (place) FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey, o_custkey, o_orderstatus, o_totalprice,
        o_orderdate, o_orderpriority ORDER BY o_orderkey) AS place FROM dup_orders) WHERE place > 1 ORDER BY o_orderkey LIMIT 100""")
def dup_positions(spark, folder):
    return validate.duplicate_positions(read(spark, folder, "dup_orders"), ["o_orderkey"])


REPEATS = given("dirty_lineitem")[:-1] + ", counts AS (" + each(DIRTY, """
    SELECT CAST({i} AS BIGINT) AS position, '{c}' AS column_name, count(DISTINCT {c}) AS unique_values, count(*) AS total_values FROM dirty_lineitem""") + ") "


@query("column_dups", REPEATS + f"""
    SELECT *, total_values - unique_values AS duplicate_count, {r("(total_values - unique_values) * 100.0 / total_values", 2)} AS duplicate_pct
    FROM counts WHERE total_values > unique_values""")
def column_dups(spark, folder):
    return validate.column_duplicates(_stats(spark, folder, "dirty_lineitem")).drop("is_problematic")


EVENT_COLUMNS = ["event_id", "ts", "user_id", "event_type", "value", "props"]


@query("identifier_dups", "WITH counts AS (" + each(EVENT_COLUMNS, """
    SELECT '{c}' AS column_name, count(DISTINCT {c}) AS unique_values, count(*) AS total_values FROM events""") + """)
    SELECT *, total_values - unique_values AS duplicate_count FROM counts WHERE total_values > unique_values
    AND regexp_matches(lower(column_name), 'id|email|phone|ssn|passport|username|account')""")
def identifier_dups(spark, folder):
    return validate.identifier_duplicates(_stats(spark, folder, "events")).select(
        "column_name", "unique_values", "total_values", "duplicate_count")


TEXT_PART = ["size_text", "size_clean", "price_text"]


@query("type_issues", given("text_part")[:-1] + ", bad AS (" + each(TEXT_PART, """
    SELECT '{c}' AS column_name, p_partkey, {c} AS value, row_number() OVER (ORDER BY p_partkey) AS place, count(*) OVER () AS non_numeric_count
    FROM text_part WHERE {c} IS NOT NULL AND TRY_CAST({c} AS DOUBLE) IS NULL""") + """)
    SELECT column_name, non_numeric_count, place, value FROM bad WHERE place <= 5""")
def type_issues(spark, folder):
    df = read(spark, folder, "text_part")
    found = validate.type_issues(TableStats(df)).select("column_name", "non_numeric_count")
    return found.join(validate.type_issue_samples(df, ["p_partkey"]), "column_name")


FENCES = given("dirty_lineitem")[:-1] + ", fences AS (" + each(DIRTY_NUMERIC, """
    SELECT CAST({i} AS BIGINT) AS i, '{c}' AS column_name, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM dirty_lineitem""") + """),
    bounds AS (SELECT column_name, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM fences), vals AS (""" + each(DIRTY_NUMERIC, """
    SELECT '{c}' AS column_name, CAST({c} AS DOUBLE) AS v FROM dirty_lineitem""") + ") "


@query("validator_outliers", FENCES + f"""
    SELECT column_name, count(*) FILTER (v < lo OR v > hi) AS outlier_count,
           {r("count(*) FILTER (v < lo OR v > hi) * 100.0 / count(*)", 2)} AS outlier_pct, {r("any_value(lo)")} AS lower_bound,
           {r("any_value(hi)")} AS upper_bound, {r("min(v) FILTER (v < lo OR v > hi)")} AS min_outlier, {r("max(v) FILTER (v < lo OR v > hi)")} AS max_outlier,
           CASE WHEN count(*) FILTER (v < lo OR v > hi) * 100.0 / count(*) > 5 THEN 'warning' ELSE 'info' END AS level
    FROM vals JOIN bounds USING (column_name) GROUP BY column_name HAVING outlier_count > 0""")
def validator_outliers(spark, folder):
    return rounded(validate.outliers(_stats(spark, folder, "dirty_lineitem")).drop("position"))


@query("outlier_values", """
    WITH b AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events),
    bad AS (SELECT value, row_number() OVER (ORDER BY ts, event_id) AS place FROM events, b
            WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1))
    SELECT 'value' AS column_name, place, value FROM bad WHERE place <= 10""")
def outlier_values(spark, folder):
    return validate.outlier_samples(_stats(spark, folder, "events"), ["ts", "event_id"]).withColumn(
        "value", F.col("value").cast("double"))


@query("format_whitespace", given("messy_customer") + """
    SELECT 'segment' AS column_name, count(*) FILTER (trim(segment) <> segment) AS affected_rows, 'whitespace' AS issue_type
    FROM messy_customer HAVING affected_rows > 0""")
def format_whitespace(spark, folder):
    return validate.whitespace(_stats(spark, folder, "messy_customer")).drop("position")


@query("format_case", given("messy_customer") + """
    SELECT 'segment' AS column_name, count(DISTINCT segment) AS n_unique, count(DISTINCT lower(segment)) AS n_unique_lower,
           'case_inconsistency' AS issue_type FROM messy_customer HAVING n_unique_lower < n_unique""")
def format_case(spark, folder):
    return validate.case_inconsistency(_stats(spark, folder, "messy_customer")).drop("position")


@query("date_issues", given("bad_dates")[:-1] + """, bad AS (SELECT order_date, row_number() OVER (ORDER BY o_orderkey) AS place,
    count(*) OVER () AS invalid_count FROM bad_dates WHERE order_date IS NOT NULL AND TRY_CAST(order_date AS TIMESTAMP) IS NULL)
    SELECT 'order_date' AS column_name, invalid_count, place, order_date AS value FROM bad WHERE place <= 5""")
def date_issues(spark, folder):
    df = read(spark, folder, "bad_dates")
    found = validate.date_issues(TableStats(df)).select("column_name", "invalid_count")
    return found.join(validate.date_issue_samples(df, ["o_orderkey"]), "column_name")


@query("high_cardinality", "WITH counts AS (" + " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(DISTINCT {c}) AS unique_count, count(*) AS total_rows FROM {t}"
    for t, c in (("documents", "text"), ("documents", "lang"), ("documents", "source"), ("customer", "c_name"),
                 ("customer", "c_mktsegment"), ("pages", "url"), ("pages", "html"))) + f""")
    SELECT *, {r("unique_count * 100.0 / total_rows", 2)} AS uniqueness_pct FROM counts WHERE unique_count * 1.0 / total_rows > 0.5""")
def high_cardinality(spark, folder):
    found = [validate.high_cardinality(_stats(spark, folder, t)).select(
        F.lit(t).alias("table_name"), "column_name", "unique_count", "total_rows", "uniqueness_pct")
        for t in ("documents", "customer", "pages")]
    return found[0].unionAll(found[1]).unionAll(found[2])


@query("low_variance_cat", given("dirty_lineitem") + "SELECT * FROM (" + each(DIRTY_TEXT, f"""
    (SELECT '{{c}}' AS column_name, {{c}} AS most_common_value, {r("count(*) * 100.0 / (SELECT count(*) FROM dirty_lineitem)", 2)} AS most_common_pct
     FROM dirty_lineitem WHERE {{c}} IS NOT NULL GROUP BY {{c}} ORDER BY count(*) DESC, {{c}} LIMIT 1)""") + ") WHERE most_common_pct > 95")
def low_variance_cat(spark, folder):
    return validate.low_variance_categorical(_stats(spark, folder, "dirty_lineitem"))


@query("low_variance_num", given("dirty_lineitem") + "SELECT * FROM (" + each(DIRTY_NUMERIC, f"""
    SELECT '{{c}}' AS column_name, {r("var_samp({c})", 6)} AS variance FROM dirty_lineitem""") + ") WHERE variance < 0.01")
def low_variance_num(spark, folder):
    return validate.low_variance_numeric(_stats(spark, folder, "dirty_lineitem")).drop("position")


CLASS_SQL = r"""CASE WHEN {c} IS NULL THEN NULL WHEN regexp_matches({c}, '^\s*[+-]?[0-9]+\s*$') THEN 'int'
    WHEN TRY_CAST({c} AS DOUBLE) IS NOT NULL THEN 'float' WHEN lower(trim({c})) IN ('true', 'false') THEN 'bool'
    WHEN TRY_CAST({c} AS TIMESTAMP) IS NOT NULL THEN 'timestamp' ELSE 'text' END"""


@query("mixed_types", given("text_part") + "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(DISTINCT {CLASS_SQL.format(c=c)}) AS n_classes, "
    f"string_agg(DISTINCT {CLASS_SQL.format(c=c)}, ',' ORDER BY {CLASS_SQL.format(c=c)}) AS classes FROM text_part"
    for c in TEXT_PART) + ") WHERE n_classes > 1")
def mixed_types(spark, folder):
    return validate.mixed_types(read(spark, folder, "text_part"))


@query("empty_columns", """
    WITH t AS (SELECT o_orderkey, CASE WHEN o_totalprice < 0 THEN o_totalprice END AS refund, o_orderstatus FROM orders)
    SELECT * FROM (SELECT CAST(0 AS BIGINT) AS position, 'o_orderkey' AS column_name, count(o_orderkey) AS n FROM t
    UNION ALL SELECT 1, 'refund', count(refund) FROM t UNION ALL SELECT 2, 'o_orderstatus', count(o_orderstatus) FROM t) WHERE n = 0""")
def empty_columns(spark, folder):
    df = read(spark, folder, "orders").selectExpr(
        "o_orderkey", "CASE WHEN o_totalprice < 0 THEN o_totalprice END AS refund", "o_orderstatus")
    return validate.empty_columns(TableStats(df)).withColumn("n", F.lit(0).cast("bigint"))


@query("validate_all", given("dirty_lineitem")[:-1] + ", gaps AS (" + each(DIRTY, """
    SELECT '{c}' AS column_name, count(*) - count({c}) AS m, count(*) AS n FROM dirty_lineitem""") + """),
    fences AS (""" + each(DIRTY_NUMERIC, """
    SELECT '{c}' AS column_name, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3, var_samp({c}) AS variance FROM dirty_lineitem""") + """),
    vals AS (""" + each(DIRTY_NUMERIC, "SELECT '{c}' AS column_name, CAST({c} AS DOUBLE) AS v FROM dirty_lineitem") + """),
    outliers AS (SELECT column_name, count(*) FILTER (v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS m, count(*) AS n
                 FROM vals JOIN fences USING (column_name) GROUP BY column_name),
    texts AS (""" + each(DIRTY_TEXT, """
    SELECT '{c}' AS column_name, count({c}) FILTER (TRY_CAST({c} AS DOUBLE) IS NULL) AS bad, count(DISTINCT {c}) AS u, count(DISTINCT lower({c})) AS ul,
           count(*) FILTER (trim({c}) <> {c}) AS padded, count(*) AS n,
           (SELECT max(k) FROM (SELECT count(*) AS k FROM dirty_lineitem WHERE {c} IS NOT NULL GROUP BY {c})) AS top FROM dirty_lineitem""") + """)
    SELECT 'missing_values' AS check_name, column_name, CASE WHEN m * 100.0 / n > 50 THEN 'issue' WHEN m * 100.0 / n > 5 THEN 'warning' ELSE 'info' END AS level,
           m AS metric FROM gaps WHERE m > 0
    UNION ALL SELECT 'duplicate_rows', '*', 'issue', d FROM (SELECT (SELECT count(*) FROM dirty_lineitem) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty_lineitem)) AS d) WHERE d > 0
    UNION ALL SELECT 'type_issues', column_name, 'warning', bad FROM texts WHERE bad > 0
    UNION ALL SELECT 'outliers', column_name, CASE WHEN m * 100.0 / n > 5 THEN 'warning' ELSE 'info' END, m FROM outliers WHERE m > 0
    UNION ALL SELECT 'whitespace', column_name, 'info', padded FROM texts WHERE padded > 0
    UNION ALL SELECT 'case_inconsistency', column_name, 'info', u - ul FROM texts WHERE ul < u
    UNION ALL SELECT 'high_cardinality', column_name, 'warning', u FROM texts WHERE u * 1.0 / n > 0.5
    UNION ALL SELECT 'low_variance', column_name, 'info', NULL FROM texts WHERE top * 100.0 / n > 95
    UNION ALL SELECT 'low_variance', column_name, 'info', NULL FROM fences WHERE variance < 0.01""")
def validate_all(spark, folder):
    return validate.validate_all(_stats(spark, folder, "dirty_lineitem")).drop("message")
