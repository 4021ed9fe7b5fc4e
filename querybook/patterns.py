"""Patterns in dates, categories, numbers and missing values."""

from colsift.operators import patterns
from colsift.plans.stats import TableStats
from querybook.base import DIRTY_NUMERIC, DIRTY_TEXT, each, given, query, r, read, rounded
from querybook.correlation import COMISSING, gap_pairs

T = "dirty_lineitem"


def _stats(spark, folder, name):
    return TableStats(read(spark, folder, name), "A")


DAYS = "SELECT DISTINCT o_orderdate FROM orders"
TIMES = {"days": "o_orderdate", "orders": "o_orderdate", "events": "ts", "lineitem": "l_shipdate"}
GAPS = f"WITH days AS ({DAYS}), gaps AS (" + " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{c}' AS column_name, (SELECT avg(gap) FROM (SELECT epoch({c} - lag({c}) OVER (ORDER BY {c})) / 86400.0 AS gap FROM {t})) AS mean_gap"
    for t, c in TIMES.items()) + ") "


def _with_days(spark, folder, operator):
    found = None
    for t in TIMES:
        df = read(spark, folder, "orders").select("o_orderdate").distinct() if t == "days" else read(spark, folder, t)
        part = operator(TableStats(df, "A")).selectExpr(f"'{t}' AS table_name", "*")
        found = part if found is None else found.unionAll(part)
    return found


@query("temporal_gap", GAPS + f"SELECT table_name, column_name, {r('mean_gap', 6)} AS mean_gap_days FROM gaps")
def temporal_gap(spark, folder):
    return rounded(_with_days(spark, folder, patterns.temporal_gaps), 6)


@query("temporal_pattern", GAPS + """
    SELECT table_name, 'temporal' AS type, column_name, CASE WHEN mean_gap > 0.9 AND mean_gap < 1.1 THEN 'daily frequency'
           WHEN mean_gap > 6.5 AND mean_gap < 7.5 THEN 'weekly frequency' ELSE 'monthly frequency' END AS pattern
    FROM gaps WHERE (mean_gap > 0.9 AND mean_gap < 1.1) OR (mean_gap > 6.5 AND mean_gap < 7.5) OR (mean_gap > 28 AND mean_gap < 32)""")
def temporal_pattern(spark, folder):
    return _with_days(spark, folder, patterns.temporal_patterns)


def categorical_sql(table, columns):
    counts = " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, max(k) AS top, min(k) AS low, count(*) AS u, sum(k) AS n FROM (SELECT count(*) AS k FROM {table} WHERE {c} IS NOT NULL GROUP BY {c})"
        for c in columns)
    return f"""
    SELECT 'categorical' AS type, column_name, concat('dominated by one category (', CAST(round(top * 100.0 / n, 1) AS DECIMAL(5, 1)), '%)') AS pattern
    FROM ({counts}) WHERE top * 100.0 / n > 80
    UNION ALL SELECT 'categorical', column_name, 'relatively uniform distribution' FROM ({counts}) WHERE u > 5 AND top * 1.0 / low < 2"""


@query("categorical_pattern", given(T) + categorical_sql(T, DIRTY_TEXT) + " UNION ALL " + categorical_sql("part", ["p_name", "p_brand", "p_type"]))
def categorical_pattern(spark, folder):
    return patterns.categorical_patterns(_stats(spark, folder, T)).unionAll(
        patterns.categorical_patterns(_stats(spark, folder, "part")))


def numeric_sql(table, columns):
    counts = each(columns, f"""
        SELECT '{{c}}' AS column_name, count({{c}}) AS n, count(*) FILTER (abs({{c}} - round_even({{c}}, 0)) < 1e-10) AS whole, count(DISTINCT {{c}}) AS u FROM {table}""")
    return f"""
    SELECT 'numerical' AS type, column_name, 'mostly whole numbers' AS pattern FROM ({counts}) WHERE n > 10 AND whole * 1.0 / n > 0.8
    UNION ALL SELECT 'numerical', column_name, CASE u WHEN 1 THEN 'constant value' ELSE 'binary' END FROM ({counts}) WHERE n > 10 AND u IN (1, 2)"""


@query("numeric_pattern", given(T) + numeric_sql(T, DIRTY_NUMERIC) + " UNION ALL " + numeric_sql("labels", ["doc_id", "quality", "toxic"]))
def numeric_pattern(spark, folder):
    return patterns.numeric_patterns(_stats(spark, folder, T)).unionAll(
        patterns.numeric_patterns(_stats(spark, folder, "labels")))


MISSING = f"""SELECT 'missing' AS type, c1 AS column_name, concat('missing values occur together with ''', c2, '''') AS pattern
    FROM ({gap_pairs("comissing_orders", COMISSING)}) WHERE r > 0.8"""


@query("missing_pattern", given("comissing_orders") + MISSING)
def missing_pattern(spark, folder):
    return patterns.missing_patterns(_stats(spark, folder, "comissing_orders"))


@query("detect_patterns", given("comissing_orders") + " UNION ALL ".join([
    categorical_sql("comissing_orders", ["o_orderpriority", "o_orderstatus"]),
    numeric_sql("comissing_orders", ["o_orderkey", "o_totalprice"]), MISSING]))
def detect_patterns(spark, folder):
    return patterns.detect_patterns(_stats(spark, folder, "comissing_orders"))
