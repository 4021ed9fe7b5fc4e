"""Time series, chart data and the reports that need histograms."""

from itertools import combinations

from pyspark.sql import functions as F

from colsift.operators import charts, reports, timeseries
from colsift.plans.stats import TableStats
from querybook.base import LINEITEM, LINEITEM_NUMERIC, each, given, query, r, read, rounded
from querybook.distribution import AUTO, EVENT_NUMBERS, _moments, _outside, bins_sql, k2_sql
from querybook.insight import insights_sql, quality_sql, readiness_sql
from querybook.profiles import KURTOSIS, SMALL_G1, _top, long_sql

G = "gappy_events"


def _daily(table, time, value):
    return f"SELECT CAST({time} AS DATE) AS d, avg({value}) AS m FROM {table} WHERE {time} IS NOT NULL AND {value} IS NOT NULL GROUP BY 1"


@query("ts_daily", given(G) + f"""
    SELECT strftime(g.d, '%Y-%m-%d') AS day, {r("m")} AS mean_value FROM
    (SELECT CAST(unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS DATE) AS d FROM ({_daily(G, "ts", "value")})) g
    LEFT JOIN ({_daily(G, "ts", "value")}) v ON g.d = v.d""")
def ts_daily(spark, folder):
    return rounded(timeseries.daily(read(spark, folder, G), "ts", "value"))


MONTHLY = "SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS d, avg(o_totalprice) AS m FROM orders WHERE month(o_orderdate) % 5 <> 0 GROUP BY 1"


@query("ts_monthly", f"""
    SELECT strftime(g.d, '%Y-%m') AS month, {r("m")} AS mean_value FROM
    (SELECT CAST(unnest(generate_series(min(d), max(d), INTERVAL 1 MONTH)) AS DATE) AS d FROM ({MONTHLY})) g LEFT JOIN ({MONTHLY}) v ON g.d = v.d""")
def ts_monthly(spark, folder):
    orders = read(spark, folder, "orders").filter(F.month("o_orderdate") % 5 != 0)
    return rounded(timeseries.monthly(orders, "o_orderdate", "o_totalprice"))


def _trend(table, time, value):
    return f"""
    SELECT '{table}' AS table_name, CASE WHEN s > 0 THEN 'increasing' WHEN s < 0 THEN 'decreasing' ELSE 'stable' END AS direction,
           {r("s", 4)} AS slope, {r("abs(c)", 2)} AS strength, n AS n_days FROM (
        SELECT regr_slope(m, x) AS s, corr(m, x) AS c, count(*) AS n FROM (
            SELECT m, CAST(row_number() OVER (ORDER BY d) - 1 AS DOUBLE) AS x FROM ({_daily(table, time, value)})))"""


@query("ts_trend", given(G) + _trend(G, "ts", "value") + " UNION ALL " + _trend("orders", "o_orderdate", "o_totalprice"))
def ts_trend(spark, folder):
    found = [timeseries.trend(read(spark, folder, t), time, value).select(F.lit(t).alias("table_name"), "*")
             for t, time, value in ((G, "ts", "value"), ("orders", "o_orderdate", "o_totalprice"))]
    return found[0].unionAll(found[1])


@query("ts_range", given(G) + f"""
    SELECT min(ts) AS start, max(ts) AS "end", CAST(floor(epoch(max(ts) - min(ts)) / 86400) AS BIGINT) AS duration_days FROM {G} WHERE value IS NOT NULL""")
def ts_range(spark, folder):
    return timeseries.time_range(read(spark, folder, G), "ts", "value")


@query("viz_histograms", " UNION ALL ".join(bins_sql("lineitem", c, "20") for c in LINEITEM_NUMERIC[:5]))
def viz_histograms(spark, folder):
    return rounded(charts.histograms(TableStats(read(spark, folder, "lineitem"))))


@query("viz_boxplots", given("dirty_lineitem") + each(LINEITEM_NUMERIC[:5], f"""
    SELECT '{{c}}' AS column_name, {r("min({c})")} AS "min", {r("quantile_cont({c}, 0.25)")} AS q1, {r("quantile_cont({c}, 0.5)")} AS median,
           {r("quantile_cont({c}, 0.75)")} AS q3, {r("max({c})")} AS "max" FROM dirty_lineitem"""))
def viz_boxplots(spark, folder):
    return rounded(charts.boxplots(TableStats(read(spark, folder, "dirty_lineitem"))))


@query("viz_boxplot_outliers", """
    WITH b AS (SELECT quantile_cont(n_chars, 0.25) AS q1, quantile_cont(n_chars, 0.75) AS q3 FROM documents),
    bad AS (SELECT n_chars, row_number() OVER (ORDER BY doc_id) AS place FROM documents, b
            WHERE n_chars < q1 - 1.5 * (q3 - q1) OR n_chars > q3 + 1.5 * (q3 - q1))
    SELECT 'n_chars' AS column_name, place, CAST(n_chars AS VARCHAR) AS value FROM bad WHERE place <= 50""")
def viz_boxplot_outliers(spark, folder):
    return charts.boxplot_outliers(TableStats(read(spark, folder, "documents")), ["doc_id"])


@query("viz_bars", _top("p_name", 10, "part") + " UNION ALL " + _top("p_brand", 10, "part") + " UNION ALL " + _top("p_type", 10, "part"))
def viz_bars(spark, folder):
    return charts.bars(TableStats(read(spark, folder, "part")))


HEAT = " UNION ALL ".join(f"SELECT '{a}' AS c1, '{b}' AS c2, corr({a}, {b}) AS r FROM lineitem" for a in LINEITEM_NUMERIC for b in LINEITEM_NUMERIC)


@query("viz_heatmap", f"SELECT c1, c2, {r('r', 6)} AS r FROM ({HEAT})")
def viz_heatmap(spark, folder):
    return rounded(charts.heatmap(TableStats(read(spark, folder, "lineitem"))), 6)



@query("viz_scatter", given("sparse_events") + " UNION ALL ".join(f"""
    SELECT * FROM (SELECT '{a}' AS x_column, '{b}' AS y_column, row_number() OVER (ORDER BY ts, event_id) AS place, CAST({a} AS DOUBLE) AS x, CAST({b} AS DOUBLE) AS y
    FROM ({f"SELECT ts, event_id, event_id * 2 AS double_id, value FROM sparse_events"}) WHERE {a} IS NOT NULL AND {b} IS NOT NULL) WHERE place <= 500"""
    for a, b in combinations(["event_id", "double_id", "value"], 2)))
def viz_scatter(spark, folder):
    df = read(spark, folder, "sparse_events").selectExpr("ts", "event_id", "event_id * 2 AS double_id", "value")
    return charts.scatter(TableStats(df), ["ts", "event_id"])


EVENT_COLUMNS = ["event_id", "ts", "user_id", "event_type", "value", "props"]
NUMERIC_EVENTS = each(EVENT_NUMBERS, f"""
    SELECT '{{c}}' AS column_name, count({{c}}) AS "count", avg({{c}}) AS mean, stddev_pop({{c}}) AS std, min({{c}}) AS "min",
           quantile_cont({{c}}, 0.25) AS p25, quantile_cont({{c}}, 0.5) AS median, quantile_cont({{c}}, 0.75) AS p75, max({{c}}) AS "max",
           {SMALL_G1} AS skewness, {KURTOSIS} AS kurtosis, max({{c}}) - min({{c}}) AS "range",
           quantile_cont({{c}}, 0.75) - quantile_cont({{c}}, 0.25) AS iqr FROM events""")
TOP_EVENTS = " UNION ALL ".join(
    f"SELECT top.*, u AS unique_values, m AS missing_values FROM {_top(c, 5, 'events')} top, "
    f"(SELECT count(DISTINCT {c}) AS u, count(*) - count({c}) AS m FROM events)" for c in ("event_type", "props"))


@query("statistical", " UNION ALL ".join([
    long_sql("numerical", NUMERIC_EVENTS, ["count", "mean", "std", "min", "p25", "median", "p75", "max", "skewness", "kurtosis", "range", "iqr"]),
    long_sql("categorical", TOP_EVENTS, ["cnt", "unique_values", "missing_values"], "concat(column_name, '=', value)"),
    long_sql("histogram", " UNION ALL ".join(bins_sql("events", c, AUTO) for c in EVENT_NUMBERS), ["lower", "upper", "cnt"], "concat(column_name, '[', bin, ']')"),
    long_sql("outliers", f"SELECT * FROM ({_outside('events', EVENT_NUMBERS)}) WHERE outlier_count > 0", ["outlier_count", "outlier_pct", "lower_bound", "upper_bound"])])
    + " UNION ALL SELECT * FROM (" + long_sql("normality", k2_sql(_moments("events", EVENT_NUMBERS)), ["statistic", "p_value"])
    + ") WHERE (SELECT count(*) FROM events) <= 5000")
def statistical(spark, folder):
    stats = TableStats(read(spark, folder, "events"), "A")
    # Shapiro-Wilk has no SQL counterpart; the table is beyond its size limit at every scale above the smallest
    return rounded(reports.statistical_analysis(stats).filter("metric <> 'w'"))


@query("full_report", f"WITH said AS (SELECT * FROM {insights_sql('lineitem', LINEITEM, ['l_returnflag', 'l_linestatus'], LINEITEM_NUMERIC)}) " + " UNION ALL ".join([
    long_sql("overview", "SELECT '*' AS column_name, count(*) AS total_rows, 11 AS total_columns, 8 AS numeric_columns, 2 AS categorical_columns, 1 AS datetime_columns FROM lineitem",
             ["total_rows", "total_columns", "numeric_columns", "categorical_columns", "datetime_columns"]),
    long_sql("columns", each(LINEITEM, f"""SELECT '{{c}}' AS column_name, count({{c}}) AS non_null_count, count(*) - count({{c}}) AS null_count,
        {r("(count(*) - count({c})) * 100.0 / count(*)", 2)} AS null_pct, count(DISTINCT {{c}}) AS unique_values, {r("count(DISTINCT {c}) * 1.0 / count(*)", 4)} AS uniqueness_ratio FROM lineitem"""),
             ["non_null_count", "null_count", "null_pct", "unique_values", "uniqueness_ratio"]),
    long_sql("describe", each(LINEITEM_NUMERIC, """SELECT '{c}' AS column_name, count({c}) AS "count", avg({c}) AS mean, stddev_samp({c}) AS std, min({c}) AS "min",
        quantile_cont({c}, 0.25) AS p25, quantile_cont({c}, 0.5) AS p50, quantile_cont({c}, 0.75) AS p75, max({c}) AS "max" FROM lineitem"""),
             ["count", "mean", "std", "min", "p25", "p50", "p75", "max"]),
    "SELECT 'correlation' AS section, concat(c1, ' ~ ', c2) AS column_name, 'r' AS metric, " + r("r", 3) + " AS value FROM (" + " UNION ALL ".join(
        f"SELECT '{a}' AS c1, '{b}' AS c2, corr({a}, {b}) AS r FROM lineitem" for a, b in combinations(LINEITEM_NUMERIC, 2)) + ") WHERE abs(r) > 0.7",
    long_sql("normality", k2_sql(_moments("lineitem", LINEITEM_NUMERIC)), ["p_value"]),
    long_sql("categories", each(["l_returnflag", "l_linestatus"], f"""SELECT '{{c}}' AS column_name, count(DISTINCT {{c}}) AS unique_count,
        {r("count(DISTINCT {c}) * 1.0 / count(*)", 4)} AS cardinality_ratio FROM lineitem"""), ["unique_count", "cardinality_ratio"]),
    long_sql("quality", "SELECT '*' AS column_name, * FROM (" + quality_sql("lineitem", LINEITEM) + ")", ["completeness", "uniqueness", "validity", "overall_score"]),
    """SELECT 'insight', '*', concat(title, ': ', message), CAST(row_number() OVER (ORDER BY place) AS DOUBLE) FROM (SELECT place, title, message FROM said
       UNION ALL SELECT 9, 'Data Looks Great!', 'No major issues detected' FROM (SELECT count(*) AS k FROM said) WHERE k = 0)""",
    long_sql("readiness", f"SELECT '*' AS column_name, greatest(0, 100 - sum(cost)) AS readiness_score FROM {readiness_sql('lineitem', LINEITEM, 8, ['l_returnflag', 'l_linestatus'])}",
             ["readiness_score"])]))
def full_report(spark, folder):
    return rounded(reports.full_report(TableStats(read(spark, folder, "lineitem"))))
