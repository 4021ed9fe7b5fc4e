"""Scores, insights, recommendations, readiness and whole reports."""

from itertools import combinations

from pyspark.sql import functions as F

from colsift.operators import clean, correlate, insights, outliers, patterns, profile, reports, scores
from colsift.plans.stats import TableStats
from querybook.base import DIRTY, DIRTY_NUMERIC, DIRTY_TEXT, ORDERS, each, LINEITEM, given, query, r, read, rounded
from querybook.correlation import PAIRS, gap_pairs
from querybook.patterns import categorical_sql, numeric_sql
from querybook.profiles import MEASURES_A, NUMERIC_A, long_sql

T = "dirty_lineitem"


def _stats(spark, folder, name=T, flavor="E"):
    return TableStats(read(spark, folder, name), flavor)


def facts_sql(table, columns):
    """One row: rows, cells, missing cells, duplicate rows."""
    gaps = " + ".join(f"(count(*) - count({c}))" for c in columns)
    return f"""(SELECT count(*) AS n_rows, count(*) * {len(columns)} AS n_cells, {gaps} AS n_missing,
        count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {table})) AS n_duplicate FROM {table})"""


def quality_sql(table, columns):
    return f"""
    SELECT {r("c", 2)} AS completeness, {r("u", 2)} AS uniqueness, 100.0::DOUBLE AS validity, {r("score", 2)} AS overall_score,
           CASE WHEN score >= 90 THEN 'A (Excellent)' WHEN score >= 80 THEN 'B (Good)' WHEN score >= 70 THEN 'C (Fair)' WHEN score >= 60 THEN 'D (Poor)'
                ELSE 'F (Failing)' END AS grade
    FROM (SELECT c, u, c * 0.4::DOUBLE + u * 0.3::DOUBLE + 30 AS score FROM (
        SELECT (n_cells - n_missing) * 100.0::DOUBLE / n_cells AS c, (n_rows - n_duplicate) * 100.0::DOUBLE / n_rows AS u FROM {facts_sql(table, columns)}))"""


@query("quality_score_e", given(T, "dup_orders") + quality_sql(T, DIRTY) + " UNION ALL " + quality_sql("dup_orders", ORDERS))
def quality_score_e(spark, folder):
    return scores.quality_score(_stats(spark, folder)).unionAll(scores.quality_score(_stats(spark, folder, "dup_orders")))


def deductions_sql(table, columns, texts):
    """(kind, column_name, deduction), one row per issue."""
    gaps = each(columns, f"SELECT '{{c}}' AS column_name, (count(*) - count({{c}})) * 100.0 / count(*) AS pct FROM {table}")
    stored = each(texts, f"SELECT '{{c}}' AS column_name, count({{c}}) FILTER (TRY_CAST({{c}} AS DOUBLE) IS NULL) AS bad FROM {table}") if texts else \
        "SELECT '' AS column_name, 1 AS bad"
    return f"""(SELECT 'missing' AS kind, column_name, CASE WHEN pct > 50 THEN 15 WHEN pct > 20 THEN 10 ELSE 5 END AS deduction FROM ({gaps}) WHERE pct > 5
        UNION ALL SELECT 'duplicates', '*', 10 FROM {facts_sql(table, columns)} WHERE n_duplicate > 0
        UNION ALL SELECT 'numeric text', column_name, 5 FROM ({stored}) WHERE bad = 0)"""


def deducting_sql(table, columns, texts):
    return f"""SELECT CAST(greatest(0, 100 - coalesce(sum(deduction), 0)) AS BIGINT) AS quality_score, count(*) AS n_issues,
        any_value(n_duplicate) AS duplicate_rows, any_value(n_missing) AS total_missing_cells
        FROM {facts_sql(table, columns)} LEFT JOIN {deductions_sql(table, columns, texts)} ON true"""


PART_TEXT = ["p_partkey", "size_text", "size_clean", "price_text"]


@query("quality_score_a", given(T, "text_part", "dup_orders") + f"""
    SELECT table_name, quality_score, CASE WHEN quality_score = 100 THEN 0 ELSE n_issues END AS n_issues, duplicate_rows, total_missing_cells FROM (
    SELECT '{T}' AS table_name, * FROM ({deducting_sql(T, DIRTY, DIRTY_TEXT)})
    UNION ALL SELECT 'text_part', * FROM ({deducting_sql("text_part", PART_TEXT, PART_TEXT[1:])})
    UNION ALL SELECT 'dup_orders', * FROM ({deducting_sql("dup_orders", ORDERS, ["o_orderstatus", "o_orderpriority"])}))""")
def quality_score_a(spark, folder):
    found = [scores.deducting_score(_stats(spark, folder, t, "A")).select(F.lit(t).alias("table_name"), "*")
             for t in (T, "text_part", "dup_orders")]
    return found[0].unionAll(found[1]).unionAll(found[2])


@query("quality_issues", given("text_part") + f"SELECT column_name, CAST(deduction AS BIGINT) AS deduction FROM {deductions_sql('text_part', PART_TEXT, PART_TEXT[1:])}")
def quality_issues(spark, folder):
    return scores.quality_issues(_stats(spark, folder, "text_part", "A")).select("column_name", "deduction")


def insights_sql(table, columns, texts, numbers):
    """Titles and messages of flavor E."""
    pairs = " + ".join(f"(SELECT CAST(coalesce(abs(corr({a}, {b})) > 0.8, false) AS INT) FROM {table} WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"
                       for a, b in combinations(numbers, 2)) or "0"
    unlike = " UNION ALL ".join(f"SELECT {i} AS i, '{c}' AS c, count(DISTINCT {c}) * 1.0 / count(*) AS share FROM {table}" for i, c in enumerate(texts))
    uneven = " UNION ALL ".join(f"SELECT {i} AS i, '{c}' AS c, max(k) AS top, min(k) AS low, count(*) AS u FROM (SELECT count(*) AS k FROM {table} WHERE {c} IS NOT NULL GROUP BY {c})"
                                for i, c in enumerate(texts))
    return f"""(SELECT 1 AS place, 'warning' AS type, 'High Missing Data' AS title, concat(CAST(round(n_missing * 100.0 / n_cells, 1) AS DECIMAL(5, 1)), '% of your data is missing') AS message
        FROM {facts_sql(table, columns)} WHERE n_missing * 100.0 / n_cells > 10
        UNION ALL SELECT 2, 'warning', 'Duplicate Rows Detected', concat('Found ', n_duplicate, ' duplicate rows') FROM {facts_sql(table, columns)} WHERE n_duplicate > 0
        UNION ALL SELECT 3, 'info', 'High Cardinality Columns', concat('Columns with too many unique values: ', string_agg(c, ', ' ORDER BY i)) FROM ({unlike}) WHERE share > 0.5 HAVING count(*) > 0
        UNION ALL SELECT 4, 'success', 'Strong Correlations Found', concat('Found ', k, ' strong relationships between columns') FROM (SELECT {pairs} AS k) WHERE k > 0
        UNION ALL (SELECT 5, 'warning', 'Imbalanced Categories', concat('Column ''', c, ''' is heavily imbalanced') FROM ({uneven}) WHERE u = 2 AND top > 5 * low ORDER BY i LIMIT 1))"""


INSIGHT_TABLES = {
    T: (DIRTY, DIRTY_TEXT, ["l_extendedprice", "l_net", "l_quantity"]),
    "sparse_events": (["event_id", "ts", "value", "event_type", "flag"], ["event_type", "flag"], ["event_id", "value"]),
    "customer": (["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"], ["c_name", "c_mktsegment"], ["c_custkey", "c_nationkey", "c_acctbal"]),
    "orders": (ORDERS, ["o_orderstatus", "o_orderpriority"], ["o_orderkey", "o_custkey", "o_totalprice"]),
}


@query("insights_e", given(T, "sparse_events")[:-1] + "".join(f", said_{t} AS (SELECT * FROM {insights_sql(t, *cs)})" for t, cs in INSIGHT_TABLES.items())
       + " " + " UNION ALL ".join(f"""SELECT '{t}' AS table_name, type, title, message FROM said_{t}
       UNION ALL SELECT '{t}', 'success', 'Data Looks Great!', 'No major issues detected' FROM (SELECT count(*) AS k FROM said_{t}) WHERE k = 0""" for t in INSIGHT_TABLES))
def insights_e(spark, folder):
    found = None
    for t in INSIGHT_TABLES:
        part = insights.insights(_stats(spark, folder, t)).select(F.lit(t).alias("table_name"), "type", "title", "message")
        found = part if found is None else found.unionAll(part)
    return found


def key_insights_sql(table, columns, numbers, texts, pairs="0", outlying="0"):
    return f"""(SELECT 1 AS place, CASE WHEN n_rows > 10000 THEN 'Large dataset suitable for complex modeling' ELSE 'Small dataset - consider collecting more data' END AS message
        FROM {facts_sql(table, columns)} WHERE n_rows > 10000 OR n_rows < 100
        UNION ALL SELECT 2, CASE WHEN m > 20 THEN concat('High missing data (', CAST(round(m, 1) AS DECIMAL(5, 1)), '%) - consider imputation')
            WHEN m > 5 THEN concat('Moderate missing data (', CAST(round(m, 1) AS DECIMAL(5, 1)), '%)') ELSE 'Minimal missing data - good quality' END
        FROM (SELECT n_missing * 100.0 / n_cells AS m FROM {facts_sql(table, columns)})
        UNION ALL SELECT 3, '{f"Many numerical features ({numbers})" if numbers > 10 else f"Suitable numerical features ({numbers})"}' WHERE {numbers} > 0
        UNION ALL SELECT 4, 'Multiple categorical variables ({texts})' WHERE {texts} > 5
        UNION ALL SELECT 5, concat('Found ', k, ' highly correlated pairs') FROM (SELECT {pairs} AS k) WHERE k > 0
        UNION ALL SELECT 6, concat('Outliers in ', k, ' columns') FROM (SELECT {outlying} AS k) WHERE k > 0)"""


def many_outliers_sql(table, columns):
    return f"""(SELECT count(*) FROM ({many_outliers_rows(table, columns)}) WHERE pct > 5)"""


def many_outliers_rows(table, columns):
    return " UNION ALL ".join(f"""SELECT {i} AS i, '{c}' AS c, (SELECT count(*) FROM {table} WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) * 100.0 / n AS pct
        FROM (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3, count({c}) AS n FROM {table})""" for i, c in enumerate(columns))


def numbered(inner):
    return f"SELECT row_number() OVER (ORDER BY place) AS rank, message FROM {inner}"


DOCUMENTS = ["doc_id", "text", "lang", "source", "n_chars"]
KEY_DOCS = key_insights_sql("documents", DOCUMENTS, 2, 3, outlying=many_outliers_sql("documents", ["doc_id", "n_chars"]))
KEY_DIRTY = key_insights_sql(T, DIRTY, 10, 3, pairs="(SELECT count(*) FROM pairs WHERE abs(r) >= 0.8)", outlying=many_outliers_sql(T, DIRTY_NUMERIC))


@query("insights_a", PAIRS + f"SELECT 'documents' AS table_name, * FROM ({numbered(KEY_DOCS)}) UNION ALL SELECT '{T}', * FROM ({numbered(KEY_DIRTY)})")
def insights_a(spark, folder):
    return (insights.key_insights(_stats(spark, folder, "documents", "A")).select(F.lit("documents").alias("table_name"), "*")
            .unionAll(insights.key_insights(_stats(spark, folder, T, "A")).select(F.lit(T), "*")))


def recommendations_sql(table, columns, texts, numbers, pairs="0"):
    gaps = " UNION ALL ".join(f"SELECT {i} AS i, '{c}' AS c, round((count(*) - count({c})) * 100.0 / count(*), 2) AS pct FROM {table}" for i, c in enumerate(columns))
    return f"""(SELECT 1 AS place, 'Address data quality issues' AS message FROM ({deducting_sql(table, columns, texts)}) WHERE quality_score < 70
        UNION ALL SELECT 2, concat('Remove ', n_duplicate, ' duplicates') FROM {facts_sql(table, columns)} WHERE n_duplicate > 0
        UNION ALL SELECT 3, concat('Handle high missing values in: ', string_agg(c, ', ' ORDER BY i)) FROM (SELECT * FROM ({gaps}) WHERE pct > 20 ORDER BY i LIMIT 3) HAVING count(*) > 0
        UNION ALL SELECT 4, concat('Investigate outliers in: ', string_agg(c, ', ' ORDER BY i)) FROM (SELECT * FROM ({many_outliers_rows(table, numbers)}) WHERE pct > 5 ORDER BY i LIMIT 3) HAVING count(*) > 0
        UNION ALL SELECT 5, 'Remove highly correlated features' FROM (SELECT {pairs} AS k) WHERE k > 0
        UNION ALL SELECT 6, 'Scale numerical features for ML' WHERE {len(numbers)} > 0
        UNION ALL SELECT 7, 'Encode categorical variables' WHERE {len(texts)} > 0
        UNION ALL SELECT 8, 'Split data for model validation')"""


REC_DIRTY = recommendations_sql(T, DIRTY, DIRTY_TEXT, DIRTY_NUMERIC, "(SELECT count(*) FROM pairs WHERE abs(r) >= 0.9)")


@query("recommendations_a", PAIRS + f"""SELECT '{T}' AS table_name, * FROM ({numbered(REC_DIRTY)})
    UNION ALL SELECT 'documents', * FROM ({numbered(recommendations_sql("documents", DOCUMENTS, ["text", "lang", "source"], ["doc_id", "n_chars"]))})""")
def recommendations_a(spark, folder):
    return (insights.recommendations(_stats(spark, folder, T, "A")).select(F.lit(T).alias("table_name"), "*")
            .unionAll(insights.recommendations(_stats(spark, folder, "documents", "A")).select(F.lit("documents"), "*")))


@query("insights_summary", PAIRS[:-1] + f""", score AS ({deducting_sql(T, DIRTY, DIRTY_TEXT)}),
    gaps AS ({each(DIRTY, f"SELECT round((count(*) - count({{c}})) * 100.0 / count(*), 2) AS pct FROM {T}")}),
    said AS (SELECT 1.0 AS place, concat('Dataset contains ', format('{{:,}}', n_rows), ' records with 14 features') AS message FROM {facts_sql(T, DIRTY)}
    UNION ALL SELECT 2, CASE WHEN quality_score >= 90 THEN 'Excellent data quality - ready for analysis' WHEN quality_score >= 70 THEN 'Good data quality - minor issues detected'
        ELSE 'Data quality needs improvement - consider cleaning' END FROM score
    UNION ALL SELECT 3, concat(n_issues, ' data quality issues to address') FROM score WHERE quality_score < 100
    UNION ALL SELECT 4, concat(k, ' columns have >20% missing values') FROM (SELECT count(*) AS k FROM gaps WHERE pct > 20) WHERE k > 0
    UNION ALL SELECT 5, concat(k, ' strong correlations found') FROM (SELECT least(5, count(*)) AS k FROM pairs WHERE abs(r) > 0.7) WHERE k > 0
    UNION ALL SELECT 6 + place / 10.0, message FROM (SELECT * FROM {KEY_DIRTY} ORDER BY place LIMIT 3))
    SELECT row_number() OVER (ORDER BY place) AS rank, message FROM said""")
def insights_summary(spark, folder):
    return insights.insights_summary(_stats(spark, folder, T, "A"))


# what the messages talk about, made of the orders per status: names and numbers of every kind
FINDINGS = """SELECT o_orderstatus AS column_name, 'orders ' || o_orderstatus AS type, 'pattern ' || o_orderstatus AS pattern, 'message ' || o_orderstatus AS message,
    o_orderstatus AS c1, min(o_orderpriority) AS c2, 'text' AS from_type, 'number' AS to_type, 'median' AS method, count(*) AS total_rows,
    CAST(6 AS BIGINT) AS total_columns, CAST(count(*) % 101 AS BIGINT) AS quality_score, CAST(count(*) % 7 AS BIGINT) AS n_issues, CAST(count(*) % 9 AS BIGINT) AS rank,
    round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS std, round(avg(o_totalprice) / max(o_totalprice), 6) AS correlation,
    CAST(count(*) % 13 AS BIGINT) AS n_outliers, count(*) AS total_outliers, CAST(count(*) % 17 AS BIGINT) AS n_changed, count(*) AS rows_before
    FROM {orders} GROUP BY o_orderstatus"""

# The format of each message and its columns, written out again for SQL.
FINDING_FORMATS = {
    "dataset_overview": ("Dataset of %d rows and %d columns", "total_rows, total_columns"),
    "data_quality": ("Quality score %d of 100, %d issues", "quality_score, n_issues"),
    "key_insights": ("%d. %s", "rank, message"), "recommendations": ("%d. %s", "rank, message"),
    "column_stats": ("Column ''%s'': mean %.2f, deviation %.2f", "column_name, mean, std"),
    "patterns": ("Column ''%s'': %s", "column_name, pattern"),
    "correlation": ("''%s'' and ''%s'' correlate at %.2f", "c1, c2, correlation"),
    "outliers": ("Column ''%s'' has %d outliers of %d in the table", "column_name, n_outliers, total_outliers"),
    "analysis_summary": ("%s: %d records, %d columns analysed", "type, total_rows, total_columns"),
    "handle_missing": ("Filled %d missing values of ''%s'' by %s", "n_changed, column_name, method"),
    "remove_duplicates": ("Removed %d duplicate rows of %d", "n_changed, rows_before"),
    "fix_datatypes": ("Converted ''%s'' from %s to %s", "column_name, from_type, to_type"),
    "remove_outliers": ("Removed %d rows with outliers in ''%s'' by %s", "n_changed, column_name, method"),
    "standardize_format": ("Cleaned the text of ''%s'': %s", "column_name, method"),
}


@query("finding_text", f"WITH f AS ({FINDINGS.format(orders='orders')}) " + " UNION ALL ".join(
    f"SELECT '{kind}' AS kind, printf('{text}', {columns}) AS message FROM f" for kind, (text, columns) in FINDING_FORMATS.items()))
def finding_text(spark, folder):
    frame, found = spark.sql(FINDINGS, orders=read(spark, folder, "orders")), None
    for kind in insights.MESSAGES:
        part = insights.finding_text(frame, kind).select(F.lit(kind).alias("kind"), "message")
        found = part if found is None else found.unionAll(part)
    return found


def readiness_sql(table, columns, numbers, texts):
    """(place, check_name, status, cost) of the five checks."""
    wide = " + ".join(f"(SELECT CAST(count(DISTINCT {c}) > 50 AS INT) FROM {table})" for c in texts) or "0"
    return f"""(SELECT unnest([
        {{'place': 1, 'check_name': 'Missing Values', 'status': CASE WHEN m = 0 THEN 'pass' WHEN m < 5 THEN 'warning' ELSE 'fail' END, 'cost': least(m, 30)}},
        {{'place': 2, 'check_name': 'Duplicates', 'status': CASE WHEN d > 0 THEN 'warning' ELSE 'pass' END, 'cost': least(2 * d, 20)}},
        {{'place': 3, 'check_name': 'Sample Size', 'status': CASE WHEN n_rows < 1000 THEN 'warning' ELSE 'pass' END, 'cost': CASE WHEN n_rows < 100 THEN 25 WHEN n_rows < 1000 THEN 10 ELSE 0 END::DOUBLE}},
        {{'place': 4, 'check_name': 'Numeric Features', 'status': CASE WHEN {numbers} = 0 THEN 'fail' ELSE 'pass' END, 'cost': CASE WHEN {numbers} = 0 THEN 30 ELSE 0 END::DOUBLE}},
        {{'place': 5, 'check_name': 'Categorical Encoding', 'status': CASE WHEN {len(texts)} > 0 THEN 'warning' ELSE 'pass' END,
          'cost': CASE WHEN {wide} > 0 THEN 15 WHEN {len(texts)} > 0 THEN 5 ELSE 0 END::DOUBLE}}], recursive := true)
        FROM (SELECT n_rows, n_missing * 100.0::DOUBLE / n_cells AS m, n_duplicate * 100.0::DOUBLE / n_rows AS d FROM {facts_sql(table, columns)}))"""


READY = {T: (DIRTY, 10, DIRTY_TEXT), "dup_orders": (ORDERS, 3, ["o_orderstatus", "o_orderpriority"]),
         "benchmark": (["item_id", "text"], 1, ["text"])}
LEVEL = "CASE WHEN s >= 85 THEN 'Ready' WHEN s >= 70 THEN 'Nearly Ready' WHEN s >= 50 THEN 'Needs Work' ELSE 'Not Ready' END"


def _ready(spark, folder, operator):
    found = None
    for t in READY:
        part = operator(_stats(spark, folder, t)).select(F.lit(t).alias("table_name"), "*")
        found = part if found is None else found.unionAll(part)
    return found


@query("ml_readiness", given(T, "dup_orders") + " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, {r('greatest(0, s)', 2)} AS readiness_score, {LEVEL} AS readiness_level FROM (SELECT 100 - sum(cost) AS s FROM {readiness_sql(t, *cs)})"
    for t, cs in READY.items()))
def ml_readiness(spark, folder):
    return _ready(spark, folder, scores.ml_readiness)


@query("readiness_checks", given(T, "dup_orders") + " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, CAST(place AS BIGINT) AS rank, check_name, status, {r('cost')} AS cost FROM {readiness_sql(t, *cs)}" for t, cs in READY.items()))
def readiness_checks(spark, folder):
    return rounded(_ready(spark, folder, scores.readiness_checks).drop("message"))


@query("ml_next_steps", given(T, "dup_orders") + " UNION ALL ".join(f"""
    SELECT '{t}' AS table_name, CAST(place AS BIGINT) AS rank, CASE check_name WHEN 'Missing Values' THEN 'Fill or remove missing values using data cleaning tools'
           WHEN 'Numeric Features' THEN 'Convert categorical columns to numbers (encoding)' WHEN 'Duplicates' THEN 'Remove duplicate rows'
           WHEN 'Sample Size' THEN 'Consider collecting more data if possible' ELSE 'Encode categorical columns (one-hot or label encoding)' END AS step
    FROM {readiness_sql(t, *cs)} WHERE (status = 'fail' AND place IN (1, 4)) OR (status = 'warning' AND place IN (2, 3, 5))""" for t, cs in READY.items()))
def ml_next_steps(spark, folder):
    return _ready(spark, folder, scores.ml_next_steps)


CANDIDATES = [(c, int(c in ("l_returnflag", "l_linestatus"))) for c in LINEITEM]


@query("target_candidates", " UNION ALL ".join(f"""
    SELECT '{c}' AS column_name, CASE WHEN named THEN 'name suggests a target' WHEN u = 2 THEN 'binary column' ELSE 'few categories' END AS reason,
           CASE WHEN named AND {text} = 0 THEN 'regression' ELSE 'classification' END AS type, CASE WHEN named THEN 'high' ELSE 'medium' END AS confidence,
           u AS n_unique, CASE WHEN NOT named THEN vals END AS unique_values
    FROM (SELECT regexp_matches('{c}', 'target|label|class|category|outcome|result|prediction|fraud|churn|price|sales|revenue|risk') AS named,
                 count(DISTINCT {c}) AS u, list_sort(list(DISTINCT CAST({c} AS VARCHAR))) AS vals FROM lineitem)
    WHERE named OR u = 2 OR ({text} = 1 AND u <= 10)""" for c, text in CANDIDATES))
def target_candidates(spark, folder):
    return scores.target_candidates(TableStats(read(spark, folder, "lineitem"))).drop("position")


TARGETS = {"labels": "quality", "lineitem": "l_linestatus", "orders": "o_orderpriority"}


def _problem(table, column, numeric):
    return "Regression" if numeric else "Binary Classification" if column == "l_linestatus" else "Multi-Class Classification"


@query("suggest_models", " UNION ALL ".join(f"""
    SELECT '{c}' AS column_name, '{_problem(t, c, t == "labels")}' AS problem_type, (SELECT count(DISTINCT {c}) FROM {t}) AS n_unique, {str(t == "labels").lower()} AS is_numeric,
           (SELECT string_agg(CAST(v AS VARCHAR), ',' ORDER BY v) FROM (SELECT DISTINCT {c} AS v FROM {t} ORDER BY v LIMIT 5)) AS samples,
           CAST({i + 1} AS BIGINT) AS rank, '{m}' AS model""" for t, c in TARGETS.items()
    for i, m in enumerate(scores.SUGGESTED_MODELS[_problem(t, c, t == "labels")])))
def suggest_models(spark, folder):
    found = None
    for t, c in TARGETS.items():
        part = scores.suggest_models(_stats(spark, folder, t), c)
        found = part if found is None else found.unionAll(part)
    return found


def _stacked(section, inner):
    return f"SELECT '{section}' AS section, '*' AS column_name, message AS metric, CAST(rank AS DOUBLE) AS value FROM ({inner})"


OVERVIEW = """SELECT '*' AS column_name, count(*) AS total_rows, {columns} AS total_columns, {numbers} AS numeric_columns, {texts} AS categorical_columns,
    {times} AS datetime_columns FROM {table}"""
OVERVIEW_MEASURES = ["total_rows", "total_columns", "numeric_columns", "categorical_columns", "datetime_columns"]
QUICK = " UNION ALL ".join([
    long_sql("overview", OVERVIEW.format(columns=14, numbers=10, texts=3, times=1, table=T), OVERVIEW_MEASURES),
    long_sql("data_quality", "SELECT '*' AS column_name, * FROM (" + deducting_sql(T, DIRTY, DIRTY_TEXT) + ")",
             ["quality_score", "n_issues", "duplicate_rows", "total_missing_cells"]),
    long_sql("summary", NUMERIC_A, MEASURES_A), _stacked("key_insight", numbered(KEY_DIRTY)), _stacked("recommendation", numbered(REC_DIRTY))])


@query("quick_analysis", PAIRS + QUICK)
def quick_analysis(spark, folder):
    return rounded(reports.quick_analysis(_stats(spark, folder, T, "A")))


HIGH = f"SELECT 'correlation' AS section, concat(c1, ' ~ ', c2) AS column_name, 'r' AS metric, {r('r')} AS value FROM pairs WHERE abs(r) >= 0.7"
FOUND = "SELECT 'pattern', column_name, concat(type, ': ', pattern), 1.0::DOUBLE FROM ({})"


@query("comprehensive", PAIRS + QUICK + " UNION ALL " + HIGH + " UNION ALL " + " UNION ALL ".join(FOUND.format(p) for p in (
    categorical_sql(T, DIRTY_TEXT), numeric_sql(T, DIRTY_NUMERIC),
    f"SELECT 'missing' AS type, c1 AS column_name, concat('missing values occur together with ''', c2, '''') AS pattern FROM ({gap_pairs(T, DIRTY)}) WHERE r > 0.8")))
def comprehensive(spark, folder):
    return rounded(reports.comprehensive_analysis(_stats(spark, folder, T, "A")))
