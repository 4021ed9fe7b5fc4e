"""Cleaning steps."""

from pyspark.sql import functions as F

from colsift.operators import clean
from querybook.base import given, query, r, read, rounded

EVENT_ORDER = ["ts", "event_id"]
LINE = "l_orderkey, l_partkey, l_suppkey, l_linenumber"


@query("dedup_rows", given("dup_orders", "holey_orders") + """
    SELECT DISTINCT o_orderkey, o_totalprice, o_orderstatus, o_orderpriority FROM dup_orders
    UNION ALL SELECT DISTINCT o_orderkey, CASE WHEN NOT isnan(o_totalprice) THEN o_totalprice END, o_orderstatus, NULL FROM holey_orders""")
def dedup_rows(spark, folder):
    whole = clean.drop_duplicates(read(spark, folder, "dup_orders")).select("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
    holey = clean.drop_duplicates(read(spark, folder, "holey_orders"))
    return whole.unionAll(holey.withColumn("o_orderpriority", F.lit(None).cast("string")))


@query("dedup_subset", given("dup_orders") + """
    SELECT * EXCLUDE (place) FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place
    FROM dup_orders) WHERE place = 1""")
def dedup_subset(spark, folder):
    return clean.drop_duplicates(read(spark, folder, "dup_orders"), ["o_custkey"], ["o_orderkey"])


def _filled(spark, folder, column, method, value=None):
    df = clean.fill_missing(read(spark, folder, "dirty_lineitem"), column, method, value)
    return rounded(df.selectExpr(*LINE.split(", "), column), 6)


@query("fill_mean", given("dirty_lineitem") + f"""
    SELECT {LINE}, {r("coalesce(l_quantity, (SELECT avg(l_quantity) FROM dirty_lineitem))", 6)} AS l_quantity FROM dirty_lineitem""")
def fill_mean(spark, folder):
    return _filled(spark, folder, "l_quantity", "mean")


@query("fill_median", given("dirty_lineitem") + f"""
    SELECT {LINE}, {r("coalesce(l_discount, (SELECT quantile_cont(l_discount, 0.5) FROM dirty_lineitem))", 6)} AS l_discount FROM dirty_lineitem""")
def fill_median(spark, folder):
    return _filled(spark, folder, "l_discount", "median")


@query("fill_mode", given("comissing_orders") + """
    SELECT * REPLACE (coalesce(o_orderpriority, (SELECT o_orderpriority FROM comissing_orders WHERE o_orderpriority IS NOT NULL
        GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS o_orderpriority) FROM comissing_orders""")
def fill_mode(spark, folder):
    return clean.fill_missing(read(spark, folder, "comissing_orders"), "o_orderpriority", "mode")


def _along(direction, frame):
    """Both orders of fill_forward and fill_backward in SQL: one of distinct keys, one with ties."""
    return given("sparse_events", "tied_events") + f"""
    SELECT * REPLACE ({direction}(value IGNORE NULLS) OVER (ORDER BY ts, event_id {frame}) AS value) FROM sparse_events
    UNION ALL SELECT event_id, NULL, {direction}(value IGNORE NULLS) OVER (ORDER BY slot {frame}), NULL, NULL FROM tied_events"""


def _filled_along(spark, folder, method):
    whole = clean.fill_missing(read(spark, folder, "sparse_events"), "value", method, order_by=EVENT_ORDER)
    tied = clean.fill_missing(read(spark, folder, "tied_events"), "value", method, order_by=["slot"])
    nothing = lambda c: F.lit(None).cast(whole.schema[c].dataType)
    return whole.unionAll(tied.select("event_id", nothing("ts"), "value", nothing("event_type"), nothing("flag")))


@query("fill_forward", _along("last_value", "ROWS UNBOUNDED PRECEDING"))
def fill_forward(spark, folder):
    return _filled_along(spark, folder, "forward_fill")


@query("fill_backward", _along("first_value", "ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING"))
def fill_backward(spark, folder):
    return _filled_along(spark, folder, "backward_fill")


@query("fill_custom", given("dirty_lineitem") + f"SELECT {LINE}, coalesce(l_tax, 0.5) AS l_tax FROM dirty_lineitem")
def fill_custom(spark, folder):
    return _filled(spark, folder, "l_tax", "custom", 0.5)


@query("fill_report", given("dirty_lineitem") + """
    SELECT column_name, method, missing_before, missing_before AS n_changed, CAST(0 AS BIGINT) AS missing_after FROM (
        SELECT 'l_quantity' AS column_name, 'mean' AS method, count(*) - count(l_quantity) AS missing_before FROM dirty_lineitem
        UNION ALL SELECT 'l_discount', 'median', count(*) - count(l_discount) FROM dirty_lineitem
        UNION ALL SELECT 'l_tax', 'mode', count(*) - count(l_tax) FROM dirty_lineitem
        UNION ALL SELECT 'const_num', 'mean', count(*) - count(const_num) FROM dirty_lineitem)""")
def fill_report(spark, folder):
    cleaner = clean.Cleaner(read(spark, folder, "dirty_lineitem"))
    for column, method in (("l_quantity", "mean"), ("l_discount", "median"), ("l_tax", "mode"), ("const_num", "mean")):
        cleaner = cleaner.fill_missing(column, method)
    return cleaner.log_frame().select("column_name", "method", "missing_before", "n_changed", "missing_after")


IQR = """bounds AS (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM
    (SELECT quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.75) AS q3 FROM dirty_lineitem))"""
Z = "stat AS (SELECT avg(value) AS m, stddev_pop(value) AS s FROM sparse_events)"


@query("outliers_iqr_drop", given("dirty_lineitem")[:-1] + f""", {IQR}
    SELECT {LINE}, l_extendedprice FROM dirty_lineitem, bounds WHERE l_extendedprice BETWEEN lo AND hi""")
def outliers_iqr_drop(spark, folder):
    df = clean.drop_outliers(read(spark, folder, "dirty_lineitem"), "l_extendedprice", "iqr")
    return df.selectExpr(*LINE.split(", "), "l_extendedprice")


@query("outliers_zscore_drop", given("sparse_events")[:-1] + f""", {Z}
    SELECT sparse_events.* FROM sparse_events, stat WHERE abs((value - m) / s) < 3""")
def outliers_zscore_drop(spark, folder):
    return clean.drop_outliers(read(spark, folder, "sparse_events"), "value", "zscore", 3.0)


@query("outliers_report", given("dirty_lineitem", "sparse_events")[:-1] + f""", {IQR}, {Z},
    kept AS (SELECT 'iqr' AS method, count(*) AS rows_before, count(*) FILTER (l_extendedprice BETWEEN lo AND hi) AS rows_after
             FROM dirty_lineitem, bounds
             UNION ALL SELECT 'zscore', count(*), count(*) FILTER (abs((value - m) / s) < 1.5) FROM sparse_events, stat)
    SELECT *, rows_before - rows_after AS n_changed FROM kept""")
def outliers_report(spark, folder):
    first = clean.Cleaner(read(spark, folder, "dirty_lineitem")).remove_outliers("l_extendedprice", "iqr")
    second = clean.Cleaner(read(spark, folder, "sparse_events")).remove_outliers("value", "zscore", 1.5)
    return first.log_frame().unionAll(second.log_frame()).select("method", "rows_before", "rows_after", "n_changed")


def _text(spark, folder, *operations):
    return clean.standardize_text(read(spark, folder, "messy_customer"), "segment", list(operations))


def _segment(expression):
    return given("messy_customer") + f"SELECT c_custkey, {expression} AS segment, c_acctbal FROM messy_customer"


@query("text_lower", _segment("lower(segment)"))
def text_lower(spark, folder):
    return _text(spark, folder, "lowercase")


@query("text_strip", _segment("trim(segment)"))
def text_strip(spark, folder):
    return _text(spark, folder, "strip")


@query("text_remove_special", "SELECT doc_id, length(t) AS n, md5(t) AS digest FROM (SELECT doc_id, "
                              r"regexp_replace(text, '[^a-zA-Z0-9\t\n\v\f\r \x{85}\p{Z}]', '', 'g') AS t FROM documents)")
def text_remove_special(spark, folder):
    df = clean.standardize_text(read(spark, folder, "documents"), "text", ["remove_special"])
    return df.select("doc_id", F.length("text").cast("bigint").alias("n"), F.md5(F.col("text").cast("binary")).alias("digest"))


@query("text_standardize", _segment("regexp_replace(trim(lower(segment)), '[^a-zA-Z0-9\\s]', '', 'g')"))
def text_standardize(spark, folder):
    return _text(spark, folder, "remove_special", "strip", "lowercase")


@query("cast_int", given("text_part") + "SELECT p_partkey, TRY_CAST(size_text AS BIGINT) AS size_text FROM text_part")
def cast_int(spark, folder):
    return clean.convert_type(read(spark, folder, "text_part"), "size_text", "int").select("p_partkey", "size_text")


@query("cast_float", given("text_part") + "SELECT p_partkey, TRY_CAST(price_text AS DOUBLE) AS price_text FROM text_part")
def cast_float(spark, folder):
    return clean.convert_type(read(spark, folder, "text_part"), "price_text", "float").select("p_partkey", "price_text")


@query("cast_string", "SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey FROM orders")
def cast_string(spark, folder):
    return clean.convert_type(read(spark, folder, "orders"), "o_custkey", "string").select("o_orderkey", "o_custkey")


@query("cast_datetime", given("bad_dates") + """
    SELECT o_orderkey, strftime(TRY_CAST(order_date AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS order_date FROM bad_dates""")
def cast_datetime(spark, folder):
    return clean.convert_type(read(spark, folder, "bad_dates"), "order_date", "datetime").withColumn(
        "order_date", F.date_format("order_date", "yyyy-MM-dd HH:mm:ss"))


@query("cast_category", given("messy_customer") + """
    SELECT c_custkey, segment, dense_rank() OVER (ORDER BY segment) - 1 AS code FROM messy_customer""")
def cast_category(spark, folder):
    df = clean.convert_type(read(spark, folder, "messy_customer"), "segment", "category")
    return clean.encode_category(df, "segment", "code").select("c_custkey", "segment", "code")


@query("cast_report", given("text_part") + """
    SELECT CAST(1 AS BIGINT) AS step, 'size_text' AS column_name, 'string' AS from_type, 'int' AS to_type,
           NOT coalesce(bool_or(TRY_CAST(size_text AS DOUBLE) <> floor(TRY_CAST(size_text AS DOUBLE))), false) AS success FROM text_part
    UNION ALL SELECT 2, 'price_text', 'string', 'int',
           NOT coalesce(bool_or(TRY_CAST(price_text AS DOUBLE) <> floor(TRY_CAST(price_text AS DOUBLE))), false) FROM text_part
    UNION ALL SELECT 3, 'price_text', 'string', 'float', count(*) > 0 FROM text_part""")
def cast_report(spark, folder):
    cleaner = clean.Cleaner(read(spark, folder, "text_part"))
    for column, target in (("size_text", "int"), ("price_text", "int"), ("price_text", "float")):
        cleaner = cleaner.convert_type(column, target)
    return cleaner.log_frame().select("step", "column_name", "from_type", "to_type", "success")


@query("drop_low_variance", given("dirty_lineitem") + "SELECT * EXCLUDE (l_discount, l_tax, const_num) FROM dirty_lineitem")
def drop_low_variance(spark, folder):
    return clean.Cleaner(read(spark, folder, "dirty_lineitem")).remove_low_variance().df


def _cleaner(spark, folder):
    return (clean.Cleaner(read(spark, folder, "dup_orders")).remove_duplicates()
            .standardize_text("o_orderpriority", ["lowercase"]).remove_outliers("o_totalprice", "iqr"))


CHAIN = given("dup_orders")[:-1] + """, step AS (SELECT DISTINCT * REPLACE (lower(o_orderpriority) AS o_orderpriority) FROM dup_orders),
    bounds AS (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM
        (SELECT quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.75) AS q3 FROM step)),
    kept AS (SELECT step.* FROM step, bounds WHERE o_totalprice BETWEEN lo AND hi) """


@query("cleaning_log", CHAIN + """
    SELECT CAST(1 AS BIGINT) AS step, 'remove_duplicates' AS action, (SELECT count(*) FROM dup_orders) AS rows_before, (SELECT count(*) FROM step) AS rows_after
    UNION ALL SELECT 2, 'standardize_text', NULL, NULL
    UNION ALL SELECT 3, 'remove_outliers', (SELECT count(*) FROM step), (SELECT count(*) FROM kept)""")
def cleaning_log(spark, folder):
    return _cleaner(spark, folder).log_frame().select("step", "action", "rows_before", "rows_after")


@query("cleaning_summary", CHAIN + """
    SELECT CAST(3 AS BIGINT) AS total_operations, 'remove_duplicates,standardize_text,remove_outliers' AS operations,
           count(*) AS final_rows, CAST(6 AS BIGINT) AS final_columns FROM kept""")
def cleaning_summary(spark, folder):
    return _cleaner(spark, folder).summary()


@query("cleaned_data", CHAIN + "SELECT * FROM kept")
def cleaned_data(spark, folder):
    return _cleaner(spark, folder).df
