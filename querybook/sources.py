"""Sources, sinks, ingest and column typing. Files are written from the test tables and read back."""

from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from colsift.functions.values import lenient_number, to_number
from colsift.plans.roles import roles_frame
from colsift.plans.session import scratch_path, small_frame, together
from colsift.plans.stats import TableStats
from colsift.sources import readers, sinks
from querybook.base import LINEITEM, ORDERS, each, given, query, r, read


def _written(spark: SparkSession, df: DataFrame, format: str) -> str:
    return sinks.export(df, scratch_path(spark, "export"), format)


ORDERS_AS_TEXT_DATE = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderpriority FROM orders"


def _dated(df):
    return df.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))


# texts with line breaks and quotes beside plain columns; empty texts read back as missing
DOCUMENTS_AS_TEXT = " UNION ALL SELECT doc_id, n_chars, md5(nullif(text, '')), NULL, lang, source FROM documents"


def _documents(df):
    return df.select("doc_id", "n_chars", F.md5("text"), F.lit(None).cast("double"), "lang", "source")


@query("src_csv", ORDERS_AS_TEXT_DATE + DOCUMENTS_AS_TEXT)
def src_csv(spark, folder):
    back = [readers.read_csv(spark, _written(spark, t, "csv"))
            for t in (_dated(read(spark, folder, "orders")), read(spark, folder, "documents"))]
    orders = back[0].withColumn("o_orderstatus", F.col("o_orderstatus").cast("string"))
    return orders.unionAll(_documents(back[1]))


@query("src_tsv", """
    SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer
    UNION ALL SELECT doc_id, md5(nullif(text, '')), n_chars, NULL, lang FROM documents""")
def src_tsv(spark, folder):
    customer, documents = [readers.read_tsv(spark, _written(spark, read(spark, folder, t), "tsv")) for t in ("customer", "documents")]
    return customer.unionAll(documents.select("doc_id", F.md5("text"), "n_chars", F.lit(None).cast("double"), "lang"))


@query("src_json", """
    SELECT 'lines' AS layout, p_partkey, p_name, p_brand, p_retailprice FROM part
    UNION ALL SELECT layout, p_partkey, p_name, p_brand, p_retailprice FROM part, (SELECT unnest(['nested', 'array', 'columns']) AS layout)""")
def src_json(spark, folder):
    part = read(spark, folder, "part").select("p_partkey", "p_name", "p_brand", "p_retailprice")
    lines = readers.read_json(spark, _written(spark, part, "json"))
    nested = readers.read_json(spark, _written(spark, part.select(
        F.struct("p_partkey", "p_name").alias("id"), F.struct("p_brand", "p_retailprice").alias("rest")), "json"))
    # an array, and an object of columns, made by Spark and written as one text each
    record = F.to_json(F.struct("p_partkey", "p_name", "p_brand", "p_retailprice"))
    array = part.agg(F.concat(F.lit("["), F.array_join(F.collect_list(record), ",\n"), F.lit("]")).alias("value"))
    cells = [F.map_from_entries(F.collect_list(F.struct(F.col("p_partkey").cast("string"), F.col(c).cast("string")))).alias(c)
             for c in part.columns]
    columns = part.agg(F.to_json(F.struct(*cells)).alias("value"))
    texts = []
    for df in (array, columns):
        path = scratch_path(spark, "json") + ".json"
        df.coalesce(1).write.text(path)
        texts.append(readers.load(spark, path))
    named = lambda df, layout: df.select(F.lit(layout).alias("layout"), "p_partkey", "p_name", "p_brand", "p_retailprice")
    return (named(lines, "lines").unionAll(named(nested.select("id.*", "rest.*"), "nested")).unionAll(named(texts[0], "array"))
            .unionAll(named(texts[1], "columns")))


@query("src_parquet", "SELECT * FROM part")
def src_parquet(spark, folder):
    return readers.load(spark, f"{folder}/part.parquet")


@query("src_dispatch", " UNION ALL ".join(
    f"SELECT '{f}' AS format, s_suppkey, s_name, {r('s_acctbal')} AS s_acctbal FROM supplier"
    for f in sinks.FORMATS))
def src_dispatch(spark, folder):
    supplier = read(spark, folder, "supplier")
    frames = [readers.load(spark, _written(spark, supplier, f)).select(
        F.lit(f).alias("format"), "s_suppkey", "s_name", F.round("s_acctbal", 4).alias("s_acctbal")) for f in sinks.FORMATS]
    return frames[0].unionAll(frames[1]).unionAll(frames[2]).unionAll(frames[3])


@query("infer_types", given("text_part") + """
    SELECT p_partkey, size_text, CAST(size_clean AS BIGINT) AS size_clean,
           CAST(NULLIF(price_text, 'n/a') AS DOUBLE) AS price_text FROM text_part""")
def infer_types(spark, folder):
    texts = read(spark, folder, "text_part").withColumn("p_partkey", F.col("p_partkey").cast("string"))
    return readers.infer_types(texts)


@query("empty_guard", """
    SELECT 'orders' AS name, count(*) > 0 AS has_rows FROM orders
    UNION ALL SELECT 'no orders', count(*) > 0 FROM orders WHERE o_totalprice < 0""")
def empty_guard(spark, folder):
    orders = read(spark, folder, "orders")
    rows = []
    for name, df in (("orders", orders), ("no orders", orders.filter("o_totalprice < 0"))):
        try:
            readers.require_rows(df)
            rows.append({"name": name, "has_rows": True})
        except ValueError:
            rows.append({"name": name, "has_rows": False})
    return small_frame(spark, rows, "name string, has_rows boolean")


@query("descriptor", f"""
    SELECT 'orders.parquet' AS filename, count(*) AS "rows", CAST({len(ORDERS)} AS BIGINT) AS "columns",
           '{",".join(ORDERS)}' AS column_names FROM orders""")
def descriptor(spark, folder):
    return readers.descriptor(spark, f"{folder}/orders.parquet").drop("size_mb", "uploaded_at")


@query("preview", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 5")
def preview(spark, folder):
    return readers.preview(read(spark, folder, "orders"), ["o_orderkey"], 5)


@query("sink", " UNION ALL ".join(
    f"SELECT '{f}' AS format, count(*) AS n, count(DISTINCT o_custkey) AS customers, {r('sum(o_totalprice)', 2)} AS total FROM orders"
    f" UNION ALL SELECT '{f}', count(*), count(DISTINCT nullif(text, '')), CAST(sum(n_chars) AS DOUBLE) FROM documents"
    for f in sinks.FORMATS))
def sink(spark, folder):
    orders, documents = _dated(read(spark, folder, "orders")), read(spark, folder, "documents")
    digest = F.unhex(F.md5(F.expr("nullif(text, '')")))  # texts are told apart by 128 bits, so that these are shuffled

    def back(format, table, key, amount):
        return readers.load(spark, _written(spark, table, format)).agg(
            F.lit(format).alias("format"), F.count("*").alias("n"), F.count_distinct(key).alias("customers"),
            F.round(F.sum(amount).cast("double"), 2).alias("total"))

    found = together(spark, [partial(back, f, *table) for f in sinks.FORMATS for table in (
        (orders, F.col("o_custkey"), "o_totalprice"), (documents, digest, "n_chars"))])
    return reduce(DataFrame.unionAll, found)


@query("column_roles", each(LINEITEM, """
    SELECT CAST({i} AS BIGINT) AS position, '{c}' AS column_name,
           CASE WHEN typeof(any_value({c})) IN ('BIGINT', 'INTEGER', 'DOUBLE') THEN 'numeric'
                WHEN typeof(any_value({c})) = 'VARCHAR' THEN 'categorical' ELSE 'datetime' END AS role,
           count(*) - count({c}) AS n_null FROM lineitem"""))
def column_roles(spark, folder):
    lineitem = read(spark, folder, "lineitem")
    gaps = TableStats(lineitem).need("nulls").frame(["n_null"]).select("column_name", "n_null")
    return roles_frame(lineitem, "E").drop("dtype").join(gaps, "column_name")


@query("to_numeric", given("text_part") + """
    SELECT p_partkey, TRY_CAST(price_text AS DOUBLE) AS number FROM text_part WHERE TRY_CAST(price_text AS DOUBLE) IS NOT NULL""")
def to_numeric(spark, folder):
    return read(spark, folder, "text_part").select("p_partkey", to_number(F.col("price_text")).alias("number")).dropna()


@query("lenient_number", r"""
    SELECT c_custkey, coalesce(TRY_CAST(c_name AS DOUBLE), TRY_CAST(regexp_replace(c_name, '[^0-9.\-]', '', 'g') AS DOUBLE), 0.0) AS number
    FROM customer""")
def lenient(spark, folder):
    return read(spark, folder, "customer").select("c_custkey", lenient_number(F.col("c_name")).alias("number"))
