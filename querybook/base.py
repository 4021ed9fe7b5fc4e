"""Registry, derived test inputs and helpers that write the same thing in Spark and in SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
          "pages", "benchmark", "labels", "conversations"]

# Inputs with gaps, copies and faults, derived from the clean tables by text that both engines run.
DERIVED = {
    "dirty_lineitem": """
        SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
               CASE WHEN (l_orderkey + l_linenumber) % 7 = 0 THEN NULL ELSE l_quantity END AS l_quantity,
               CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE l_discount END AS l_discount,
               CASE WHEN l_suppkey % 5 <> 0 THEN NULL ELSE l_tax END AS l_tax,
               CASE WHEN l_orderkey % 97 = 0 THEN l_extendedprice * 50 ELSE l_extendedprice END AS l_extendedprice,
               l_extendedprice * (1 - l_discount) AS l_net, l_returnflag, l_linestatus, l_shipdate,
               CAST(1 AS BIGINT) AS const_num, 'US' AS const_txt
        FROM {lineitem}""",
    "dup_orders": "SELECT * FROM {orders} UNION ALL SELECT * FROM {orders} WHERE o_orderkey % 50 = 0",
    # NaN and NULL in the same place of rows that are otherwise copies, missing and repeated keys
    "holey_orders": """
        SELECT CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderkey % 4000 END AS o_orderkey,
               CASE WHEN o_orderkey % 4 = 0 THEN CAST('NaN' AS DOUBLE) WHEN o_orderkey % 4 = 1 THEN NULL ELSE o_totalprice END AS o_totalprice,
               o_orderstatus FROM {orders}
        UNION ALL SELECT CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderkey % 4000 END,
               CASE WHEN o_orderkey % 4 = 1 THEN CAST('NaN' AS DOUBLE) WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_totalprice END,
               o_orderstatus FROM {orders} WHERE o_orderkey % 5 = 0""",
    # an order in which a third of all rows shares one key; values are a function of the key
    "tied_events": """
        SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 500 ELSE event_id % 1000 END AS slot,
               CASE WHEN (CASE WHEN event_id % 3 = 0 THEN 500 ELSE event_id % 1000 END) % 7 = 0
                    THEN CAST(CASE WHEN event_id % 3 = 0 THEN 500 ELSE event_id % 1000 END AS DOUBLE) END AS value FROM {events}""",
    "messy_customer": """
        SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN concat('  ', c_mktsegment, ' ')
                               WHEN c_custkey % 4 = 1 THEN lower(c_mktsegment)
                               WHEN c_custkey % 4 = 2 THEN concat(c_mktsegment, '!') ELSE c_mktsegment END AS segment,
               c_acctbal FROM {customer}""",
    "text_part": """
        SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN 'unknown' WHEN p_partkey % 10 = 1 THEN NULL
                               ELSE CAST(p_size AS STRING) END AS size_text, CAST(p_size AS STRING) AS size_clean,
               CASE WHEN p_partkey % 2 = 0 THEN CAST(p_retailprice AS STRING) ELSE 'n/a' END AS price_text FROM {part}""",
    "bad_dates": """
        SELECT o_orderkey, CASE WHEN o_orderkey % 20 = 0 THEN '2024-02-30' WHEN o_orderkey % 20 = 1 THEN NULL
                                ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS order_date FROM {orders}""",
    "gappy_events": """
        SELECT event_id, ts, CASE WHEN event_id % 11 = 0 THEN NULL ELSE value END AS value, event_type,
               CASE WHEN user_id % 10 = 0 THEN 'yes' ELSE 'no' END AS flag FROM {events} WHERE day(ts) % 5 <> 0""",
    "sparse_events": """
        SELECT event_id, ts, CASE WHEN event_id % 11 = 0 THEN NULL ELSE value END AS value, event_type,
               CASE WHEN user_id % 10 = 0 THEN 'yes' ELSE 'no' END AS flag FROM {events}""",
    "comissing_orders": """
        SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice,
               CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority, o_orderstatus
        FROM {orders}""",
    "ml_docs": """
        SELECT d.doc_id, d.lang, d.source, CAST(d.n_chars AS DOUBLE) AS n_chars, l.toxic, l.quality
        FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id""",
    "ml_parts": """
        SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_brand END AS p_brand, p_type,
               CASE WHEN p_partkey % 8 = 0 THEN NULL ELSE p_size END AS p_size, p_retailprice,
               CASE WHEN p_retailprice - 900 >= 2 * p_size THEN 'high' ELSE 'low' END AS price_class FROM {part}""",
}


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A test table, or one derived from them."""
    if name not in DERIVED:
        return spark.read.parquet(f"{folder}/{name}.parquet")
    used = set(re.findall(r"\{(\w+)\}", DERIVED[name]))
    return spark.sql(DERIVED[name], **{t: read(spark, folder, t) for t in used})


def given(*names: str) -> str:
    """WITH clause that defines the derived inputs in SQL."""
    return "WITH " + ", ".join(f"{n} AS ({DERIVED[n].format(**{t: t for t in TABLES})})" for n in names) + " "


def query(name: str, sql: str | None = None):
    """Register a query under its name, with its SQL where there is an equivalent."""
    def register(run):
        if name in QUERIES:
            raise ValueError(f"query {name} is already there")
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return run
    return register


def rounded(df: DataFrame, digits: int = 4, **special: int) -> DataFrame:
    """Doubles rounded, minus zero made zero, so that both engines show the same digits."""
    return df.select(*[
        (F.round(F.col(f"`{f.name}`"), special.get(f.name, digits)) + F.lit(0.0)).alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f"`{f.name}`") for f in df.schema])


def r(expression: str, digits: int = 4) -> str:
    """Half-up rounding of the decimal digits, as Spark rounds."""
    return f"CAST(round(CAST({expression} AS DECIMAL(38, 12)), {digits}) AS DOUBLE) + 0.0"


def each(columns: list[str], template: str) -> str:
    """One SELECT per column, stacked: {c} is the column and {i} its place in the list."""
    return " UNION ALL ".join(template.format(c=c, i=i) for i, c in enumerate(columns))


DIRTY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_extendedprice",
         "l_net", "l_returnflag", "l_linestatus", "l_shipdate", "const_num", "const_txt"]
DIRTY_NUMERIC = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax",
                 "l_extendedprice", "l_net", "const_num"]
DIRTY_TEXT = ["l_returnflag", "l_linestatus", "const_txt"]
ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
LINEITEM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
            "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
LINEITEM_NUMERIC = LINEITEM[:8]
