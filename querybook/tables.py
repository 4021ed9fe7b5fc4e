"""Work on two tables or two versions of one."""

from pyspark.sql import functions as F

from colsift.operators import tables
from colsift.plans.session import scratch_path
from querybook.base import given, query, r, read, rounded

G = "sparse_events"


@query("auto_clean", given(G, "comissing_orders") + f"""
    SELECT event_id, ts, {r(f"coalesce(value, (SELECT quantile_cont(value, 0.5) FROM {G}))", 6)} AS value, event_type, flag FROM {G}
    UNION ALL SELECT o_orderkey, NULL, {r("coalesce(o_totalprice, (SELECT quantile_cont(o_totalprice, 0.5) FROM comissing_orders))", 6)},
        coalesce(o_orderpriority, (SELECT o_orderpriority FROM comissing_orders WHERE o_orderpriority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)),
        o_orderstatus FROM comissing_orders""")
def auto_clean(spark, folder):
    first = tables.auto_clean(read(spark, folder, G))
    doubled = read(spark, folder, "comissing_orders")
    second = tables.auto_clean(doubled.unionAll(doubled)).select(
        "o_orderkey", F.lit(None).cast("timestamp_ntz"), "o_totalprice", "o_orderpriority", "o_orderstatus")
    return rounded(first.unionAll(second), 6)


@query("merge_tables", """
    SELECT 'inner' AS how, count(*) AS n, CAST(sum(c_nationkey) AS BIGINT) AS total FROM orders JOIN customer ON o_custkey = c_custkey
    UNION ALL SELECT 'left', count(*), CAST(sum(c_nationkey) AS BIGINT) FROM customer LEFT JOIN orders ON o_custkey = c_custkey
    UNION ALL SELECT 'right', count(*), CAST(sum(c_nationkey) AS BIGINT) FROM customer RIGHT JOIN orders ON o_custkey = c_custkey
    UNION ALL SELECT 'full', count(*), CAST(sum(c_nationkey) AS BIGINT) FROM customer FULL JOIN orders ON o_custkey = c_custkey
    UNION ALL SELECT 'left_semi', count(*), CAST(sum(c_nationkey) AS BIGINT) FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)
    UNION ALL SELECT 'left_anti', count(*), CAST(sum(c_nationkey) AS BIGINT) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def merge_tables(spark, folder):
    customer = read(spark, folder, "customer").select(F.col("c_custkey").alias("key"), "c_nationkey")
    orders = read(spark, folder, "orders").select(F.col("o_custkey").alias("key"), "o_totalprice")
    found = None
    for how in tables.JOINS:
        part = tables.merge_tables(customer, orders, ["key"], how).agg(
            F.lit(how).alias("how"), F.count("*").alias("n"), F.sum("c_nationkey").alias("total"))
        found = part if found is None else found.unionAll(part)
    return found


def _side(table, columns, tag):
    return " UNION ALL ".join(f"SELECT '{c}' AS column_name, count({c}) AS non_null_count_{tag}, count(*) - count({c}) AS null_count_{tag}, "
                              f"count(DISTINCT {c}) AS unique_values_{tag} FROM {table}" for c in columns)


@query("compare_tables", given("comissing_orders") + f"""
    SELECT * FROM ({_side("orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"], "left")})
    FULL JOIN ({_side("comissing_orders", ["o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus"], "right")}) USING (column_name)""")
def compare_tables(spark, folder):
    return tables.compare_tables(read(spark, folder, "orders"), read(spark, folder, "comissing_orders")).drop(
        "data_type_left", "data_type_right")


HOLEY = "SELECT o_orderkey, CASE WHEN NOT isnan(o_totalprice) THEN o_totalprice END AS o_totalprice, o_orderstatus FROM holey_orders"


@query("diff_versions", given("holey_orders") + f""", before AS ({HOLEY}),
    after AS (SELECT o_orderkey, o_totalprice + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS o_totalprice, o_orderstatus FROM before
              WHERE o_orderkey IS NULL OR o_orderkey % 10 <> 0 UNION ALL SELECT 5000, 1, 'F' UNION ALL SELECT 5000, 1, 'F'),
    net AS (SELECT o_orderkey, o_totalprice, o_orderstatus, sum(n) AS net, bool_or(n < 0) AS was, bool_or(n > 0) AS is_ FROM (
        SELECT *, -1 AS n FROM before UNION ALL SELECT *, 1 FROM after) GROUP BY ALL)
    SELECT 'unique' AS keys, o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'removed' ELSE 'changed' END AS change FROM orders WHERE o_orderkey % 10 = 0 OR o_orderkey % 7 = 0
    UNION ALL SELECT 'unique', -o_orderkey - 1, 'added' FROM orders WHERE o_orderkey % 100 = 3
    UNION ALL SELECT 'repeated', o_orderkey, CASE WHEN NOT bool_or(was) THEN 'added' WHEN NOT bool_or(is_) THEN 'removed' ELSE 'changed' END
        FROM net GROUP BY o_orderkey HAVING bool_or(net <> 0)""")
def diff_versions(spark, folder):
    old = read(spark, folder, "orders")
    kept = old.filter("o_orderkey % 10 <> 0").withColumn(
        "o_totalprice", F.expr("CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 1 ELSE o_totalprice END"))
    added = old.filter("o_orderkey % 100 = 3").withColumn("o_orderkey", -F.col("o_orderkey") - 1)
    unique = tables.diff_versions(old, kept.unionAll(added), ["o_orderkey"])
    holey = read(spark, folder, "holey_orders")
    now = holey.filter("o_orderkey IS NULL OR o_orderkey % 10 <> 0").withColumn(
        "o_totalprice", F.expr("o_totalprice + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END"))
    two = spark.range(2).select(F.lit(5000).cast("bigint").alias("o_orderkey"), F.lit(1.0).alias("o_totalprice"), F.lit("F").alias("o_orderstatus"))
    repeated = tables.diff_versions(holey, now.unionAll(two), ["o_orderkey"])
    return unique.select(F.lit("unique").alias("keys"), "*").unionAll(repeated.select(F.lit("repeated").alias("keys"), "*"))


@query("snapshot", given("dup_orders") + """
    SELECT CAST(1 AS BIGINT) AS version, 'raw' AS label, count(*) AS n FROM dup_orders
    UNION ALL SELECT 2, 'clean', count(*) FROM (SELECT DISTINCT * FROM dup_orders)""")
def snapshot(spark, folder):
    versions = tables.Snapshots(spark, scratch_path(spark, "snapshots"))
    raw = read(spark, folder, "dup_orders")
    versions.save(raw, 1, "raw")
    versions.save(raw.dropDuplicates(), 2, "clean")
    found = versions.read(1).agg(F.lit(1).alias("version"), F.count("*").alias("n")).unionAll(
        versions.read(2).agg(F.lit(2), F.count("*")))
    return versions.manifest().select("version", "label").join(found, "version")
