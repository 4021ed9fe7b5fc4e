"""Correlation of columns."""

from itertools import combinations


from colsift.operators import correlate
from colsift.plans.stats import TableStats
from querybook.base import DIRTY_NUMERIC, given, query, r, read, rounded

T = "dirty_lineitem"


def _stats(spark, folder):
    return TableStats(read(spark, folder, T))


def _r(a, b, table=T):
    both = f"{a} IS NOT NULL AND {b} IS NOT NULL"
    return (f"CASE WHEN min({a}) FILTER ({both}) < max({a}) FILTER ({both}) AND min({b}) FILTER ({both}) < max({b}) FILTER ({both}) "
            f"THEN corr({a}, {b}) END")


PAIRS = given(T)[:-1] + ", pairs AS (" + " UNION ALL ".join(
    f"SELECT {i} AS pair, '{a}' AS c1, '{b}' AS c2, {_r(a, b)} AS r FROM {T}" for i, (a, b) in enumerate(combinations(DIRTY_NUMERIC, 2))) + ") "
OWN = " UNION ALL ".join(f"SELECT '{c}', '{c}', CASE WHEN min({c}) < max({c}) THEN 1.0::DOUBLE END FROM {T}" for c in DIRTY_NUMERIC)
SIGN = "CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END"


def _matrix(digits):
    return PAIRS + f"""SELECT c1, c2, {r("r", digits)} AS r FROM (SELECT c1, c2, r FROM pairs UNION ALL SELECT c2, c1, r FROM pairs UNION ALL {OWN})"""


@query("corr_pearson", _matrix(6))
def corr_pearson(spark, folder):
    return rounded(correlate.correlation_matrix(_stats(spark, folder)), 6)


def _average_rank(column):
    return f"rank() OVER (ORDER BY {column}) + (count(*) OVER (PARTITION BY {column}) - 1) / 2.0"


@query("corr_spearman", given(T) + " UNION ALL ".join(f"""
    SELECT '{a}' AS c1, '{b}' AS c2, {r("CASE WHEN stddev_pop(ra) > 0 AND stddev_pop(rb) > 0 THEN corr(ra, rb) END", 6)} AS r FROM (SELECT {_average_rank(a)} AS ra, {_average_rank(b)} AS rb
    FROM {T} WHERE {a} IS NOT NULL AND {b} IS NOT NULL)""" for a, b in combinations(DIRTY_NUMERIC, 2)))
def corr_spearman(spark, folder):
    return rounded(correlate.correlation_pairs(TableStats(read(spark, folder, T)), "spearman").drop("pair"), 6)


def _tau(a, b):
    # two values of y first differ at one bit of their dense code; swapped are those where a one comes before a zero in x
    cells = f"cells_{a}_{b}"
    running = "sum(CASE WHEN one THEN k ELSE 0 END) OVER (PARTITION BY bit, prefix ORDER BY x RANGE UNBOUNDED PRECEDING)"
    peers = "sum(CASE WHEN one THEN k ELSE 0 END) OVER (PARTITION BY bit, prefix, x)"
    tied = lambda group: f"(SELECT sum(t * (t - 1) / 2) FROM (SELECT sum(k) AS t FROM {cells} GROUP BY {group}))"
    return f"""
    SELECT '{a}' AS c1, '{b}' AS c2, CASE WHEN n1 < n0 AND n2 < n0 THEN {r("(n0 - n1 - n2 + n3 - 2 * dis) / (sqrt(n0 - n1) * sqrt(n0 - n2))", 6)} END AS r FROM (
        SELECT coalesce(sum(CASE WHEN one THEN 0 ELSE k * before END), 0) AS dis FROM (SELECT k, one, {running} - {peers} AS before FROM (
            SELECT x, k, bit, code >> (bit + 1) AS prefix, (code >> bit) & 1 = 1 AS one FROM (SELECT x, k, dense_rank() OVER (ORDER BY y) - 1 AS code FROM {cells}), range(20) bits(bit)
            WHERE bit < (SELECT bit_length(bin(count(DISTINCT y))) / 8 FROM {cells})))),
        (SELECT (SELECT sum(k) * (sum(k) - 1) / 2 FROM {cells}) AS n0, {tied("x")} AS n1, {tied("y")} AS n2, {tied("x, y")} AS n3)"""


@query("corr_kendall", given(T)[:-1] + "".join(
    f""", cells_{a}_{b} AS (SELECT {a} AS x, {b} AS y, CAST(count(*) AS DOUBLE) AS k FROM {T} WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY ALL)"""
    for a, b in combinations(DIRTY_NUMERIC, 2)) + " " + " UNION ALL ".join(_tau(a, b) for a, b in combinations(DIRTY_NUMERIC, 2)))
def corr_kendall(spark, folder):
    return rounded(correlate.correlation_pairs(_stats(spark, folder), "kendall").drop("pair"), 6)


@query("high_corr_a", PAIRS + f"""SELECT c1, c2, {r("r", 6)} AS correlation, {SIGN} AS type FROM pairs WHERE abs(r) >= 0.005""")
def high_corr_a(spark, folder):
    return rounded(correlate.high_correlations(_stats(spark, folder), 0.005), 6)


@query("strongest_pair", PAIRS + f"""
    SELECT c1, c2, {r("abs(r)", 6)} AS correlation, {SIGN} AS type FROM pairs WHERE r IS NOT NULL ORDER BY abs(r) DESC, c1, c2 LIMIT 1""")
def strongest_pair(spark, folder):
    return rounded(correlate.strongest_pair(_stats(spark, folder)), 6)


PRICES = """WITH prices AS (SELECT l_quantity, l_extendedprice, l_extendedprice * (1 - l_discount) AS l_net,
    l_extendedprice * (1 - l_discount) * (1 + l_tax) AS l_charge FROM lineitem)"""
PRICE_COLUMNS = ["l_quantity", "l_extendedprice", "l_net", "l_charge"]
PRICE_PAIRS = PRICES + ", pairs AS (" + " UNION ALL ".join(
    f"SELECT '{a}' AS c1, '{b}' AS c2, corr({a}, {b}) AS r FROM prices" for a, b in combinations(PRICE_COLUMNS, 2)) + ") "


def _prices(spark, folder):
    return TableStats(read(spark, folder, "lineitem").selectExpr(
        "l_quantity", "l_extendedprice", "l_extendedprice * (1 - l_discount) AS l_net",
        "l_extendedprice * (1 - l_discount) * (1 + l_tax) AS l_charge"))


@query("strong_pairs_e", PRICE_PAIRS + f"""
    SELECT c1, c2, {r("r", 3)} AS correlation, CASE WHEN r > 0.7 THEN 'strong positive' ELSE 'strong negative' END AS strength
    FROM pairs WHERE abs(r) > 0.7""")
def strong_pairs_e(spark, folder):
    return correlate.strong_pairs(_prices(spark, folder))


@query("corr_analysis", PRICE_PAIRS + f"""
    SELECT CAST(4 AS BIGINT) AS matrix_size, 'pearson' AS method_used, count(*) FILTER (abs(r) >= 0.7) AS n_high,
           max_by(c1, abs(r)) AS c1, max_by(c2, abs(r)) AS c2, {r("max(abs(r))", 6)} AS correlation FROM pairs""")
def corr_analysis(spark, folder):
    return rounded(correlate.correlation_analysis(_prices(spark, folder)), 6)


@query("corr_insights", PRICE_PAIRS + f"""
    SELECT concat(c1, ' and ', c2) AS features, {r("r", 6)} AS correlation, {SIGN} AS type,
           concat('Strong ', {SIGN}, ' relationship: as one increases, the other tends to ', CASE WHEN r > 0 THEN 'increase' ELSE 'decrease' END) AS interpretation
    FROM pairs WHERE abs(r) >= 0.7 ORDER BY abs(r) DESC LIMIT 5""")
def corr_insights(spark, folder):
    return rounded(correlate.correlation_insights(_prices(spark, folder)), 6)


COMISSING = ["o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus"]


def gap_pairs(table, columns):
    """(c1, c2, r) of the null indicators in SQL."""
    gap = lambda c: f"CAST({c} IS NULL AS INT)"
    return " UNION ALL ".join(
        f"SELECT '{a}' AS c1, '{b}' AS c2, CASE WHEN min({gap(a)}) < max({gap(a)}) AND min({gap(b)}) < max({gap(b)}) "
        f"THEN corr({gap(a)}, {gap(b)}) END AS r FROM {table}" for a, b in combinations(columns, 2))


@query("missing_cooccur", given("comissing_orders") + f"""
    SELECT c1, c2, {r("r", 6)} AS correlation FROM ({gap_pairs("comissing_orders", COMISSING)}) WHERE r > 0.8""")
def missing_cooccur(spark, folder):
    return rounded(correlate.missing_cooccurrence(TableStats(read(spark, folder, "comissing_orders"))), 6)


@query("corr_rounded", _matrix(2))
def corr_rounded(spark, folder):
    return rounded(correlate.correlation_rounded(_stats(spark, folder)), 2)
