"""Normality, histograms and outliers."""

from statistics import NormalDist

from colsift.functions import tests
from colsift.operators import distribution, outliers
from colsift.plans.stats import TableStats
from querybook.base import DIRTY_NUMERIC, LINEITEM_NUMERIC, each, given, query, r, read, rounded
from querybook.profiles import KURTOSIS, OUT, SMALL_G1

T = "dirty_lineitem"


def _stats(spark, folder, name=T, flavor="A"):
    return TableStats(read(spark, folder, name), flavor)


def k2_sql(moments):
    """K2 and its p-value from a SELECT of (column_name, n, g1, b2), b2 being the kurtosis itself."""
    return f"""
    SELECT column_name, n, z1 * z1 + z2 * z2 AS statistic, exp(-(z1 * z1 + z2 * z2) / 2) AS p_value FROM (
        SELECT column_name, n, ln(y / a + sqrt((y / a) * (y / a) + 1)) / sqrt(ln(w2) / 2) AS z1,
               ((1 - 2 / (9 * k)) - cbrt((1 - 2 / k) / (1 + x * sqrt(2 / (k - 4))))) / sqrt(2 / (9 * k)) AS z2 FROM (
            SELECT *, sqrt(2 / (w2 - 1)) AS a, 6 + (8 / s) * (2 / s + sqrt(1 + 4 / (s * s))) AS k FROM (
                SELECT *, g1 * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) AS y,
                       sqrt(2 * (3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) - 1)) - 1 AS w2,
                       (b2 - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))) AS x,
                       6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS s
                FROM ({moments}))))"""


def _moments(table, columns):
    """Third and fourth moments straight from the data."""
    return " UNION ALL ".join(f"""
        SELECT '{c}' AS column_name, CAST(count({c}) AS DOUBLE) AS n, avg((({c} - m) / s) ** 3) AS g1, avg((({c} - m) / s) ** 4) AS b2
        FROM {table}, (SELECT avg({c}) AS m, stddev_pop({c}) AS s FROM {table})""" for c in columns)


def _k2_rows(inner):
    return f"""SELECT column_name, CAST(n AS BIGINT) AS n, {r("statistic", 3)} AS statistic, {r("p_value", 6)} AS p_value,
        p_value > 0.05 AS is_normal FROM ({inner})"""


@query("normality_k2", _k2_rows(k2_sql(_moments("lineitem", LINEITEM_NUMERIC))))
def normality_k2(spark, folder):
    return rounded(distribution.normality_k2(_stats(spark, folder, "lineitem", "E")), 3, p_value=6)


SMALL = {"customer": ["c_custkey", "c_nationkey", "c_acctbal"], "supplier": ["s_suppkey", "s_nationkey", "s_acctbal"]}


@query("normality_k2_a", _k2_rows(" UNION ALL ".join(k2_sql(_moments(t, cs)) for t, cs in SMALL.items())) + " WHERE n BETWEEN 3 AND 5000")
def normality_k2_a(spark, folder):
    found = [distribution.normality_k2_gated(_stats(spark, folder, t)) for t in SMALL]
    return rounded(found[0].unionAll(found[1]), 3, p_value=6)


def _shapiro_sql(table, columns):
    """(column_name, n, w, p_above) of Shapiro-Wilk from first principles: weights by Royston's rule from normal scores, which SQL
    takes from a list, as it has no normal quantiles; the verdict compares the normalised ln(1 - w) with the 95 % point."""
    sizes = {"supplier": (10, 100, 1000), "customer": (150, 1500)}[table]
    scores = ", ".join(f"({n}, {i}, {NormalDist().inv_cdf((i - 0.375) / (n + 0.25))!r}::DOUBLE)" for n in sizes for i in range(1, n + 1))
    poly = lambda cs, x: " + ".join(f"({c!r})::DOUBLE * power({x}, {i})" for i, c in enumerate(cs))
    return f"""(WITH m AS (SELECT * FROM (VALUES {scores}) t(n, i, m) WHERE n = (SELECT count(*) FROM {table})),
    total AS (SELECT n, sum(m * m) AS mm, max(m) AS last, max(m) FILTER (i = n - 1) AS second, 1 / sqrt(n) AS u FROM m GROUP BY n),
    outer_ AS (SELECT *, {poly(tests.OUTER_WEIGHT, "u")} + last / sqrt(mm) AS a1, {poly(tests.SECOND_WEIGHT, "u")} + second / sqrt(mm) AS a2 FROM total),
    weight AS (SELECT m.n, m.i, CASE WHEN i = 1 THEN -a1 WHEN i = m.n THEN a1 WHEN i = 2 THEN -a2 WHEN i = m.n - 1 THEN a2
               ELSE m / sqrt((mm - 2 * last * last - 2 * second * second) / (1 - 2 * a1 * a1 - 2 * a2 * a2)) END AS a FROM m JOIN outer_ USING (n)),
    x AS ({" UNION ALL ".join(f"SELECT '{c}' AS column_name, CAST({c} AS DOUBLE) AS x, row_number() OVER (ORDER BY {c}) AS i, count(*) OVER () AS n, avg({c}) OVER () AS mean FROM {table}" for c in columns)}),
    w AS (SELECT column_name, n, power(sum(a * x), 2) / sum(power(x - mean, 2)) AS w FROM x JOIN weight USING (n, i) GROUP BY column_name, n)
    SELECT column_name, n, w, CASE WHEN n <= 11 THEN (-ln({poly(tests.SMALL_GAMMA, "n")} - ln(1 - w)) - ({poly(tests.SMALL_MEAN, "n")})) / exp({poly(tests.SMALL_LOG_SD, "n")})
        ELSE (ln(1 - w) - ({poly(tests.LARGE_MEAN, "ln(n)")})) / exp({poly(tests.LARGE_LOG_SD, "ln(n)")}) END < 1.6448536269514722 AS p_above FROM w)"""


SHAPIRO = {"customer": ["c_custkey", "c_nationkey", "c_acctbal"], "supplier": ["s_suppkey", "s_nationkey", "s_acctbal"]}


@query("is_normal_shapiro", " UNION ALL ".join(
    f"SELECT c.column_name, c.n, coalesce(p_above, false) AS is_normal FROM (SELECT unnest({cs}) AS column_name, count(*) AS n FROM {t}) c LEFT JOIN {_shapiro_sql(t, cs)} s USING (column_name)"
    for t, cs in SHAPIRO.items()))
def is_normal_shapiro(spark, folder):
    found = [distribution.is_normal(_stats(spark, folder, t)) for t in SHAPIRO]
    return found[0].unionAll(found[1])


@query("shapiro_stat", f"SELECT column_name, n, {r('w', 6)} AS w, p_above AS is_normal FROM {_shapiro_sql('supplier', SHAPIRO['supplier'])}")
def shapiro_stat(spark, folder):
    return rounded(distribution.shapiro(_stats(spark, folder, "supplier")).drop("p_value"), 6)


def bins_sql(table, column, size):
    """Counts of equal bins; `size` is an SQL expression over n, lo, hi, q1 and q3."""
    return f"""
    SELECT '{column}' AS column_name, CAST(bin AS BIGINT) AS bin, {r("lo + bin * (hi - lo) / k")} AS lower, {r("lo + (bin + 1) * (hi - lo) / k")} AS upper,
           coalesce(cnt, 0) AS cnt
    FROM (SELECT lo, hi, k, unnest(range(CAST(k AS BIGINT))) AS bin FROM (SELECT lo, hi, {size} AS k FROM (
            SELECT CASE WHEN min({column}) = max({column}) THEN min({column}) - 0.5 ELSE min({column}) END AS lo,
                   CASE WHEN min({column}) = max({column}) THEN max({column}) + 0.5 ELSE max({column}) END AS hi,
                   CAST(count({column}) AS DOUBLE) AS n, quantile_cont({column}, 0.25) AS q1, quantile_cont({column}, 0.75) AS q3 FROM {table})))
    LEFT JOIN (SELECT CASE WHEN v < lo + b * w THEN b - 1 WHEN b <> k - 1 AND v >= lo + (b + 1) * w THEN b + 1 ELSE b END AS bin, count(*) AS cnt FROM (
            SELECT v, lo, k, (hi - lo) / k AS w, least(floor((v - lo) * (k / (hi - lo))), k - 1) AS b FROM (
                SELECT CAST({column} AS DOUBLE) AS v FROM {table} WHERE {column} IS NOT NULL), (
                SELECT lo, hi, {size} AS k FROM (
                SELECT CAST(CASE WHEN min({column}) = max({column}) THEN min({column}) - 0.5 ELSE min({column}) END AS DOUBLE) AS lo,
                       CAST(CASE WHEN min({column}) = max({column}) THEN max({column}) + 0.5 ELSE max({column}) END AS DOUBLE) AS hi,
                       CAST(count({column}) AS DOUBLE) AS n, quantile_cont({column}, 0.25) AS q1, quantile_cont({column}, 0.75) AS q3 FROM {table})))
        GROUP BY 1) USING (bin)"""


AUTO = """CASE WHEN lo = hi THEN 1 ELSE ceil((hi - lo) / least(greatest(2 * (q3 - q1) / n ** (1.0::DOUBLE / 3), (hi - lo) / sqrt(n) / 2),
    (hi - lo) / (log2(n) + 1))) END"""


@query("histogram_20", given(T) + " UNION ALL ".join(bins_sql(T, c, "20") for c in DIRTY_NUMERIC))
def histogram_20(spark, folder):
    return rounded(distribution.histogram(_stats(spark, folder), DIRTY_NUMERIC, 20))


AUTOED = {"events": ["event_id", "user_id", "value"], "documents": ["doc_id", "n_chars"], "orders": ["o_orderkey", "o_custkey", "o_totalprice"]}


@query("histogram_auto", " UNION ALL ".join(bins_sql(t, c, AUTO) for t, cs in AUTOED.items() for c in cs))
def histogram_auto(spark, folder):
    found = [distribution.histogram(_stats(spark, folder, t), cs, "auto") for t, cs in AUTOED.items()]
    return rounded(found[0].unionAll(found[1]).unionAll(found[2]))


LABEL = "CASE WHEN abs(coalesce(g, 0)) < 0.5 THEN 'approximately normal' WHEN g > 0 THEN 'right-skewed' ELSE 'left-skewed' END"


@query("distribution_label_a", given(T) + f"SELECT column_name, {LABEL} AS distribution_type FROM ("
       + each(DIRTY_NUMERIC, f"SELECT '{{c}}' AS column_name, {SMALL_G1} AS g FROM {T}") + ")")
def distribution_label_a(spark, folder):
    return distribution.distribution_labels(_stats(spark, folder))


EVENT_NUMBERS = ["event_id", "user_id", "value"]


@query("distributions_a", "SELECT b.*, s.* EXCLUDE (column_name) FROM (" + " UNION ALL ".join(bins_sql("events", c, AUTO) for c in EVENT_NUMBERS)
       + f") b JOIN (SELECT column_name, false AS is_normal, {LABEL} AS distribution_type, {r('g')} AS skewness, {r('k')} AS kurtosis FROM ("
       + each(EVENT_NUMBERS, f"SELECT '{{c}}' AS column_name, {SMALL_G1} AS g, {KURTOSIS} AS k FROM events HAVING count({{c}}) > 5000") + ")) s USING (column_name)")
def distributions_a(spark, folder):
    return rounded(distribution.distributions(_stats(spark, folder, "events")))


def _outside(table, columns):
    return " UNION ALL ".join(f"""
    SELECT '{c}' AS column_name, {OUT.format(t=table, c=c)} AS outlier_count, {r(OUT.format(t=table, c=c) + " * 100.0 / n")} AS outlier_pct,
           {r("q1 - 1.5 * (q3 - q1)")} AS lower_bound, {r("q3 + 1.5 * (q3 - q1)")} AS upper_bound
    FROM (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3, count({c}) AS n FROM {table})""" for c in columns)


def far_sql(table, column):
    return f"(SELECT count(*) FROM {table}, (SELECT avg({column}) AS m, stddev_pop({column}) AS s FROM {table}) WHERE s > 0 AND abs(({column} - m) / s) > 3)"


@query("outliers_iqr_a", given(T) + f"SELECT * FROM ({_outside(T, DIRTY_NUMERIC)}) WHERE outlier_count > 0")
def outliers_iqr_a(spark, folder):
    return rounded(outliers.iqr_outliers(_stats(spark, folder)))


@query("outliers_zscore_a", given(T) + "SELECT * FROM (" + each(DIRTY_NUMERIC, "SELECT '{c}' AS column_name, k AS outlier_count, "
       + r("k * 100.0 / n") + f" AS outlier_pct FROM (SELECT count({{c}}) AS n FROM {T}), (SELECT " + far_sql(T, "{c}") + " AS k)") + ") WHERE outlier_count > 0")
def outliers_zscore_a(spark, folder):
    return rounded(outliers.zscore_outliers(_stats(spark, folder)))


@query("outlier_analysis", given(T) + "SELECT *, CAST(sum(n_outliers) OVER () AS BIGINT) AS total_outliers FROM (" + each(DIRTY_NUMERIC, f"""
    SELECT '{{c}}' AS column_name, {OUT.replace("{t}", T)} AS n_outliers, {far_sql(T, "{c}")} AS n_zscore
    FROM (SELECT quantile_cont({{c}}, 0.25) AS q1, quantile_cont({{c}}, 0.75) AS q3 FROM {T})""") + ")")
def outlier_analysis(spark, folder):
    return outliers.outlier_analysis(_stats(spark, folder))


@query("outlier_advice", f"""
    SELECT column_name, CASE WHEN outlier_pct > 10 THEN concat('Column ''', column_name, ''' has ', CAST(round(outlier_pct, 1) AS DECIMAL(5, 1)), '% outliers - use robust methods')
           ELSE concat('Column ''', column_name, ''' has moderate outliers (', CAST(round(outlier_pct, 1) AS DECIMAL(5, 1)), '%)') END AS recommendation
    FROM ({_outside("documents", ["doc_id", "n_chars"])}) WHERE outlier_pct > 5""")
def outlier_advice(spark, folder):
    return outliers.outlier_advice(_stats(spark, folder, "documents"))
