"""Histograms and normality tests."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from colsift.functions import tests
from colsift.functions.values import ref
from colsift.operators.profile import value_counts
from colsift.plans.stats import TableStats

MAX_TEST_SIZE = 5000
MIN_DISTRIBUTION_SIZE = 11


def normality_k2(stats: TableStats) -> DataFrame:
    """D'Agostino-Pearson test from the moments; a p-value above 0.05 is normal."""
    stats.need("moments", "shape")
    names = [c for c in stats.roles.numeric if stats.fact(c, "n")]
    k2 = tests.k2_statistic(F.col("n"), F.col("skew"), F.col("kurtosis"))
    return (stats.frame(["n", "skew", "kurtosis"], names).withColumn("statistic", k2)
            .withColumn("p_value", tests.k2_p_value(F.col("statistic")))
            .select("column_name", "n", "statistic", "p_value",
                    F.coalesce(F.col("p_value") > 0.05, F.lit(False)).alias("is_normal")))


def normality_k2_gated(stats: TableStats) -> DataFrame:
    """The same for columns of 3 to 5000 values only."""
    return normality_k2(stats).filter(F.col("n").between(3, MAX_TEST_SIZE))


def shapiro(stats: TableStats) -> DataFrame:
    """Shapiro-Wilk W and p-value of the columns with 3 to 5000 values.

    The gate bounds every window group; the weights depend on the size alone.
    """
    stats.need("moments")
    fit = [c for c in stats.roles.numeric if 3 <= (stats.fact(c, "n") or 0) <= MAX_TEST_SIZE
           and stats.fact(c, "min") != stats.fact(c, "max")]
    schema = "column_name string, n bigint, w double, p_value double, is_normal boolean"
    if not fit:
        return stats.rows([], schema)
    weights = stats.rows(
        [{"n": n, "place": i + 1, "weight": w} for n in sorted({stats.fact(c, "n") for c in fit})
         for i, w in enumerate(tests.shapiro_weights(n))], "n bigint, place bigint, weight double")
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(stats.fact(c, "n")).cast("bigint").alias("n"),
                               F.lit(stats.fact(c, "mean")).alias("mean"), stats.numeric(c).alias("x")) for c in fit])
    flat = stats.df.select(F.explode(cells).alias("t")).select("t.*").filter("x is not null")
    place = F.row_number().over(Window.partitionBy("column_name").orderBy("x"))
    ranked = flat.withColumn("place", place.cast("bigint")).join(F.broadcast(weights), ["n", "place"])
    w = F.pow(F.sum(F.col("weight") * F.col("x")), F.lit(2)) / F.sum(F.pow(F.col("x") - F.col("mean"), F.lit(2)))
    rows = []
    for r in ranked.groupBy("column_name", "n").agg(w.alias("w")).collect():
        p = tests.shapiro_p_value(min(r["w"], 1.0), r["n"])
        rows.append({"column_name": r["column_name"], "n": r["n"], "w": r["w"], "p_value": p, "is_normal": p > 0.05})
    return stats.rows(rows, schema)


def is_normal(stats: TableStats) -> DataFrame:
    """Shapiro-Wilk verdict per numeric column; false outside 3 to 5000 values."""
    stats.need("moments")
    verdict = shapiro(stats).select("column_name", "is_normal")
    return stats.frame(["n"], stats.roles.numeric).join(F.broadcast(verdict), "column_name", "left").select(
        "column_name", "n", F.coalesce("is_normal", F.lit(False)).alias("is_normal"))


def auto_bins(n: int, low: float, high: float, iqr: float) -> int:
    """Number of equal bins: the narrower of Sturges' width and the Freedman-Diaconis width kept above a floor."""
    spread = high - low
    if n == 0 or spread == 0:
        return 1
    sturges = spread / (math.log2(n) + 1)
    freedman = 2 * iqr / n ** (1 / 3) if math.isfinite(iqr) else 0.0
    width = min(max(freedman, spread / math.sqrt(n) / 2), sturges)
    return max(1, math.ceil(spread / width))


def _finite_ends(stats: TableStats, columns: list[str]) -> dict[str, tuple]:
    """(smallest, largest) finite value of each column that has values; one more scan where an end is infinite."""
    ends = {c: (stats.fact(c, "min"), stats.fact(c, "max")) for c in columns if stats.fact(c, "n")}
    open_ = [c for c, e in ends.items() if not all(map(math.isfinite, e))]
    if open_:
        finite = {c: F.when(F.abs(stats.numeric(c)) < math.inf, stats.numeric(c)) for c in open_}
        row = stats.df.agg(*[f(finite[c]) for c in open_ for f in (F.min, F.max)]).first()
        ends |= {c: (row[2 * i], row[2 * i + 1]) for i, c in enumerate(open_)}
    return ends


def histogram(stats: TableStats, columns: list[str], bins: int | str = 20) -> DataFrame:
    """(column_name, bin, lower, upper, cnt) of equal bins over [min, max], empty ones included, the last one closed.

    Infinities are counted apart: bin -1 from -inf to -inf, and the bin after the last from inf to inf, where there are any.
    All columns are counted in one shuffle of (column, bin) partial counts; one row per column is sent out, its bins are made
    by the executors.
    """
    stats.need("moments")
    if bins == "auto":
        stats.need_quantiles(0.25, 0.75)
    layout = []
    for c, (low, high) in _finite_ends(stats, columns).items():
        if low is None:
            low = high = 0.0  # nothing but infinities
        size = auto_bins(stats.fact(c, "n"), low, high, stats.fact(c, "q0.75") - stats.fact(c, "q0.25")) if bins == "auto" else bins
        if low == high:
            low, high = low - 0.5, high + 0.5
        layout.append({"column_name": c, "low": low, "high": high, "size": size})
    if not layout:
        return stats.rows([], "column_name string, bin bigint, lower double, upper double, cnt bigint")
    # one expression for all columns: each value looks its column's layout up by the column's number
    of = lambda value: F.array(*[F.lit(value(r)) for r in layout])[F.col("number")]
    low, size = of(lambda r: float(r["low"])), of(lambda r: r["size"])
    step = of(lambda r: (r["high"] - r["low"]) / r["size"])
    x = F.col("x")
    guess = F.least(F.floor((x - low) * of(lambda r: r["size"] / (r["high"] - r["low"]))), size - 1)
    # the product can land one bin off near an edge; the edges themselves decide
    place = (F.when(x == math.inf, size).when(x == -math.inf, F.lit(-1)).when(x < low + F.col("guess") * step, F.col("guess") - 1)
             .when((F.col("guess") != size - 1) & (x >= low + (F.col("guess") + 1) * step), F.col("guess") + 1)
             .otherwise(F.col("guess")))
    cells = F.array(*[stats.numeric(r["column_name"]).cast("double") for r in layout])
    names = F.array(*[F.lit(r["column_name"]) for r in layout])
    counted = (stats.df.select(F.posexplode(cells).alias("number", "x")).filter("x is not null").withColumn("guess", guess)
               .select("number", place.cast("bigint").alias("bin")).groupBy("number", "bin").agg(F.count("*").alias("cnt"))
               .select(names[F.col("number")].alias("column_name"), "bin", "cnt"))
    columns_ = stats.rows(layout, "column_name string, low double, high double, size bigint")
    all_bins = columns_.select("*", F.explode(F.sequence(F.lit(-1).cast("bigint"), "size")).alias("bin"))
    step = (F.col("high") - F.col("low")) / F.col("size")
    outside = lambda inside: (F.when(F.col("bin") < 0, -math.inf).when(F.col("bin") == F.col("size"), math.inf).otherwise(inside))
    upper = F.when(F.col("bin") == F.col("size") - 1, F.col("high")).otherwise(F.col("low") + (F.col("bin") + 1) * step)
    return all_bins.join(counted, ["column_name", "bin"], "left").filter(
        F.col("bin").between(0, F.col("size") - 1) | F.col("cnt").isNotNull()).select(
        "column_name", "bin", outside(F.col("low") + F.col("bin") * step).alias("lower"), outside(upper).alias("upper"),
        F.coalesce("cnt", F.lit(0)).alias("cnt"))


def shape_label(skew):
    return (F.when(F.abs(skew) < 0.5, "approximately normal").when(skew > 0, "right-skewed")
            .otherwise("left-skewed"))


def distribution_labels(stats: TableStats) -> DataFrame:
    stats.need("moments", "shape")
    names = [c for c in stats.roles.numeric if stats.fact(c, "n")]
    skew = F.coalesce("skew", F.lit(0.0))
    return stats.frame(["n", "skew"], names).select("column_name", shape_label(skew).alias("distribution_type"))


def distributions(stats: TableStats) -> DataFrame:
    """Per numeric column with more than ten values: normality, label, shape and its automatic histogram's bins."""
    stats.need("moments", "shape")
    names = [c for c in stats.roles.numeric if (stats.fact(c, "n") or 0) >= MIN_DISTRIBUTION_SIZE]
    shape = stats.frame(["n", "skew", "kurtosis"], names).join(
        F.broadcast(is_normal(stats).select("column_name", "is_normal")), "column_name").select(
        "column_name", "is_normal", shape_label(F.coalesce("skew", F.lit(0.0))).alias("distribution_type"),
        F.col("skew").alias("skewness"), "kurtosis")
    return histogram(stats, names, "auto").join(F.broadcast(shape), "column_name")


def column_distribution(stats: TableStats, column: str) -> DataFrame:
    """The histogram of a numeric column with more than ten values, else all value counts."""
    if column in stats.roles.numeric:
        return distributions(TableStats(stats.df.select(ref(column)), stats.flavor, stats.small_count))
    return value_counts(stats.df, column)
