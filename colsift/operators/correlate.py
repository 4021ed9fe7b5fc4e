"""Correlation: Pearson, Spearman and Kendall, and what is read off the matrix."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window, functions as F

from colsift.functions.values import as_double, is_missing, ref
from colsift.plans import concordance, ordering, rankings
from colsift.plans.pairs import Moments, pair_correlations
from colsift.plans.session import cut_lineage, discard
from colsift.plans.stats import TableStats


def correlation_matrix(stats: TableStats, method: str = "pearson") -> DataFrame:
    """(c1, c2, r) of every ordered pair, the diagonal included; NULL where it is undefined."""
    pairs = correlation_pairs(stats, method).select("c1", "c2", "r")
    stats.need("moments")
    own = stats.rows([{"c1": c, "c2": c, "r": 1.0 if stats.fact(c, "std_pop") else None} for c in stats.roles.numeric],
                     "c1 string, c2 string, r double")
    return pairs.unionAll(pairs.select("c2", "c1", "r")).unionAll(own)


def correlation_pairs(stats: TableStats, method: str = "pearson") -> DataFrame:
    """(pair, c1, c2, r) of the upper triangle, by pearson, spearman or kendall."""
    if method == "pearson":
        return stats.pairs
    if method not in ("spearman", "kendall"):
        raise ValueError(f"unknown method: {method}")
    named = list(combinations(stats.roles.numeric, 2))
    if method == "spearman":
        found = spearman_pairs(stats)
    else:
        found = concordance.kendall_pairs(stats.df.select(*[stats.numeric(c).alias(f"x{i}") for i, c in enumerate(stats.roles.numeric)]))
    rows = [{"pair": i, "c1": a, "c2": b, "r": r} for i, ((a, b), r) in enumerate(zip(named, found))]
    return stats.rows(rows, "pair bigint, c1 string, c2 string, r double")


def _joint_counts(df: DataFrame, a: str, b: str) -> DataFrame:
    """(x, y, cnt) over the rows where both are present."""
    types = {f.name: f.dataType for f in df.schema}
    both = df.select(as_double(ref(a), types[a]).alias("x"), as_double(ref(b), types[b]).alias("y")).dropna()
    # several jobs read the counts: they are worked out once
    return cut_lineage(both.groupBy("x", "y").agg(F.count("*").alias("cnt")), "joint")


def average_ranks(joint: DataFrame, side: str, rows_per_bucket: int = ordering.ROWS_PER_BUCKET) -> DataFrame:
    """(side, rank): the mean rank of each distinct value among all counted rows."""
    values = cut_lineage(joint.groupBy(side).agg(F.sum("cnt").alias("ties")), "values")
    below = ordering.running_total(values, side, "ties", values.count(), "below", rows_per_bucket)
    return below.select(side, (F.col("below") + (F.col("ties") + 1) / 2).alias(f"rank_{side}"))


def spearman(df: DataFrame, a: str, b: str, rows_per_bucket: int = ordering.ROWS_PER_BUCKET) -> float | None:
    """Pearson's r of the average ranks. Ranks are found on distinct values and joined to the joint counts."""
    joint = _joint_counts(df, a, b)
    ranked = (joint.join(average_ranks(joint, "x", rows_per_bucket), "x")
              .join(average_ranks(joint, "y", rows_per_bucket), "y"))
    cnt, rx, ry = F.col("cnt"), F.col("rank_x"), F.col("rank_y")
    n = joint.agg(F.sum("cnt")).first()[0]
    if not n:
        return None
    centre = (n + 1) / 2
    dx, dy = rx - centre, ry - centre
    sxy, sxx, syy = ranked.agg(F.sum(cnt * dx * dy), F.sum(cnt * dx * dx), F.sum(cnt * dy * dy)).first()
    return max(-1.0, min(1.0, sxy / (sxx**0.5 * syy**0.5))) if sxx and syy else None


def spearman_pairs(stats: TableStats, rows_per_bucket: int = ordering.ROWS_PER_BUCKET) -> list[float | None]:
    """Spearman's r of every pair of numeric columns in column order, from shared jobs.

    A column's ranks depend on its partner only through the partner's gaps. So each column has one ranking over all its rows,
    and one for each column with gaps over the rows where that is present. Blocks of rows learn the ranks of their values from
    buckets of values, and every pair is summed up inside the blocks.
    """
    columns = stats.roles.numeric
    pairs = list(combinations(columns, 2))
    if not pairs:
        return []
    stats.need("nulls")
    missing = [stats.fact(c, "n_null") for c in columns]
    plan = rankings.Rankings(len(columns), [i for i, n in enumerate(missing) if n])
    names = [f"x{i}" for i in range(len(columns))]
    rows = stats.df.select(*[stats.numeric(c).alias(n) for c, n in zip(columns, names)])
    stacked = ", ".join(f"{i}, {n}" for i, n in enumerate(names))
    long = rows.selectExpr(f"stack({len(columns)}, {stacked}) as (c, x)").filter("x is not null")
    points = ordering.split_points(long, ["c", "x"], sum(stats.n_rows - n for n in missing), rows_per_bucket)
    cells = cut_lineage(rankings.blocks(rows, plan, points), "cells")
    below, sizes = rankings.totals(cells, plan)
    ranks = cut_lineage(rankings.pair_sums(rankings.ranked(cells, plan, below), plan, sizes), "ranks")
    sums = {r["pos"]: r["s"] for r in ranks.select(F.posexplode("sums")).groupBy("pos").agg(F.sum("col").alias("s")).collect()}
    result = []
    for i in range(len(pairs)):
        sxy, sxx, syy = (sums.get(3 * i + k) for k in range(3))
        result.append(max(-1.0, min(1.0, sxy / (sxx**0.5 * syy**0.5))) if sxx and syy else None)
    discard(cells, ranks)
    return result


def kendall(df: DataFrame, a: str, b: str, rows_per_bucket: int = concordance.ROWS_PER_BUCKET) -> float | None:
    """Tau-b of one pair of columns."""
    types = {f.name: f.dataType for f in df.schema}
    return concordance.kendall_pairs(df.select(*[as_double(ref(c), types[c]).alias(f"x{i}") for i, c in enumerate((a, b))]), rows_per_bucket)[0]


def strong_pairs(stats: TableStats, threshold: float = 0.7) -> DataFrame:
    """Pairs strictly beyond the threshold, r to three places."""
    strength = F.when(F.col("r") > threshold, "strong positive").otherwise("strong negative")
    return stats.pairs.filter(F.abs("r") > threshold).select(
        "c1", "c2", F.round("r", 3).alias("correlation"), strength.alias("strength"))


def high_correlations(stats: TableStats, threshold: float = 0.7) -> DataFrame:
    """Pairs at or beyond the threshold, the strongest first."""
    return (stats.pairs.filter((F.abs("r") >= threshold) & (F.col("r") != 0))
            .select("c1", "c2", F.col("r").alias("correlation"), _sign().alias("type"))
            .orderBy(F.desc(F.abs("correlation")), "c1", "c2"))


def _sign():
    return F.when(F.col("r") > 0, "positive").otherwise("negative")


def strongest_pair(stats: TableStats) -> DataFrame:
    """The pair with the largest absolute correlation, ties by name."""
    return (stats.pairs.filter("r is not null").orderBy(F.desc(F.abs("r")), "c1", "c2").limit(1)
            .select("c1", "c2", F.abs("r").alias("correlation"), _sign().alias("type")))


def correlation_insights(stats: TableStats, limit: int = 5) -> DataFrame:
    """The strongest pairs at or beyond 0.7 in words."""
    verb = F.when(F.col("type") == "positive", "increase").otherwise("decrease")
    return high_correlations(stats).limit(limit).select(
        F.concat_ws(" and ", "c1", "c2").alias("features"), "correlation", "type",
        F.format_string("Strong %s relationship: as one increases, the other tends to %s", "type", verb)
        .alias("interpretation"))


def correlation_analysis(stats: TableStats) -> DataFrame:
    """Matrix size, method, number of high pairs and the strongest pair in one row."""
    best = F.max_by(F.struct("c1", "c2", "r"), F.when(F.col("r").isNotNull(), F.struct(F.abs("r"), -F.col("pair"))))
    return stats.pairs.agg(F.count_if((F.abs("r") >= 0.7) & (F.col("r") != 0)).alias("n_high"), best.alias("best")).select(
        F.lit(len(stats.roles.numeric)).cast("bigint").alias("matrix_size"), F.lit("pearson").alias("method_used"),
        "n_high", F.col("best.c1").alias("c1"), F.col("best.c2").alias("c2"), F.abs("best.r").alias("correlation"))


def missing_cooccurrence(stats: TableStats, threshold: float = 0.8) -> DataFrame:
    """Pairs of columns whose null indicators correlate beyond the threshold."""
    stats.need("nulls")
    known = {}
    for c in stats.df.columns:
        share = stats.fact(c, "n_null") / stats.n_rows if stats.n_rows else 0.0
        known[c] = Moments(stats.n_rows, share, share * (1 - share), share in (0.0, 1.0))
    gap = lambda c: is_missing(ref(c), stats.roles.types[c]).cast("double")
    return (pair_correlations(stats.df, stats.n_rows, known, gap)
            .filter(F.col("r") > threshold).select("c1", "c2", F.col("r").alias("correlation")))


def correlation_rounded(stats: TableStats) -> DataFrame:
    return correlation_matrix(stats).withColumn("r", F.round("r", 2))
