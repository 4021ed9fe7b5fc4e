"""Pairwise-complete Pearson correlation of many columns from sums of products.

The values are centred by their column's mean first, which keeps the sums accurate. Plain sums compile to one tight loop;
the same number of covariance aggregates takes about seven times as long. What a pair needs beyond its sum of products
is asked for only where one of its columns has gaps.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from colsift.plans.session import small_frame

SUMS_PER_SCAN = 150


@dataclass(frozen=True)
class Moments:
    """What is known of a whole column."""

    n: int
    mean: float | None
    var_pop: float | None
    constant: bool


def correlation(a: Column, b: Column) -> Column:
    """Pearson's r of one pair as a single expression; NULL where a column is constant."""
    spread = F.stddev_pop(F.when(b.isNotNull(), a)) * F.stddev_pop(F.when(a.isNotNull(), b))
    r = F.try_divide(F.covar_pop(a, b), spread)
    return F.when(r.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))


def pair_correlations(df: DataFrame, n_rows: int, moments: dict[str, Moments],
                      view: Callable[[str], Column]) -> DataFrame:
    """(pair, c1, c2, r) of the upper triangle, in the order of `moments`."""
    names = list(moments)
    centred = {c: view(c) - F.lit(moments[c].mean) for c in names}
    gappy = {c for c in names if moments[c].n < n_rows}
    live = [(a, b) for a, b in combinations(names, 2) if moments[a].n and moments[b].n
            and not moments[a].constant and not moments[b].constant]
    terms: dict[tuple, Column] = {}
    for a, b in live:
        product = centred[a] * centred[b]
        terms["cross", a, b] = F.sum(product)
        if a in gappy or b in gappy:
            terms["count", a, b] = F.count(product)
        for x, y in ((a, b), (b, a)):
            if y in gappy:
                inside = F.when(view(y).isNotNull(), centred[x])
                terms["sum", x, y] = F.sum(inside)
                terms["squares", x, y] = F.sum(inside * inside)
                terms["min", x, y] = F.min(inside)
                terms["max", x, y] = F.max(inside)
    got: dict[tuple, float] = {}
    keys = list(terms)
    for start in range(0, len(keys), SUMS_PER_SCAN):
        part = keys[start:start + SUMS_PER_SCAN]
        got.update(zip(part, df.agg(*[terms[k].alias(f"t{i}") for i, k in enumerate(part)]).first()))

    def spread(x, y, n):
        """Sum and centred sum of squares of x over the rows where y is present; None if x is constant there."""
        if y not in gappy:
            return 0.0, moments[x].var_pop * moments[x].n
        if not n or got["min", x, y] == got["max", x, y]:
            return None
        return got["sum", x, y], got["squares", x, y] - got["sum", x, y] ** 2 / n

    rows = []
    for i, (a, b) in enumerate(combinations(names, 2)):
        r = None
        if ("cross", a, b) in got:
            n = got.get(("count", a, b), n_rows)
            one, two = spread(a, b, n), spread(b, a, n)
            if one and two and one[1] > 0 and two[1] > 0:
                r = (got["cross", a, b] - one[0] * two[0] / n) / (math.sqrt(one[1]) * math.sqrt(two[1]))
                r = None if math.isnan(r) else max(-1.0, min(1.0, r))
        rows.append({"pair": i, "c1": a, "c2": b, "r": r})
    return small_frame(df.sparkSession, rows, "pair bigint, c1 string, c2 string, r double")
