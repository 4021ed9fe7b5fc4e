"""Exact linear-interpolation quantiles of many columns.

Few values go through Spark's `percentile`, whose map of values must fit one task. Beyond SMALL_COUNT the wanted ranks
are selected instead: a scan counts equal buckets of each bracket, [min, max] at first; the bucket that holds the rank is
the next bracket, narrowed to the values that occur in it; a bracket of few rows is fetched. Only (column, bucket) counts
are shuffled. A bucket that holds one value settles its rank, however many rows have it. Infinities are counted apart, so
that the brackets are finite. Both ways interpolate alike, so the limit between them does not show in a result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame, functions as F

from colsift.plans.session import together

COLUMNS_PER_SCAN = 4
SMALL_COUNT = 200_000
BUCKETS = 4096
FETCH_LIMIT = 8192
# above ln of the largest and the negated ln of the smallest positive double
LOG_SHIFT = 745.2


@dataclass(frozen=True)
class _Bracket:
    """The values from lo to hi, which hold `rows` rows and have `below` rows before them."""

    column: str
    lo: float
    hi: float
    rows: int
    below: int
    by_log: bool = False

    def bucket(self, x: Column) -> Column:
        scale = _log_scale if self.by_log else lambda v: v
        start, end = scale(F.lit(self.lo)), scale(F.lit(self.hi))
        # halves first, so that the width of the whole double range does not overflow
        share = (scale(x) / 2 - start / 2) / (end / 2 - start / 2)
        return F.least(F.floor(share * BUCKETS), F.lit(BUCKETS - 1)).cast("int")


def _log_scale(x: Column) -> Column:
    """A monotone scale on which doubles of all magnitudes spread out."""
    return F.when(x == 0, 0.0).otherwise(F.signum(x) * (F.log(F.abs(x)) + LOG_SHIFT))


def interpolate(low: float, high: float, place: float) -> float:
    """The value at `place` between the values of the ranks around it, in the same arithmetic as `percentile`."""
    below, above = math.floor(place), math.ceil(place)
    return low if below == above or low == high else (above - place) * low + (place - below) * high


def exact_quantiles(df: DataFrame, columns: dict[str, Column], counts: dict[str, int], probs: list[float],
                    small_count: int = SMALL_COUNT, fetch_limit: int = FETCH_LIMIT,
                    ends: dict[str, tuple[float, float]] | None = None) -> dict[str, list]:
    """For each named numeric expression the quantiles at `probs`; None where there are no values.

    `ends` are known smallest and largest values; where both are finite no scan is spent on them.
    """
    small = [c for c in columns if 0 < counts[c] <= small_count]
    large = [c for c in columns if counts[c] > small_count]
    found: dict[str, list] = {c: [None] * len(probs) for c in columns}
    for start in range(0, len(small), 40):
        part = small[start:start + 40]
        row = df.agg(*[F.percentile(columns[c], [float(p) for p in probs]).alias(f"q{i}")
                       for i, c in enumerate(part)]).first()
        for i, c in enumerate(part):
            found[c] = list(row[i])

    def select(part: list[str]) -> dict[tuple, float]:
        wanted = {c: sorted({f((counts[c] - 1) * p) for p in probs for f in (math.floor, math.ceil)}) for c in part}
        return _select_ranks(df, {c: columns[c] for c in part}, counts, wanted, fetch_limit, ends or {})

    parts = [large[i:i + COLUMNS_PER_SCAN] for i in range(0, len(large), COLUMNS_PER_SCAN)]
    for part, at in zip(parts, together(df.sparkSession, [partial(select, p) for p in parts]) if parts else []):
        for c in part:
            places = [(counts[c] - 1) * p for p in probs]
            found[c] = [interpolate(at[c, math.floor(x)], at[c, math.ceil(x)], x) for x in places]
    return found


def _finite_ends(df, columns, ends) -> dict[str, tuple]:
    """(smallest finite value, largest finite value, how many are -inf, how many are inf) per column."""
    known = {c: (*ends[c], 0, 0) for c in columns if c in ends and all(e is not None and math.isfinite(e) for e in ends[c])}
    open_ = [c for c in columns if c not in known]
    if open_:
        finite = {c: F.when(F.abs(columns[c]) < math.inf, columns[c]) for c in open_}
        row = df.agg(*[e for c in open_ for e in (
            F.min(finite[c]), F.max(finite[c]), F.count_if(columns[c] == -math.inf), F.count_if(columns[c] == math.inf))]).first()
        known |= {c: tuple(row[4 * i:4 * i + 4]) for i, c in enumerate(open_)}
    return known


def _select_ranks(df, columns, counts, wanted, fetch_limit, ends) -> dict[tuple, float]:
    """(column, rank) -> value, by scans that narrow the brackets of all columns at once."""
    found: dict[tuple, float] = {}
    spots: dict[tuple, _Bracket] = {}
    for c, (low, high, below, above) in _finite_ends(df, columns, ends).items():
        for rank in wanted[c]:
            if rank < below:
                found[c, rank] = -math.inf
            elif rank >= counts[c] - above:
                found[c, rank] = math.inf
            else:
                spots[c, rank] = _Bracket(c, low, high, counts[c] - below - above, below)
    while True:
        for key, b in list(spots.items()):
            if b.lo == b.hi:
                found[key] = b.lo
                del spots[key]
        if not spots:
            return found
        brackets = sorted(set(spots.values()), key=lambda b: (b.column, b.lo))
        numbers = {b: i for i, b in enumerate(brackets)}
        tables = _count_buckets(df, columns, brackets, numbers, fetch_limit)
        for key, b in spots.items():
            below = b.below
            for lo, hi, rows in tables[numbers[b]]:
                if key[1] < below + rows:
                    # hardly narrower: the values span magnitudes, so the other scale is next
                    by_log = not b.by_log if rows * 16 > b.rows else False
                    if b.by_log and (lo, hi) == (b.lo, b.hi):
                        raise RuntimeError(f"the quantiles of {b.column} do not narrow between {lo} and {hi}")
                    spots[key] = _Bracket(b.column, lo, hi, rows, below, by_log and lo < hi)
                    break
                below += rows


def _count_buckets(df, columns, brackets, numbers, fetch_limit) -> dict[int, list]:
    """Per bracket its occupied buckets in order as (lowest value, highest value, rows).

    The brackets of a column are disjoint, so every row counts at most once per column. In a bracket of at most
    `fetch_limit` rows each value is a bucket of its own.
    """
    # step by step, so that no expression is repeated inside another and the code of each step stays small
    names = {c: f"x{i}" for i, c in enumerate(columns)}
    staged = df.select(*[columns[c].alias(x) for c, x in names.items()])
    number, bucket = {}, {}
    for c, name in names.items():
        x, number[name], bucket[name] = F.col(name), F.lit(None).cast("int"), F.lit(None).cast("int")
        for b in (b for b in brackets if b.column == c):
            number[name] = F.when((x >= b.lo) & (x <= b.hi), F.lit(numbers[b])).otherwise(number[name])
            place = F.lit(-1) if b.rows <= fetch_limit else b.bucket(x)
            bucket[name] = F.when(F.col(f"{name}_number") == numbers[b], place).otherwise(bucket[name])
    staged = staged.select("*", *[n.alias(f"{x}_number") for x, n in number.items()])
    staged = staged.select("*", *[b.alias(f"{x}_bucket") for x, b in bucket.items()])
    cells = [F.struct(F.col(f"{x}_number").alias("number"), F.col(f"{x}_bucket").alias("bucket"), F.col(x).alias("x"))
             for x in names.values()]
    flat = staged.select(F.explode(F.array(*cells)).alias("t")).select("t.*").filter("number is not null")
    single = F.when(F.col("bucket") < 0, F.col("x"))
    counted = flat.groupBy("number", "bucket", single.alias("single")).agg(
        F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("n"))
    tables: dict[int, list] = {}
    for row in counted.collect():
        tables.setdefault(row["number"], []).append((row["lo"], row["hi"], row["n"]))
    return {number: sorted(rows) for number, rows in tables.items()}
