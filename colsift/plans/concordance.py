"""Kendall's tau-b of all pairs of columns from one chain of jobs, without forming pairs of rows.

Each column's values are cut into buckets of about equal numbers of rows; a value with a bucket's worth of rows is a bucket of
its own. A discordant pair of rows then lies in one bucket of y (counted there), or in one bucket of x and two of y (counted
there, on y's bucket numbers), or in two buckets of both (counted on the table of bucket numbers). So every row goes once to
the bucket of each of its columns, whatever the number of pairs; inside, inversions are counted by merging. Rows of a heavy
value are tied in that column and are only counted. A bucket has less than twice its size in rows, and the driver holds the
bounds, one number a bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from colsift.plans import ordering
from colsift.plans.session import cut_lineage, discard, together

ROWS_PER_BUCKET = 500_000
MAX_BUCKETS = 32_768
STRIPE = 64
COMPARED = 16

Bounds = list[tuple[np.ndarray, np.ndarray]]


def inversions(ranks: np.ndarray) -> int:
    """Pairs of places whose later number is smaller. Short blocks are compared place by place; then two neighbouring blocks at a time
    are merged by sorting, and what comes over from the right one before a number of the left one is counted."""
    n, width = len(ranks), COMPARED
    if n < 2:
        return 0
    filler = int(ranks.max()) + 1  # behind all others and larger: in no such pair
    now = np.full(-(-n // width) * width, filler, np.int32 if filler < 1 << 30 else np.int64)
    now[:n] = ranks
    now = now.reshape(-1, width)
    total = sum(int(np.count_nonzero(now[:, :-s] > now[:, s:])) for s in range(1, width))
    while len(now) > 1:
        if len(now) % 2:
            now = np.concatenate([now, np.full((1, width), filler, now.dtype)])
        key = now << 1
        key[1::2] |= 1
        key = key.reshape(-1, 2 * width)
        key.sort(axis=1)
        # a number of the right block is before all that follow it; those of its own block are taken off
        total += int((key & 1).sum(axis=0, dtype=np.int64) @ np.arange(2 * width, 0, -1)) - len(key) * (width * (width + 1) // 2)
        now, width = key >> 1, 2 * width
    return total


def _bounds(rows: DataFrame, columns: int, rows_per_bucket: int) -> Bounds:
    """For each column the first value of every bucket, and whether the bucket is one heavy value."""
    stacked = ", ".join(f"{i}, x{i}" for i in range(columns))
    long = rows.selectExpr(f"stack({columns}, {stacked}) as (c, x)").filter("x is not null")
    values = cut_lineage(long.groupBy("c", "x").agg(F.count("*").alias("n")), "values")
    size, most = values.agg(F.count("*"), F.max("n")).first()[0], values.groupBy("c").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0
    per_bucket = max(rows_per_bucket, -(-most // MAX_BUCKETS))
    below = ordering.running_totals(values, "x", {"n": "below"}, size, group="c")
    heavy = F.col("n") >= per_bucket
    bucket = 2 * F.floor(F.col("below") / per_bucket) + heavy.cast("int")
    found = below.groupBy("c", bucket.alias("b")).agg(F.min("x").alias("low"), F.bool_or(heavy).alias("heavy")).collect()
    discard(values)
    result = []
    for c in range(columns):
        own = sorted((r["low"], r["heavy"]) for r in found if r["c"] == c)
        result.append((np.array([o[0] for o in own], float), np.array([o[1] for o in own], bool)))
    return result


def _bucketed(batch: pa.RecordBatch, bounds: Bounds) -> tuple[np.ndarray, np.ndarray]:
    """The values of a batch, NaN where missing, and their buckets, -1 where missing."""
    x = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(len(bounds))])
    buckets = np.stack([np.where(np.isnan(v), -1, np.searchsorted(b[0], v, "right") - 1) for v, b in zip(x, bounds)])
    return x, buckets


def _cells(rows: DataFrame, bounds: Bounds, pairs: list[tuple[int, int]]) -> DataFrame:
    """(pair, cx, cy, n): rows by bucket numbers of both columns, where both are present."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, buckets = _bucketed(batch, bounds)
            out = []
            for p, (a, b) in enumerate(pairs):
                some = (buckets[a] >= 0) & (buckets[b] >= 0)
                width = len(bounds[b][0]) + 1
                cells, n = np.unique(buckets[a][some] * width + buckets[b][some], return_counts=True)
                out.append(np.stack([np.full(len(n), p), cells // width, cells % width, n]))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.concatenate(out, axis=1).astype(np.int64)], ["pair", "cx", "cy", "n"])

    return rows.mapInArrow(run, "pair bigint, cx bigint, cy bigint, n bigint").groupBy("pair", "cx", "cy").agg(F.sum("n").alias("n"))


def _across(cells: DataFrame) -> DataFrame:
    """(pair, swapped): discordant pairs of rows that differ in both bucket numbers, from stripes of x buckets with the counts
    by y bucket of all stripes before."""
    striped = cells.withColumn("stripe", F.floor(F.col("cx") / STRIPE))
    sums = striped.groupBy("pair", "stripe", "cy").agg(F.sum("n").alias("n"))
    later = striped.select("pair", "stripe").distinct()
    # a count of a stripe is wanted in every later one; they are summed along the stripes where a y bucket occurs, and spread
    grid = later.join(sums.select("pair", "cy").distinct(), "pair").join(sums, ["pair", "stripe", "cy"], "left")
    along = Window.partitionBy("pair", "cy").orderBy("stripe").rowsBetween(Window.unboundedPreceding, -1)
    before = grid.withColumn("before", F.sum("n").over(along)).filter("before > 0")
    both = striped.select("pair", "stripe", "cx", "cy", "n").unionByName(
        before.select("pair", "stripe", F.lit(-1).cast("bigint").alias("cx"), "cy", F.col("before").alias("n")))

    def count(table: pa.Table) -> pa.Table:
        cx, cy, n = (table.column(c).to_numpy() for c in ("cx", "cy", "n"))
        names, cy = np.unique(cy, return_inverse=True)
        base, swapped = np.zeros(len(names) + 1, object), 0
        for x in np.unique(cx):
            here = cx == x
            if x >= 0:
                above = np.cumsum(base[::-1])[::-1]
                swapped += int((n[here].astype(object) * above[cy[here] + 1]).sum())
            np.add.at(base, cy[here], n[here].astype(object))
        return pa.table({"pair": table.column("pair")[:1], "swapped": pa.array([str(swapped)])})

    return both.groupBy("pair", "stripe").applyInArrow(count, "pair bigint, swapped string").select(
        "pair", F.col("swapped").cast("decimal(38,0)").alias("swapped"))


def _tied(counts: np.ndarray) -> int:
    return int((counts * (counts - 1) // 2).sum())


def _inside(rows: DataFrame, bounds: Bounds, pairs: list[tuple[int, int]]) -> DataFrame:
    """(pair, swapped, ties_x, ties_y, both) of rows that share a bucket, heavy ones left out. The y of a pair alternates between
    its columns, so that no column's buckets do all the work."""
    columns = len(bounds)
    number = {p: i for i, p in enumerate(pairs)}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, buckets = _bucketed(batch, bounds)
            for c in range(columns):
                some = np.flatnonzero(buckets[c] >= 0)
                some = some[~bounds[c][1][buckets[c][some]]]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), c)), pa.array(buckets[c][some]), *[pa.array(v[some]) for v in x]],
                                                 ["c", "b", *(f"x{i}" for i in range(columns))])

    def count(table: pa.Table) -> pa.Table:
        c = table.column("c")[0].as_py()
        x = [table.column(f"x{i}").to_numpy() for i in range(columns)]
        rank = np.unique(x[c], return_inverse=True)[1].astype(np.int64)
        rows_ = []
        for d in range(columns):
            if d == c:
                continue
            pair = (min(c, d), max(c, d))
            there = ~np.isnan(x[d])
            if not there.any():
                continue
            mine, other = rank[there], x[d][there]
            ties = _tied(np.bincount(mine))
            is_y = c == pair[(pair[0] + pair[1]) % 2]
            swapped = both = 0
            bucket = np.searchsorted(bounds[d][0], other, "right") - 1
            if is_y:
                theirs = np.unique(other, return_inverse=True)[1].astype(np.int64)
            else:
                theirs = bucket
            size = int(theirs.max()) + 1
            key = np.sort(mine * size + theirs)
            if size > 1:
                swapped = inversions(key % size)
            if is_y:
                both = _tied(np.diff(np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])))
            elif (heavy := bounds[d][1][bucket]).any():  # ties in a heavy y are not seen in y's buckets
                both = _tied(np.unique(mine[heavy] * len(bounds[d][0]) + bucket[heavy], return_counts=True)[1])
            rows_.append((number[pair], swapped, 0 if c == pair[1] else ties, ties if c == pair[1] else 0, both))
        columns_ = list(zip(*rows_)) or [()] * 5
        return pa.table({n: pa.array(v, pa.int64()) for n, v in zip(("pair", "swapped", "ties_a", "ties_b", "both"), columns_)})

    names = ", ".join(f"x{i} double" for i in range(columns))
    dealt = rows.mapInArrow(deal, f"c bigint, b bigint, {names}")
    return dealt.groupBy("c", "b").applyInArrow(count, "pair bigint, swapped bigint, ties_a bigint, ties_b bigint, both bigint")


def kendall_pairs(values: DataFrame, rows_per_bucket: int = ROWS_PER_BUCKET) -> list[float | None]:
    """Tau-b of every pair of the (double) columns of `values`, in the order of combinations; None where a column is constant.
    A pair counts the rows where both are present; NaN is missing."""
    columns = len(values.columns)
    pairs = list(combinations(range(columns), 2))
    if not pairs:
        return []
    rows = cut_lineage(values.select(*[F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None)).alias(f"x{i}") for i, c in enumerate(values.columns)]), "cells")
    bounds = _bounds(rows, columns, rows_per_bucket)
    cells = cut_lineage(_cells(rows, bounds, pairs), "cells")
    exact = lambda name: F.sum(F.col(name).cast("decimal(38,0)")).alias(name)
    heavy = lambda side, at: F.array_contains(F.array(*[F.lit(p * (MAX_BUCKETS * 4) + int(b)) for p, pair in enumerate(pairs)
                                                        for b in np.flatnonzero(bounds[pair[at]][1])] or [F.lit(-1)]),
                                              (F.col("pair") * (MAX_BUCKETS * 4) + F.col(side)).cast("int"))
    two = lambda n: F.col(n).cast("decimal(38,0)") * (F.col(n) - 1) / 2
    marginal = lambda side, at: {r["pair"]: int(r["t"]) for r in cells.groupBy("pair", side).agg(F.sum("n").alias("n")).filter(heavy(side, at)).groupBy("pair").agg(
        F.sum(two("n")).alias("t")).collect()}
    inside, across, n, heavy_a, heavy_b, heavy_both = together(values.sparkSession, [
        lambda: {r["pair"]: r for r in _inside(rows, bounds, pairs).groupBy("pair").agg(*map(exact, ("swapped", "ties_a", "ties_b", "both"))).collect()},
        lambda: {r["pair"]: int(r["swapped"]) for r in _across(cells).groupBy("pair").agg(exact("swapped")).collect()},
        lambda: {r["pair"]: int(r["n"]) for r in cells.groupBy("pair").agg(exact("n")).collect()},
        lambda: marginal("cx", 0), lambda: marginal("cy", 1),
        lambda: {r["pair"]: int(r["t"]) for r in cells.filter(heavy("cx", 0) & heavy("cy", 1)).groupBy("pair").agg(F.sum(two("n")).alias("t")).collect()}])
    discard(rows, cells)
    found: list[float | None] = []
    for p in range(len(pairs)):
        whole, own = n.get(p, 0), inside.get(p)
        every = whole * (whole - 1) // 2
        part = lambda name: int(own[name]) if own else 0
        ties_a, ties_b = part("ties_a") + heavy_a.get(p, 0), part("ties_b") + heavy_b.get(p, 0)
        swapped = part("swapped") + across.get(p, 0)
        if whole < 2 or ties_a == every or ties_b == every:
            found.append(None)
            continue
        surplus = every - ties_a - ties_b + part("both") + heavy_both.get(p, 0) - 2 * swapped
        found.append(surplus / ((every - ties_a) ** 0.5 * (every - ties_b) ** 0.5))
    return found
