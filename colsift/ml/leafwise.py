"""Density clusters of many features found leaf by leaf, and put together over the points that leaves share.

A coarse leaf of the space tree holds all neighbours of its own points, so one task can tell which of these are core, and which
clusters they form among themselves. It gives back one row for each core point (its cluster inside the leaf) and one for each other
point and cluster in reach of it. Pairs of points never leave the task, so what is written and shuffled grows with the points and
their guests, however many neighbours a point has. Where a point that is core at home was reached from another leaf, the two
clusters are one; where it is not core, it is a border point. Points are known by a 64-bit hash that was seen to be unique.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from colsift.ml import spacetree
from colsift.ml.components import components
from colsift.plans.ordering import dense_codes
from colsift.plans.session import cut_lineage, discard

# a coarse leaf has so many points in a table of many, and a 64th of a smaller table
MOST_COARSE_ROWS = 100_000
LEAVES_WANTED = 64
SEEDS = 4
PAIRS_AT_ONCE = 1 << 19
TOUCHES_KEPT = 1 << 22


def _hash(x: list[Column], seed: int) -> Column:
    """Missing values are passed over by the hash, so their places go in as well."""
    return F.xxhash64(F.lit(seed), *x, *[v.isNull() for v in x])


def _find(parent: np.ndarray, points: np.ndarray) -> np.ndarray:
    found = parent[points]
    while True:
        up = parent[found]
        if np.array_equal(up, found):
            parent[points] = found
            return found
        found = up


def _unite(parent: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Roots only get smaller, so there are no cycles."""
    while len(u):
        u, v = _find(parent, u), _find(parent, v)
        apart = u != v
        u, v = np.minimum(u[apart], v[apart]), np.maximum(u[apart], v[apart])
        np.minimum.at(parent, v, u)


def near_blocks(x: np.ndarray, a: np.ndarray, b: np.ndarray, eps: float) -> Iterator[tuple[slice, np.ndarray]]:
    """(places in `a`, whether near each of `b`): squared distances as one product of matrices; those that rounding leaves open are
    summed again feature by feature. All coordinates must be finite."""
    if not len(a) or not len(b):
        return
    d, limit, centre = x.shape[1], eps * eps, x[a].mean(axis=0)
    p, q = x[a] - centre, x[b] - centre
    pp, qq = (p * p).sum(axis=1), (q * q).sum(axis=1)
    scale, top = max(pp.max(), qq.max()), max(np.abs(x[a]).max(), np.abs(x[b]).max())
    moved = 1e-14 * top * d  # by taking off the centre
    slack, kind = 5e-7 * (d + 2) * scale, np.float32
    if not slack < limit / 16:
        slack, kind = 1e-14 * (d + 2) * scale, np.float64
    slack += 2 * moved * (eps + moved) + 1e-12 * limit
    left = np.column_stack([-2 * p, pp, np.ones(len(a))]).astype(kind)
    right = np.ascontiguousarray(np.column_stack([q, np.ones(len(b)), qq]).astype(kind).T)
    step = max(1, PAIRS_AT_ONCE // len(b))
    for i in range(0, len(a), step):
        some = slice(i, i + step)
        squares = left[some] @ right
        near, open_ = squares <= limit - slack, squares <= limit + slack
        u, v = np.nonzero(near != open_) if np.count_nonzero(near) != np.count_nonzero(open_) else ((), ())
        if len(u):
            total = np.zeros(len(u))
            for k in range(d):
                gap = x[a[some][u], k] - x[b[v], k]
                total += gap * gap
            near[u, v] = total <= limit
        yield some, near


def _cells(x: np.ndarray, gaps: np.ndarray, side: float) -> np.ndarray:
    """Cells as numbers; a missing coordinate comes first, NaN is cell 0."""
    cells = np.where(np.isnan(x), 0.0, np.clip(np.floor(x / side), -2.0**63, 2.0**63 - 1024))
    cells[gaps] = -np.inf
    return cells + 0.0


def leaf_clusters(x: np.ndarray, gaps: np.ndarray, w: np.ndarray, home: np.ndarray, side: float, eps: float, min_samples: int,
                  leaf_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the points of one coarse leaf: which are core, each core point's cluster (one of its points), and the (point, cluster)
    pairs of points that are not core here in reach of a cluster's core points."""
    cells = _cells(x, gaps, side)
    code = np.unique(cells.view([("", cells.dtype)] * x.shape[1]).ravel(), return_inverse=True)[1].ravel()
    dense = np.bincount(code, weights=w) >= min_samples
    finite = np.isfinite(x).all(axis=1)
    core, total = home & dense[code], np.zeros(len(x))

    mine = np.flatnonzero(home)
    tree, _ = spacetree.grown(x[mine], eps, leaf_rows)
    leaf = spacetree.homes(tree, x[mine])
    boxed = spacetree._boxed(tree, {n: (low, high) for n, low, high in spacetree._extents(x[mine], leaf)})
    order = np.argsort(leaf, kind="stable")
    edges = np.searchsorted(leaf[order], np.arange(int(leaf.max()) + 2)) if len(leaf) else [0]
    usable = np.flatnonzero(finite)
    parts = [(n, usable[rows].astype(np.int32)) for n, rows in spacetree.reached(boxed, x[usable], eps) if len(rows)]
    own = lambda n: mine[order[edges[n]:edges[n + 1]]]

    for n, rows in parts:
        a = own(n)
        a = a[finite[a] & ~core[a]]
        for some, near in near_blocks(x, a, rows, eps):
            total[a[some]] = near.astype(float) @ w[rows]
    core |= home & finite & (total >= min_samples)

    parent, touches, kept = np.arange(len(x)), [], 0
    held = np.flatnonzero(core)
    held = held[np.argsort(code[held], kind="stable")]
    same = code[held[1:]] == code[held[:-1]]
    _unite(parent, held[1:][same], held[:-1][same])
    # the others of a crowded cell are core at home
    one = np.full(len(dense), -1)
    one[code[held]] = held
    others = np.flatnonzero(~home & dense[code])
    others = others[one[code[others]] >= 0]
    touches.append((others, one[code[others]]))

    def settled() -> tuple[np.ndarray, np.ndarray]:
        points, by = (np.concatenate(side) for side in zip(*touches))
        both = np.unique(points * len(x) + _find(parent, by))
        return both // len(x), both % len(x)

    for n, rows in parts:
        a = own(n)
        a = a[finite[a] & core[a]]
        for some, near in near_blocks(x, a, rows, eps):
            root = _find(parent, a[some])
            by = np.argsort(root, kind="stable")
            roots, starts = np.unique(root[by], return_index=True)
            r, q = np.nonzero(np.logical_or.reduceat(near[by], starts, axis=0))
            r, q = roots[r], rows[q].astype(np.int64)
            inside = core[q]
            _unite(parent, r[inside], q[inside])
            touches.append((q[~inside], r[~inside]))
            kept += len(touches[-1][0])
            if kept > TOUCHES_KEPT:
                touches, kept = [settled()], 0
    return core, _find(parent, np.arange(len(x))), *settled()


def clusters(df: DataFrame, x: list[Column], side: float, eps: float, min_samples: int, leaf_rows: int) -> tuple[Column, DataFrame] | None:
    """The id of each row's point as an expression, and (_id, prediction, _core) of the points in a cluster. None if a coarse leaf cannot
    be cut to a size for one task, or if no hash is unique."""
    d, spark = len(x), df.sparkSession
    names = [f"x{i}" for i in range(d)]
    points = cut_lineage(df.select(*[v.alias(n) for v, n in zip(x, names)]).groupBy(*names).agg(F.count("*").alias("w")), "points")
    for seed in range(SEEDS):
        known = points.select(_hash([F.col(n) for n in names], seed).alias("id"), "w", F.array(*names).alias("x"))
        most, size = known.groupBy("id").agg(F.count("*").alias("n")).agg(F.max("n"), F.sum("n")).first()
        if (most or 0) <= 1:
            break
    else:
        discard(points)
        return None
    coarse = max(spacetree.COARSE_ROWS, leaf_rows, min(MOST_COARSE_ROWS, (size or 0) // LEAVES_WANTED), -(-(size or 0) // spacetree.MAX_LEAVES))
    leaves, large, count = spacetree.dealt(known, size or 0, d, eps, coarse)
    if large:
        discard(points)
        return None
    edges = ", ".join(f"c{i} bigint" for i in range(d))

    def run(table: pa.Table) -> pa.Table:
        column = table.column("x").combine_chunks()
        coordinates = spacetree._coordinates(column, d)
        gaps = column.flatten().is_null().to_numpy(zero_copy_only=False).reshape(-1, d)
        ids, w = table.column("id").to_numpy(), table.column("w").to_numpy().astype(float)
        home = table.column("home").to_numpy().astype(bool)
        core, cluster, touched, by = leaf_clusters(coordinates, gaps, w, home, side, eps, min_samples, leaf_rows)
        held = np.flatnonzero(core)
        # a cluster is told by its first point and has the lowest of its cells there
        cells = _cells(coordinates[held], gaps[held], side)
        order = np.lexsort([*cells.T[::-1], cluster[held]])
        found, first = np.unique(cluster[held][order], return_index=True)
        low, place = cells[order[first]], np.searchsorted(held, found)
        filler = np.ones(len(held) + len(touched), bool)
        filler[place] = False
        out = [pa.array(np.concatenate([ids[held], ids[touched]])), pa.array(np.concatenate([ids[cluster[held]], ids[by]])),
               pa.array(np.arange(len(filler)) < len(held))]
        for k in range(d):
            values, missing = np.zeros(len(filler), np.int64), filler.copy()
            missing[place] = np.isneginf(low[:, k])
            values[place] = np.where(np.isneginf(low[:, k]), 0, low[:, k]).astype(np.int64)
            out.append(pa.array(values, mask=missing))
        return pa.Table.from_arrays(out, ["id", "cluster", "core", *[f"c{i}" for i in range(d)]])

    # leaves are few and their work long: more partitions than leaves, so that few share one
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(2 * count, 4096))
    inside = cut_lineage(leaves.repartition(tasks, "leaf").groupBy("leaf").applyInArrow(run, f"id bigint, cluster bigint, core boolean, {edges}"),
                         "inside")
    discard(points)
    core = inside.filter("core").select("id", "cluster")
    first = inside.filter("core and id = cluster")
    # a point that is core at home links two clusters, any other one is a border point
    touched = inside.filter("not core").select("id", F.col("cluster").alias("by")).join(core, "id", "left")
    met = cut_lineage(touched.filter("cluster is null or cluster <> by")
                      .select(F.when(F.col("cluster").isNull(), F.col("id")).alias("border"), "by", "cluster").distinct(), "met")
    roots = components(first.select(F.col("cluster").alias("node")), met.filter("cluster is not null").select(F.col("by").alias("u"), F.col("cluster").alias("v")))
    lowest = cut_lineage(first.join(roots, F.col("cluster") == F.col("node")).groupBy("root").agg(
        F.min(F.array(*[f"c{i}" for i in range(d)])).alias("cell")), "lowest")
    numbers = lowest.join(dense_codes(lowest, "cell"), F.col("cell") == F.col("level")).select("root", F.col("code").alias("prediction"))
    labels = cut_lineage(roots.join(numbers, "root").select("node", "prediction"), "labels")
    border = (met.filter("border is not null").join(labels, F.col("by") == F.col("node"))
              .groupBy("border").agg(F.min("prediction").alias("prediction")).select(F.col("border").alias("_id"), "prediction", F.lit(False).alias("_core")))
    found = core.join(labels, F.col("cluster") == F.col("node")).select(F.col("id").alias("_id"), "prediction", F.lit(True).alias("_core"))
    return _hash(x, seed), found.unionAll(border)
