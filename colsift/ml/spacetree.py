"""A tree of cuts over points in any number of dimensions, in two levels.

The upper tree is grown on a bounded sample and deals the points out to coarse leaves of about `coarse_rows` points. A node is cut
in two, in the dimension and at the value that make the fewest guests for the halving: points within eps of the other side, whose
extent is that of its own points, so that cuts in gaps of eps or more make none. Then the box around the points of every leaf is
measured, and a point goes as a guest to each leaf whose box a ball of radius eps around it can reach. In its coarse leaf each
group of points is cut further in the same way. So all neighbours of a point are found among the entries of its home leaf alone.

Where cuts come to lie steers only how even the leaves are, never which pairs meet. A node that no cut divides without making
most of its points guests stays whole: there most points are neighbours anyway. Coarse leaves that stay far too large are passed on
as they are, and their rows meet in a join; in all other leaves rows meet as arrays.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

LEAF_ROWS = 256
COARSE_ROWS = 20_000
# the upper tree has at most so many leaves, and its sample so many points a leaf
MAX_LEAVES = 8192
SAMPLE_PER_LEAF = 32
# a cut is not made if it gives more guests than this share of the node's points
MOST_GUESTS = 0.75
# a coarse leaf so many times too large is not taken into one task
TOO_LARGE = 8
PARTS = 16
PAIRS_AT_ONCE = 1 << 17


@dataclass
class Node:
    leaf: int = -1
    dim: int = 0
    cut: float = 0.0
    sides: tuple[Node, Node] | None = None
    low: np.ndarray | None = None
    high: np.ndarray | None = None


def _best_cut(x: np.ndarray, eps: float) -> tuple[int, float] | None:
    best, found = np.inf, None
    for dim in range(x.shape[1]):
        s = np.sort(x[:, dim][~np.isnan(x[:, dim])])
        n = len(s)
        if not n or s[0] == s[-1]:
            continue
        places = s[np.arange(PARTS // 4, PARTS * 3 // 4 + 1) * n // PARTS]
        at = np.unique(np.concatenate([np.searchsorted(s, places, "left"), np.searchsorted(s, places, "right")]))
        at = at[(at > 0) & (at < n)]
        if not len(at):
            continue
        guests = at - np.searchsorted(s, s[at] - eps, "left") + np.searchsorted(s, s[at - 1] + eps, "right") - at
        share = at / n
        gain = -share * np.log2(share) - (1 - share) * np.log2(1 - share)
        cost = np.where(guests > MOST_GUESTS * n, np.inf, np.log2(1.02 + guests / n) / gain)
        place = int(np.argmin(cost))
        if cost[place] < best:
            best, found = cost[place], (dim, float(s[at[place]]))
    return found


def grown(x: np.ndarray, eps: float, leaf_rows: int) -> tuple[Node, list[int]]:
    """The tree whose leaves have at most `leaf_rows` of the points, where cuts can make them, and the leaves far beyond that."""
    root, leaves, large = Node(), 0, []
    todo = [(root, np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        found = _best_cut(x[rows], eps) if len(rows) > leaf_rows else None
        if found is None:
            large += [leaves] if len(rows) > TOO_LARGE * leaf_rows else []
            node.leaf, leaves = leaves, leaves + 1
            continue
        node.dim, node.cut = found
        node.sides = Node(), Node()
        right = x[rows, node.dim] >= node.cut
        todo += [(node.sides[0], rows[~right]), (node.sides[1], rows[right])]
    return root, large


def homes(root: Node, x: np.ndarray) -> np.ndarray:
    """The leaf each point lies in."""
    found, todo = np.zeros(len(x), np.int64), [(root, np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        if node.sides is None:
            found[rows] = node.leaf
        elif len(rows):
            right = x[rows, node.dim] >= node.cut
            todo += [(node.sides[0], rows[~right]), (node.sides[1], rows[right])]
    return found


def _boxed(node: Node, boxes: dict[int, tuple[np.ndarray, np.ndarray]]) -> Node | None:
    """The tree with the box around the points of every node; parts without points are left out."""
    if node.sides is None:
        low, high = boxes.get(node.leaf, (None, None))
        return None if low is None else Node(node.leaf, low=low, high=high)
    left, right = (_boxed(side, boxes) for side in node.sides)
    if left is None or right is None:
        return left or right
    return Node(dim=node.dim, cut=node.cut, sides=(left, right), low=np.fmin(left.low, right.low), high=np.fmax(left.high, right.high))


def _extents(x: np.ndarray, leaf: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    order = np.argsort(leaf, kind="stable")
    found, begins = np.unique(leaf[order], return_index=True)
    if len(found):
        x = x[order]
        yield from zip(found.tolist(), np.fmin.reduceat(x, begins, axis=0), np.fmax.reduceat(x, begins, axis=0))


def reached(root: Node | None, x: np.ndarray, eps: float) -> Iterator[tuple[int, np.ndarray]]:
    """(leaf, rows) of the points in reach of each leaf's box. A missing coordinate is in reach of everything."""
    todo = [(root, np.arange(len(x)))] if root is not None else []
    while todo:
        node, rows = todo.pop()
        here = x[rows]
        with np.errstate(invalid="ignore"):
            gap = np.fmax(np.fmax(node.low - here, here - node.high), 0.0)
        rows = rows[(gap * gap).sum(axis=1) <= eps * eps * (1 + 1e-9)]
        if node.sides is None:
            yield node.leaf, rows
        elif len(rows):
            todo += [(side, rows) for side in node.sides]


def _coordinates(column, d: int) -> np.ndarray:
    """Points x d; a missing coordinate is NaN."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, d)


def _boxes(points: DataFrame, root: Node, d: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """One row a leaf comes to the driver."""
    names = [f"{side}{i}" for side in ("low", "high") for i in range(d)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _coordinates(batch.column(0), d)
            found = list(_extents(x, homes(root, x)))
            edges = np.array([np.r_[low, high] for _, low, high in found]).reshape(-1, 2 * d)
            # what is missing is left out by min and max
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), *[pa.array(e, pa.float64(), from_pandas=True) for e in edges.T]],
                                             ["leaf", *names])

    rows = points.select("x").mapInArrow(run, "leaf bigint, " + ", ".join(f"{n} double" for n in names)).groupBy("leaf").agg(
        *[(F.min if n.startswith("low") else F.max)(n).alias(n) for n in names]).collect()
    number = lambda v: np.nan if v is None else v
    return {r[0]: (np.array([number(v) for v in r[1:d + 1]]), np.array([number(v) for v in r[d + 1:]])) for r in rows}


def dealt(points: DataFrame, size: int, d: int, eps: float, coarse: int) -> tuple[DataFrame, list[int], int]:
    """The `size` points (x: array of d doubles, other columns kept) once for each coarse leaf in reach: `home` and `leaf`; the leaves
    far beyond `coarse` points, and how many leaves there are."""
    kept, root, large = points.columns, Node(leaf=0), []
    if size > coarse:
        sample = points.select("x").sample(fraction=min(1.0, SAMPLE_PER_LEAF / coarse), seed=7).toArrow().column("x").combine_chunks()
        root, large = grown(_coordinates(sample, d), eps, SAMPLE_PER_LEAF)
    boxes = _boxes(points, root, d)
    boxed = _boxed(root, boxes)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _coordinates(batch.column("x"), d)
            mine = homes(root, x)
            for leaf, rows in reached(boxed, x, eps):
                if len(rows):
                    yield pa.RecordBatch.from_arrays([*batch.take(pa.array(rows)).columns, pa.array(mine[rows] == leaf), pa.array(np.full(len(rows), leaf))],
                                                     [*kept, "home", "leaf"])

    schema = StructType([*points.schema.fields, StructField("home", BooleanType()), StructField("leaf", LongType())])
    return points.mapInArrow(deal, schema), large, len(boxes)


def with_leaves(points: DataFrame, d: int, eps: float, leaf_rows: int = LEAF_ROWS, coarse_rows: int = COARSE_ROWS) -> DataFrame:
    """The points (x: array of d doubles, other columns kept) once for each leaf in reach: `key`, the leaf, and `home`."""
    kept, size = points.columns, points.count()
    leaves, large, _ = dealt(points, size, d, eps, max(coarse_rows, leaf_rows, -(-size // MAX_LEAVES)))
    own, home_field = list(points.schema.fields), StructField("home", BooleanType())

    def refine(table: pa.Table) -> pa.Table:
        x, home = _coordinates(table.column("x").combine_chunks(), d), table.column("home").to_numpy(zero_copy_only=False).astype(bool)
        lower, _ = grown(x[home], eps, leaf_rows)
        mine = homes(lower, x)
        boxes = {leaf: (low, high) for leaf, low, high in _extents(x[home], mine[home])}
        parts = [(leaf, rows) for leaf, rows in reached(_boxed(lower, boxes), x, eps) if len(rows)]
        rows = np.concatenate([r for _, r in parts])
        leaf = np.repeat([leaf for leaf, _ in parts], [len(r) for _, r in parts])
        out = table.take(pa.array(rows)).select(kept)
        name = str(table.column("leaf")[0].as_py())
        keys = pa.array([f"{name}.{i}" for i in range(int(leaf.max()) + 1)]).take(pa.array(leaf))
        return out.append_column("key", keys).append_column("home", pa.array(home[rows] & (mine[rows] == leaf)))

    fine = leaves.filter(~F.col("leaf").isin(large)).groupBy("leaf").applyInArrow(refine, StructType([*own, StructField("key", StringType()), home_field]))
    if not large:
        return fine
    return fine.unionByName(leaves.filter(F.col("leaf").isin(large)).select(*kept, F.col("leaf").cast("string").alias("key"), "home"))


def meet(left: DataFrame, right: DataFrame, boxes: tuple[tuple[str, str], tuple[str, str]], d: int, limit: float) -> DataFrame:
    """Pairs of rows with the same key whose boxes, named by the columns of their lower and upper corners, have a squared distance of
    at most `limit`: all columns but the key and, in coarse leaves that were passed on, pairs that are farther apart as well."""
    schema = StructType([f for df in (left, right) for f in df.schema.fields if f.name != "key"])
    arrow = to_arrow_schema(schema)

    def pairs(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return arrow.empty_table()
        low, high = ([_coordinates(t.column(side[k]).combine_chunks(), d).T.copy() for t, side in zip((a, b), boxes)] for k in (0, 1))
        step, found = max(1, PAIRS_AT_ONCE // b.num_rows), []
        for i in range(0, a.num_rows, step):
            total = np.zeros((min(step, a.num_rows - i), b.num_rows))
            for k in range(d):
                gap = low[0][k, i:i + step, None] - high[1][k]
                if boxes[0][0] != boxes[0][1]:
                    gap = np.maximum(np.maximum(gap, low[1][k] - high[0][k, i:i + step, None]), 0.0)
                total += gap * gap
            u, v = np.nonzero(total <= limit)
            found.append((u + i, v))
        u, v = (pa.array(np.concatenate(side)) for side in zip(*found))
        return pa.Table.from_arrays([*a.drop(["key"]).take(u).columns, *b.drop(["key"]).take(v).columns], schema=arrow)

    small = F.contains("key", F.lit("."))
    near = left.filter(small).groupBy("key").cogroup(right.filter(small).groupBy("key")).applyInArrow(pairs, schema)
    return near.unionAll(left.filter(~small).join(right.filter(~small), "key").select(*schema.names))
