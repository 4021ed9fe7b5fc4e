"""Density clustering (DBSCAN) as joins on a grid.

The cell side is eps / sqrt(d), so all points of one cell are neighbours of each other. A cell with min_samples points
therefore holds core points only, and no pairs inside it are needed, however many points it holds. Only the fewer than
min_samples points of a thin cell are compared with the neighbouring cells, which is linear work. Whether two cells with
core points are linked is decided on bounding boxes; those that leave it open are split until few points are left in a pair.

Up to four features the neighbouring cells are listed. Beyond, there are too many of them: a tree of cuts deals the points out to
leaves over all features, each with the points in reach of it, and `leafwise` clusters each leaf in one task. Where the tree finds a
leaf too large for that, finer leaves of about `leaf_rows` points are written out and pairs are formed inside leaves only. `compared_pairs` tells beforehand how many: at most the points of thin cells times the largest leaf with its guests.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, functions as F

from colsift.functions.values import ref
from colsift.ml import leafwise
from colsift.ml.components import components
from colsift.ml.spacetree import LEAF_ROWS, meet, with_leaves
from colsift.plans.ordering import dense_codes
from colsift.plans.session import cut_lineage

LISTED_DIMENSIONS = 4
SPLIT = 4
# box pairs of at most so many point pairs are compared point by point
PAIRS_COMPARED = 4096


def _squares(steps: list[Column]) -> Column:
    return reduce(lambda total, step: total + step * step, steps, F.lit(0.0))


def _distance2(a: str, b: str, d: int) -> Column:
    """Written out feature by feature, so that it is compiled."""
    return _squares([F.col(a)[i] - F.col(b)[i] for i in range(d)])


def _offsets(dimensions: int, side: float, eps: float) -> list[tuple]:
    """Cell offsets whose cells can hold points within eps, the cell itself included."""
    reach = math.ceil(eps / side)
    gap2 = lambda o: sum(max(abs(i) - 1, 0) ** 2 for i in o) * side * side
    return [o for o in product(range(-reach, reach + 1), repeat=dimensions) if gap2(o) <= eps * eps]


def _cell_of(x: Column, side: float) -> Column:
    return F.transform(x, lambda v: F.floor(v / side))


def _shifted(cell: Column, offsets: list[tuple]) -> Column:
    table = F.array(*[F.array(*[F.lit(i).cast("bigint") for i in o]) for o in offsets])
    return F.transform(table, lambda o: F.zip_with(cell, o, lambda a, b: a + b))


def _points(df: DataFrame, x: Column, side: float) -> DataFrame:
    """Distinct points `x` with their number of rows `w`, their cell and the rows of the cell."""
    points = df.select(x.alias("x")).groupBy("x").agg(F.count("*").alias("w")).withColumn("cell", _cell_of(F.col("x"), side))
    return points.join(points.groupBy("cell").agg(F.sum("w").alias("cell_w")), "cell")


def _entries(points: DataFrame, d: int, side: float, eps: float, leaf_rows: int):
    """The points by the key they are found at (one of them `home`), and the function from home rows to keys to look at."""
    if d <= LISTED_DIMENSIONS:
        offsets = _offsets(d, side, eps)
        return (cut_lineage(points.withColumns({"key": F.col("cell"), "home": F.lit(True)}), "points"),
                lambda rows: rows.withColumn("key", F.explode(_shifted(F.col("key"), offsets))))
    # rows are few and pairs many: a fixed number of partitions, as adaptive merging goes by bytes alone
    spread = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (cut_lineage(with_leaves(cut_lineage(points, "points"), d, eps, leaf_rows), "leaves"),
            lambda rows: rows.repartition(spread, "key"))


def _same(a: str, b: str) -> Column:
    """Whether two points are equal; a hash goes first, as sorting by arrays is slow."""
    return (F.xxhash64(a) == F.xxhash64(b)) & (F.col(a) == F.col(b))


def _near(around: DataFrame, found: DataFrame, d: int, eps: float) -> DataFrame:
    """The pairs of `around` (p, key) and `found` (key, x and more) within eps of each other."""
    met = around.join(found, "key") if d <= LISTED_DIMENSIONS else meet(around, found, (("p", "p"), ("x", "x")), d, eps * eps)
    return met.filter(_distance2("p", "x", d) <= eps * eps)


def _feature(name: str) -> Column:
    return ref(name).cast("double") + F.lit(0.0)


def _grid(features: list[str], eps: float) -> tuple[Column, int, float]:
    if not features:
        raise ValueError("dbscan needs a feature")
    return (F.array(*[_feature(c) for c in features]), len(features),
            eps / math.sqrt(len(features)) * (1 - 1e-9))


def compared_pairs(df: DataFrame, features: list[str], eps: float = 0.5, min_samples: int = 5, leaf_rows: int = LEAF_ROWS) -> int:
    """How many pairs of points `dbscan` compares to count neighbours: per key, points of thin cells times points found there."""
    x, d, side = _grid(features, eps)
    entries, look = _entries(_points(df, x, side), d, side, eps, leaf_rows)
    looking = look(entries.filter(F.col("home") & (F.col("cell_w") < min_samples))).groupBy("key").agg(F.count("*").alias("a"))
    found = entries.groupBy("key").agg(F.count("*").alias("b"))
    return looking.join(found, "key").agg(F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0))).first()[0]


def dbscan(df: DataFrame, features: list[str], eps: float = 0.5, min_samples: int = 5, leaf_rows: int = LEAF_ROWS,
           core_column: str | None = None) -> DataFrame:
    """The rows with `prediction`: a cluster number from 0, or -1 for noise; `core_column` names a flag of core points, if wished.

    A border point within reach of several clusters takes the one whose cells come first.
    """
    x, d, side = _grid(features, eps)
    if d > LISTED_DIMENSIONS:
        by_leaf = leafwise.clusters(df, [_feature(c) for c in features], side, eps, min_samples, leaf_rows)
        if by_leaf:
            return _with_predictions(df.withColumn("_key", by_leaf[0]), by_leaf[1], F.col("_key") == F.col("_id"), df.columns, core_column)
    entries, look = _entries(_points(df, x, side), d, side, eps, leaf_rows)

    thin = entries.filter(F.col("cell_w") < min_samples)
    around = look(thin.filter("home").select(F.col("x").alias("p"), "key"))
    near = _near(around, entries.select("key", "x", "w"), d, eps)
    counted = near.groupBy("p").agg(F.sum("w").alias("near_w")).filter(F.col("near_w") >= min_samples)
    core = entries.filter(F.col("cell_w") >= min_samples).select("cell", "key", "home", "x").unionAll(
        thin.join(counted, _same("x", "p"), "left_semi").select("cell", "key", "home", "x"))
    core = cut_lineage(core, "core")

    nodes = core.filter("home").select(F.col("cell").alias("node")).distinct()
    labels = components(nodes, _linked_cells(core, d, look, side, eps))
    labels = labels.select(F.col("node").alias("cell"), F.col("root"))
    numbers = dense_codes(labels, "root")
    labels = labels.join(numbers, F.col("root") == F.col("level")).select("cell", F.col("code").alias("prediction"))
    core_labels = cut_lineage(core.join(labels, "cell"), "core-labels")

    rest = around.join(core.filter("home").select(F.col("x").alias("_x")), _same("p", "_x"), "left_anti")
    border = (_near(rest, core_labels.select("key", "x", "prediction"), d, eps)
              .groupBy("p").agg(F.min("prediction").alias("prediction")).select(F.col("p").alias("_x"), "prediction", F.lit(False).alias("_core")))
    found = core_labels.filter("home").select(F.col("x").alias("_x"), "prediction", F.lit(True).alias("_core")).unionAll(border)
    return _with_predictions(df.withColumn("_key", x), found, _same("_key", "_x"), df.columns, core_column)


def _with_predictions(rows: DataFrame, found: DataFrame, same: Column, columns: list[str], core_column: str | None) -> DataFrame:
    flag = [F.coalesce("_core", F.lit(False)).alias(core_column)] if core_column else []
    return rows.join(found, same, "left").select(
        *[ref(c) for c in columns], F.coalesce("prediction", F.lit(-1)).cast("bigint").alias("prediction"), *flag)


def _boxes(core: DataFrame, d: int, side: float, level: int) -> DataFrame:
    """Per cell and box of the given level: lower corner, upper corner, one of its points and how many there are."""
    fine = side / SPLIT**level
    corner = lambda f: F.array(*[f(F.col("x")[i]) for i in range(d)])
    # the minimum of an array sorts the rows, a hash before the arrays makes that quick
    return (core.withColumn("box", _cell_of(F.col("x"), fine)).groupBy(F.xxhash64("key", "cell", "box").alias("_hash"), "key", "cell", "box")
            .agg(corner(F.min).alias("low"), corner(F.max).alias("high"), F.min("x").alias("some"), F.count("*").alias("n")).drop("_hash"))


def _linked_cells(core: DataFrame, d: int, look, side: float, eps: float) -> DataFrame:
    """(u, v) of the cell pairs, u before v, with core points within eps of each other.

    A cell cut by the tree comes as one box for each leaf at first; the boxes it is split into later are whole ones.
    """
    at_home = core.filter("home")
    side_of = lambda boxes, tag: boxes.select(*[F.col(c).alias(f"{c}_{tag}") for c in ("cell", "box", "low", "high", "some", "n")])
    left = look(_boxes(at_home, d, side, 0)).select(
        "key", *[F.col(c).alias(f"{c}_u") for c in ("cell", "box", "low", "high", "some", "n")])
    right = _boxes(core, d, side, 0).select("key", *[F.col(c).alias(f"{c}_v") for c in ("cell", "box", "low", "high", "some", "n")])
    if d <= LISTED_DIMENSIONS:
        pairs = left.join(right, "key")
    else:
        pairs = meet(left, right, (("low_u", "high_u"), ("low_v", "high_v")), d, eps * eps * (1 + 1e-9))
    pairs = pairs.filter(F.col("cell_u") < F.col("cell_v"))
    links, level = None, 0
    while True:
        gap = _squares([F.greatest(F.col("low_u")[i] - F.col("high_v")[i], F.col("low_v")[i] - F.col("high_u")[i], F.lit(0.0))
                        for i in range(d)])
        met = _distance2("some_u", "some_v", d) <= eps * eps
        judged = cut_lineage(pairs.withColumn("linked", met).filter(F.col("linked") | (gap <= eps * eps * (1 + 1e-9)))
                             .groupBy("cell_u", "box_u", "cell_v", "box_v")
                             .agg(F.bool_or("linked").alias("linked"), F.max(F.col("n_u") * F.col("n_v")).alias("n")), "boxes")
        sure = judged.filter("linked").select(F.col("cell_u").alias("u"), F.col("cell_v").alias("v")).distinct()
        undecided = judged.filter("not linked").join(
            sure, (F.col("cell_u") == F.col("u")) & (F.col("cell_v") == F.col("v")), "left_anti").drop("linked")
        # pairs of few points are compared now, the others split
        few, close = at_home.withColumn("box", _cell_of(F.col("x"), side / SPLIT**level)), undecided.filter(F.col("n") <= PAIRS_COMPARED)
        for tag in ("u", "v"):
            close = close.join(few.select(*[F.col(c).alias(f"{c}_{tag}") for c in ("cell", "box", "x")]), [f"cell_{tag}", f"box_{tag}"])
        close = close.filter(_distance2("x_u", "x_v", d) <= eps * eps)
        found = sure.unionAll(close.select(F.col("cell_u").alias("u"), F.col("cell_v").alias("v"))).distinct()
        links = found if links is None else links.unionAll(found)
        undecided = cut_lineage(undecided.filter(F.col("n") > PAIRS_COMPARED).drop("n"), "undecided")
        if undecided.isEmpty():
            return links
        level += 1
        parent = lambda tag: F.transform(f"box_{tag}", lambda b: F.floor(b / SPLIT))
        finer = _boxes(at_home, d, side, level)
        pairs = undecided.withColumnsRenamed({"box_u": "up_u", "box_v": "up_v"})
        for tag in ("u", "v"):
            pairs = pairs.join(side_of(finer, tag).withColumn(f"up_{tag}", parent(tag)), [f"cell_{tag}", f"up_{tag}"])
