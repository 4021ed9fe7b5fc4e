"""Second-order gradient boosting of trees on binned features.

Features are cut at quantiles into at most 255 bins, gaps have a bin of their own. All rows begin with the same score and so
with the same second derivative, hence quantiles weighted by it are those of the rows. A round fits one tree for each class (one
for two classes or a number) to first and second derivatives of the loss: sums by (tree, node, feature, bin) are formed in the
tasks, added in one shuffle, and the best split of each node is searched where its sums meet; gaps go to the side that gains more.
A level is one job, whatever the number of classes and features; the driver sees one row a node. A table of at most `rows_in_task`
rows would spend its time on starting jobs, so one task takes all its rows and up to `REWRITE` rounds at once, with the same functions.

Scores are not kept up to date in place: the written rows carry those of some rounds before, and the tasks add the trees since.
Every few rounds (`REWRITE`) the rows are written anew, so lost executors cost no more than the job they were in. They are spread over
tasks by their number and written in blocks of up to BLOCK rows, whose numbers are one byte string each, as a level
takes little more than the time to hand rows over.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from colsift.functions.values import ref
from colsift.ml.prepare import FEATURES, LABEL
from colsift.plans.session import ROWS_PER_TASK, cut_lineage, discard, spread_rows

BINS, GAP = 256, 255
REWRITE = 10  # rounds of one task
REWRITE_LEVELS = 3  # rounds by levels: every level adds the trees since
BLOCK = 65_536
# sums of one node by feature, bin and task that one task may add
SUMS_AT_ONCE = 2_000_000
LEAST_GAIN = 1e-6


@dataclass
class Tree:
    """Nodes numbered like a heap: the root is 1, the children of i are 2i and 2i + 1. `feature` is -1 at leaves."""

    feature: np.ndarray
    bin: np.ndarray
    gap_left: np.ndarray
    gain: np.ndarray
    value: np.ndarray

    @staticmethod
    def empty(depth: int) -> "Tree":
        size = 2 ** (depth + 1)
        return Tree(np.full(size, -1, np.int32), np.zeros(size, np.int32), np.ones(size, bool), np.zeros(size), np.zeros(size))

    def nodes(self, bins: np.ndarray, levels: int) -> np.ndarray:
        """The node that each row of `bins` (rows x features) reaches after so many levels."""
        at, every = np.ones(len(bins), np.int64), np.arange(len(bins)) * bins.shape[1]
        # where a row of each bin goes from each node, by node and bin: a step is three lookups
        left = np.where(np.arange(BINS) == GAP, self.gap_left[:, None], np.arange(BINS) <= self.bin[:, None])
        own = np.arange(len(self.feature))[:, None]
        onward = np.where(self.feature[:, None] < 0, own, 2 * own + 1 - left).ravel()
        feature, seen = np.maximum(self.feature, 0).astype(np.int64), np.ascontiguousarray(bins).ravel()
        for _ in range(levels):
            at = onward.take(at * BINS + seen.take(every + feature.take(at)))
        return at


@dataclass(frozen=True)
class Settings:
    classes: int = 0
    maxIter: int = 100
    maxDepth: int = 6
    stepSize: float = 0.3
    regLambda: float = 1.0
    minChildWeight: float = 1.0
    rows_in_task: int = 200_000
    seed: int | None = None  # nothing is drawn

    @property
    def scores(self) -> int:
        return self.classes if self.classes > 2 else 1


def derivatives(margins: np.ndarray, label: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the loss by the scores, both rows x scores: squared error, logistic or softmax."""
    if not settings.classes:
        return margins - label[:, None], np.ones_like(margins)
    if settings.scores == 1:
        p, truth = 1 / (1 + np.exp(-margins)), label[:, None]
        return p - truth, np.maximum(p * (1 - p), 1e-16)
    e = np.exp(margins - margins.max(axis=1, keepdims=True))
    p = e / e.sum(axis=1, keepdims=True)
    truth = label[:, None] == np.arange(settings.scores)
    return p - truth, np.maximum(2 * p * (1 - p), 1e-16)


def level_sums(bins: np.ndarray, g: np.ndarray, h: np.ndarray, at: np.ndarray, level: int) -> np.ndarray:
    """Sums of (g, h) by node of the level, feature and bin; rows that ended in a leaf above are left out."""
    width = 2 ** level
    live = at >= width
    bins, g, h, local = bins[live], g[live], h[live], at[live] - width
    sums = np.zeros((width, bins.shape[1], BINS, 2))
    for f in range(bins.shape[1]):
        cell = local * BINS + bins[:, f]
        for i, v in enumerate((g, h)):
            sums[:, f, :, i] = np.bincount(cell, v, width * BINS).reshape(width, BINS)
    return sums


def best_split(sums: np.ndarray, settings: Settings) -> tuple[int, int, bool, float, float]:
    """(feature, last bin of the left side, gaps go left, gain, value) of one node from its sums by feature and bin; feature
    -1 without a split that gains. Ties go to the first feature, then the lowest bin, then gaps to the left."""
    g, h = sums[..., 0], sums[..., 1]
    all_g, all_h = g[0].sum(), h[0].sum()
    value = -all_g / (all_h + settings.regLambda) * settings.stepSize
    score = lambda a, b: a * a / (b + settings.regLambda)
    gains = []
    for gaps_left in (True, False):
        left_g, left_h = (np.cumsum(v[:, :GAP], axis=1)[:, :-1] + (v[:, GAP:] if gaps_left else 0) for v in (g, h))
        gain = score(left_g, left_h) + score(all_g - left_g, all_h - left_h) - score(all_g, all_h)
        gains.append(np.where(np.minimum(left_h, all_h - left_h) < settings.minChildWeight, -np.inf, gain))
    gains = np.stack(gains, axis=2)
    # gains that differ by rounding only are ties, so that the order in which tasks add their sums decides nothing
    first = np.argmax(gains >= gains.max() - 1e-9 * max(1.0, abs(gains.max())))
    feature, cut, side = np.unravel_index(first, gains.shape)
    best = float(gains[feature, cut, side])
    if not best > LEAST_GAIN:
        return -1, 0, True, 0.0, value
    return int(feature), int(cut), side == 0, best, value


def set_node(tree: Tree, node: int, split: tuple, settings: Settings) -> None:
    feature, tree.bin[node], tree.gap_left[node], gain, tree.value[node] = split
    if 2 * node < len(tree.feature):
        tree.feature[node], tree.gain[node] = feature, gain


def grown(bins: np.ndarray, g: np.ndarray, h: np.ndarray, settings: Settings) -> Tree:
    """A whole tree from rows that fit in a task."""
    tree = Tree.empty(settings.maxDepth)
    for level in range(settings.maxDepth + 1):
        at = tree.nodes(bins, level)
        sums = level_sums(bins, g, h, at, level)
        for node in np.unique(at[at >= 2 ** level]):
            set_node(tree, node, best_split(sums[node - 2 ** level], settings), settings)
    return tree


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """The bins of rows x features: how many edges are below the value; a gap for NaN."""
    out = np.empty(x.shape, np.uint8)
    for f, e in enumerate(edges):
        out[:, f] = np.where(np.isnan(x[:, f]), GAP, np.searchsorted(e, x[:, f], "left"))
    return out


def scored(bins: np.ndarray, margins: np.ndarray, rounds: list[list[Tree]], settings: Settings) -> np.ndarray:
    margins = margins.copy()
    for trees in rounds:
        for k, tree in enumerate(trees):
            margins[:, k] += tree.value[tree.nodes(bins, settings.maxDepth)]
    return margins


def _matrix(column, width: int) -> np.ndarray:
    """Rows x width from an Arrow column of lists of equal length."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)


@dataclass
class BoostedModel:
    settings: Settings
    edges: list[np.ndarray]
    base: float
    rounds: list[list[Tree]] = field(default_factory=list)

    def margins(self, x: np.ndarray) -> np.ndarray:
        start = np.full((len(x), self.settings.scores), self.base)
        return scored(binned(x, self.edges), start, self.rounds, self.settings)

    def transform(self, df: DataFrame) -> DataFrame:
        """The rows with `prediction`: a number, or the code of the likeliest class, the first one at ties."""
        model = self

        others = df.drop("prediction")
        schema = StructType([*others.schema.fields, StructField("prediction", DoubleType())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = model.margins(_matrix(batch.column(batch.num_columns - 1), len(model.edges)))
                if not model.settings.classes:
                    codes = found[:, 0]
                else:
                    codes = (found[:, 0] > 0 if found.shape[1] == 1 else found.argmax(axis=1)).astype(float)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(codes, pa.float64())], names=schema.names)

        return others.select("*", vector_to_array(FEATURES).alias("_features")).mapInArrow(run, schema).select(
            *[ref(c) for c in df.columns], *["prediction"] * ("prediction" not in df.columns))

    @property
    def featureImportances(self) -> DenseVector:
        """The mean gain of each feature's splits, as shares."""
        gain, n = np.zeros(len(self.edges)), np.zeros(len(self.edges))
        for tree in (t for trees in self.rounds for t in trees):
            inner = tree.feature >= 0
            np.add.at(gain, tree.feature[inner], tree.gain[inner])
            np.add.at(n, tree.feature[inner], 1)
        mean = gain / np.maximum(n, 1)
        return DenseVector(mean / mean.sum() if mean.sum() else mean)


class Boosting:
    """The estimator; options as in `Settings`."""

    def __init__(self, **options):
        self.settings = Settings(**options)

    def fit(self, df: DataFrame) -> BoostedModel:
        settings = self.settings
        x = vector_to_array(FEATURES)
        n, mean, some = df.agg(F.count("*"), F.avg(LABEL), F.first(x)).first()
        if not n:
            raise ValueError("boosting needs rows")
        model = BoostedModel(settings, _edges(df.select(x.alias("x")), len(some)), 0.0 if settings.classes else mean)
        rows, pending = cut_lineage(_written_form(spread_rows(df.select(x.alias("x"), LABEL), n), model), "boosting"), []
        small = n <= settings.rows_in_task
        rewrite = REWRITE if small else REWRITE_LEVELS
        # where the tasks' sums of a node are few they are dealt out by node at once, in one shuffle instead of two
        few = -(-n // ROWS_PER_TASK) * len(some) * GAP <= SUMS_AT_ONCE
        while len(model.rounds) < settings.maxIter:
            if small:
                new = _rounds_in_task(rows, pending, model, min(rewrite - len(pending), settings.maxIter - len(model.rounds)))
            else:
                new = [_grow_by_levels(rows, pending, model, few)]
            model.rounds += new
            pending += new
            if len(pending) == rewrite and len(model.rounds) < settings.maxIter:
                newer = cut_lineage(_with_scores(rows, pending, model), "boosting")
                discard(rows)
                rows, pending = newer, []
        discard(rows)
        return model


def _edges(x: DataFrame, d: int) -> list[np.ndarray]:
    """At most 254 cut points of each feature, from one mergeable quantile summary of all rows."""
    at = F.array(*[F.lit(i / (GAP - 1)) for i in range(GAP - 1)])
    value = lambda i: F.when(~F.isnan(F.col("x")[i]), F.col("x")[i])
    row = x.agg(*[F.percentile_approx(value(i), at, 100_000).alias(f"e{i}") for i in range(d)]).first()
    return [np.unique(np.array(e or [0.0])) for e in row]


ROWS = "bins binary, label binary, margins binary"


def _block(bins, label, margins) -> pa.RecordBatch:
    """One row: up to BLOCK rows of the table, each kind of numbers as one byte string."""
    kinds = zip(("bins", "label", "margins"), (bins, label, margins), (np.uint8, float, float))
    return pa.RecordBatch.from_pydict({k: pa.array([np.ascontiguousarray(v, t).tobytes()], pa.binary()) for k, v, t in kinds})


def _written_form(df: DataFrame, model: BoostedModel) -> DataFrame:
    def block(parts):
        x, label = (np.concatenate(p) for p in zip(*parts))
        return _block(binned(x, model.edges), label, np.full((len(x), model.settings.scores), model.base))

    def add(batches):
        held, n = [], 0
        for batch in filter(len, batches):
            for part in (batch.slice(i, BLOCK) for i in range(0, len(batch), BLOCK)):
                if n + len(part) > BLOCK:
                    yield block(held)
                    held, n = [], 0
                held.append((_matrix(part.column(0), len(model.edges)), part.column(1).to_numpy(zero_copy_only=False)))
                n += len(part)
        if held:
            yield block(held)

    return df.mapInArrow(add, ROWS)


def _parts(batches, pending: list, model: BoostedModel):
    """(bins, label, scores with the pending rounds) of each written block."""
    for batch in batches:
        for block in zip(*(batch.column(c) for c in ("bins", "label", "margins"))):
            bins, label, margins = (np.frombuffer(v.as_buffer(), t) for v, t in zip(block, (np.uint8, float, float)))
            bins = bins.reshape(-1, len(model.edges))
            yield bins, label, scored(bins, margins.reshape(-1, model.settings.scores), pending, model.settings)


def _slim(model: BoostedModel) -> BoostedModel:
    """The model without its trees, for tasks that get those they need."""
    return BoostedModel(model.settings, model.edges, model.base)


def _with_scores(rows: DataFrame, pending: list, model: BoostedModel) -> DataFrame:
    slim = _slim(model)

    def add(batches):
        for parts in _parts(batches, pending, slim):
            yield _block(*parts)

    return rows.mapInArrow(add, ROWS)


TREES = "round int, tree int, node int, feature int, bin int, gap_left boolean, gain double, value double"
TREE_COLUMNS = ("feature", "bin", "gap_left", "gain", "value")


def _rounds_in_task(rows: DataFrame, pending: list, model: BoostedModel, n: int) -> list[list[Tree]]:
    """The next `n` rounds by one task that holds all rows, of which there are at most `rows_in_task`."""
    slim, settings = _slim(model), model.settings

    def grow(batches):
        parts = list(_parts(batches, pending, slim))
        if not parts:
            return
        bins, label, margins = (np.concatenate(p) for p in zip(*parts))
        for r in range(n):
            g, h = derivatives(margins, label, settings)
            trees = [grown(bins, g[:, k], h[:, k], settings) for k in range(settings.scores)]
            margins = scored(bins, margins, [trees], settings)
            for k, tree in enumerate(trees):
                size = len(tree.feature)
                yield pa.RecordBatch.from_pydict(
                    {"round": np.full(size, r, np.int32), "tree": np.full(size, k, np.int32), "node": np.arange(size, dtype=np.int32)}
                    | {c: getattr(tree, c) for c in TREE_COLUMNS})

    found = rows.coalesce(1).mapInArrow(grow, TREES).toArrow().sort_by([(c, "ascending") for c in ("round", "tree", "node")])
    begins = np.flatnonzero(found.column("node").to_numpy() == 0)[1:]
    trees = [Tree(*(part.copy() for part in parts)) for parts in zip(*(np.split(found.column(c).to_numpy(), begins) for c in TREE_COLUMNS))] if len(found) else []
    return [trees[i:i + settings.scores] for i in range(0, len(trees), settings.scores)]


def _grow_by_levels(rows: DataFrame, pending: list, model: BoostedModel, few: bool) -> list[Tree]:
    """The trees of a round level by level from sums over all rows."""
    slim, settings, d = _slim(model), model.settings, len(model.edges)
    trees = [Tree.empty(settings.maxDepth) for _ in range(settings.scores)]
    for level in range(settings.maxDepth + 1):
        def sums_of(batches):
            sums = None
            for bins, label, margins in _parts(batches, pending, slim):
                g, h = derivatives(margins, label, settings)
                part = np.stack([level_sums(bins, g[:, k], h[:, k], t.nodes(bins, level), level) for k, t in enumerate(trees)])
                sums = part if sums is None else sums + part
            if sums is not None:
                k, node, f, b = np.nonzero(sums[..., 1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k.astype(np.int32)), pa.array((node + 2 ** level).astype(np.int32)), pa.array((f * BINS + b).astype(np.int32)),
                     pa.array(sums[k, node, f, b, 0]), pa.array(sums[k, node, f, b, 1])], ["tree", "node", "cell", "g", "h"])

        def split(table):
            sums, cell = np.zeros((d * BINS, 2)), table.column("cell").to_numpy()
            sums[cell, 0], sums[cell, 1] = table.column("g").to_numpy(), table.column("h").to_numpy()
            found = dict(zip(TREE_COLUMNS, best_split(sums.reshape(d, BINS, 2), settings)))
            types = (pa.int32(), pa.int32(), pa.bool_(), pa.float64(), pa.float64())
            return pa.table({"tree": table.column("tree")[:1], "node": table.column("node")[:1]} |
                            {c: pa.array([found[c].item() if hasattr(found[c], "item") else found[c]], t) for c, t in zip(TREE_COLUMNS, types)})

        parts = rows.mapInArrow(sums_of, "tree int, node int, cell int, g double, h double")
        added = (parts.repartition("tree", "node") if few else parts).groupBy("tree", "node", "cell").agg(
            F.sum("g").alias("g"), F.sum("h").alias("h"))
        splits = added.groupBy("tree", "node").applyInArrow(
            split, "tree int, node int, feature int, bin int, gap_left boolean, gain double, value double").collect()
        for tree, node, *found in splits:
            set_node(trees[tree], node, tuple(found), settings)
        if all(s["feature"] < 0 for s in splits):
            break
    return trees
