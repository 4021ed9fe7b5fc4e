"""Average ranks of all columns of a table, for rows that stay where they are.

The rows are cut into blocks. A block tells each of its columns' buckets of values which values it has and how often, packed as
one binary; a bucket ranks the values of all blocks and sends each block the ranks of its values back, packed in the same order.
Rows themselves are not sent: a block keeps, for each column, two bytes a row that say which of the block's values it has. So a value of
few distinct ones costs next to nothing, and any other about its digits once and the step to the next rank once for each ranking.

A ranking is over all rows where a column is present, or over those of them where one named partner is present as well. Of a bucket,
the driver holds one split value and one count for each ranking, at most `ordering.MAX_BUCKETS` of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from colsift.plans import ordering

# two bytes hold the number of a value in its block; the last number is that of a missing one
BLOCK_ROWS = 65_000
MISSING = 65_535
ROWS = -1
MOST_TASKS = 4096


@dataclass(frozen=True)
class Rankings:
    """The columns' number and, for each ranking, the partner (0: none, otherwise 1 + its place in `gaps`)."""

    columns: int
    gaps: list[int]

    def variant(self, column: int, partner: int) -> int:
        return 1 + self.gaps.index(partner) if partner in self.gaps else 0

    @property
    def all(self) -> range:
        return range(len(self.gaps) + 1)

    def needed(self, column: int) -> list[int]:
        return sorted({self.variant(column, b) for b in range(self.columns) if b != column})


def _packed(rows: np.ndarray) -> bytes:
    """Whole numbers, byte by byte of their places, so that leading zeros lie together."""
    planes = np.ascontiguousarray(rows, "<i8").view(np.uint8).reshape(-1, 8).T.tobytes()
    return pa.Codec("zstd", 1).compress(planes, asbytes=True)


def _unpacked(body: bytes, rows: int, size: int) -> np.ndarray:
    planes = pa.Codec("zstd").decompress(body, rows * size * 8, asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, -1).T).view("<i8").reshape(rows, size)


def _steps(numbers: np.ndarray) -> np.ndarray:
    """Each number less the one before, modulo 2^64."""
    return np.diff(numbers, axis=-1, prepend=np.int64(0))


def _from_steps(steps: np.ndarray) -> np.ndarray:
    return np.cumsum(steps, axis=-1, dtype=np.int64)


def blocks(rows: DataFrame, rankings: Rankings, points: list[tuple]) -> DataFrame:
    """(block, c, bucket, size, n0, n1 ..., body) of a table of doubles: a column's values in a bucket, how many rows have them in each
    ranking, and values and counts packed; with `c` = ROWS once for each block, the values' numbers row by row.

    Which rows form a block depends on how they are read: the table is to be written before it is used twice."""
    bounds = [np.array([x for column, x in points if column == c], float) for c in range(rankings.columns)]
    counts = [f"n{v}" for v in rankings.all]

    def block(number: int, columns: list[np.ndarray]) -> pa.RecordBatch:
        present = [~np.isnan(x) for x in columns]
        inside = [np.ones(len(columns[0]), bool), *[present[g] for g in rankings.gaps]]
        made, codes = [], np.full((rankings.columns, len(columns[0])), MISSING, np.uint16)
        for c, x in enumerate(columns):
            values, code = np.unique(x[present[c]], return_inverse=True)
            codes[c, present[c]] = code
            found = np.array([np.bincount(code[taking[present[c]]], minlength=len(values)) for taking in inside])
            edges = np.unique(np.r_[0, np.searchsorted(values, bounds[c], "left"), len(values)])
            for low, high in zip(edges[:-1].tolist(), edges[1:].tolist()):
                some = values[low:high] + 0.0
                made.append((c, int(np.searchsorted(bounds[c], some[0], "right")), high - low, found[:, low:high].sum(axis=1).tolist(),
                             _packed(np.vstack([_steps(some.view(np.int64)), found[:, low:high]]))))
        made.append((ROWS, 0, len(columns[0]), [0] * len(inside), pa.Codec("zstd", 1).compress(codes.view(np.uint8).reshape(-1, 2).T.tobytes(), asbytes=True)))
        c, bucket, size, total, body = zip(*made)
        return pa.RecordBatch.from_arrays([pa.array([number] * len(made), pa.int64()), pa.array(c, pa.int32()), pa.array(bucket, pa.int32()), pa.array(size, pa.int32()),
                                           *[pa.array(n, pa.int64()) for n in zip(*total)], pa.array(body, pa.binary())],
                                          ["block", "c", "bucket", "size", *counts, "body"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, kept, held = TaskContext.get().partitionId() << 33, [], 0

        def columns(parts):
            return [np.concatenate(x) for x in zip(*parts)]

        for batch in batches:
            x = [column.to_numpy(zero_copy_only=False).astype(float) for column in batch.columns]
            while held + len(x[0]) >= BLOCK_ROWS:
                cut = BLOCK_ROWS - held
                yield block(number, columns([*kept, [v[:cut] for v in x]]))
                number, kept, held, x = number + 1, [], 0, [v[cut:] for v in x]
            if len(x[0]):
                kept, held = [*kept, x], held + len(x[0])
        if held:
            yield block(number, columns(kept))

    return rows.mapInArrow(run, f"block bigint, c int, bucket int, size int, {', '.join(f'{n} bigint' for n in counts)}, body binary")


def totals(cells: DataFrame, rankings: Rankings) -> tuple[dict, dict]:
    """How many rows each ranking has in all lower buckets of a column, by (c, bucket), and altogether, by (c, ranking)."""
    found = cells.filter(F.col("c") != ROWS).groupBy("c", "bucket").agg(*[F.sum(f"n{v}").alias(f"n{v}") for v in rankings.all]).collect()
    below, sizes = {}, {}
    for row in sorted(found):
        key = row["c"], row["bucket"]
        below[key] = [sizes.get((row["c"], v), 0) for v in rankings.all]
        for v in rankings.all:
            sizes[row["c"], v] = sizes.get((row["c"], v), 0) + row[f"n{v}"]
    return below, sizes


def ranked(cells: DataFrame, rankings: Rankings, below: dict) -> DataFrame:
    """(block, c, bucket, size, body): twice the average ranks of the values a block has in a bucket, packed, in each ranking that
    the column needs; the rows with `c` = ROWS as they are."""
    needed = [rankings.needed(c) for c in range(rankings.columns)]
    tasks = max(int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(len(below), MOST_TASKS))

    def rank(table: pa.Table) -> pa.Table:
        c, bucket = table.column("c")[0].as_py(), table.column("bucket")[0].as_py()
        sizes = table.column("size").to_numpy()
        parts = [_unpacked(body.as_py(), 1 + len(rankings.all), size) for body, size in zip(table.column("body"), sizes.tolist())]
        values, place = np.unique(np.concatenate([_from_steps(p[0]).view(float) for p in parts]), return_inverse=True)
        found = np.hstack([p[1:] for p in parts])
        twice = []
        for v in needed[c]:
            ties = np.zeros(len(values), np.int64)
            np.add.at(ties, place, found[v])
            twice.append(2 * (below[c, bucket][v] + np.cumsum(ties) - ties) + ties + 1)
        twice = np.array(twice)
        ends = np.cumsum(sizes)
        body = [_packed(_steps(twice[:, place[end - size:end]])) for end, size in zip(ends.tolist(), sizes.tolist())]
        return table.select(["block", "c", "bucket", "size"]).append_column("body", pa.array(body, pa.binary()))

    same = ["block", "c", "bucket", "size", "body"]
    back = cells.filter(F.col("c") != ROWS).select(*same).repartition(tasks, "c", "bucket").groupBy("c", "bucket").applyInArrow(
        rank, "block bigint, c int, bucket int, size int, body binary")
    return back.unionAll(cells.filter(F.col("c") == ROWS).select(*same))


def pair_sums(answers: DataFrame, rankings: Rankings, sizes: dict) -> DataFrame:
    """`sums` of a block: for every pair of columns the sums of dx * dy, dx * dx and dy * dy over the rows where both are present,
    where dx is the distance of a rank from the middle one."""
    needed = [rankings.needed(c) for c in range(rankings.columns)]

    def run(table: pa.Table) -> pa.Table:
        pieces: dict[int, list] = {}
        for c, bucket, size, body in zip(*[table.column(n).to_pylist() for n in ("c", "bucket", "size", "body")]):
            pieces.setdefault(c, []).append((bucket, size, body))
        [(_, rows, body)] = pieces.pop(ROWS)
        planes = pa.Codec("zstd").decompress(body, rankings.columns * rows * 2, asbytes=True)
        codes = np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(2, -1).T).view(np.uint16).reshape(rankings.columns, rows)
        present, off = [(code != MISSING).astype(float) for code in codes], {}
        for c in range(rankings.columns):
            parts = [_from_steps(_unpacked(body, len(needed[c]), size)) for _, size, body in sorted(pieces.get(c, []))]
            twice = np.hstack(parts) if parts else np.zeros((len(needed[c]), 0), np.int64)
            place = np.minimum(codes[c].astype(np.int64), twice.shape[1])
            for v, ranks in zip(needed[c], twice):
                off[c, v] = np.r_[(ranks - (sizes.get((c, v), 0) + 1)) / 2, 0.0][place]
        sums = []
        for a, b in combinations(range(rankings.columns), 2):
            dx, dy = off[a, rankings.variant(a, b)], off[b, rankings.variant(b, a)]
            sums += [dx @ dy, (dx * dx) @ present[b], (dy * dy) @ present[a]]
        return pa.Table.from_arrays([pa.array([[float(s) for s in sums]], pa.list_(pa.float64()))], ["sums"])

    # the narrow answers are dealt out by block; a block is laid side by side in its task alone
    return answers.repartition("block").groupBy("block").applyInArrow(run, "sums array<double>")
