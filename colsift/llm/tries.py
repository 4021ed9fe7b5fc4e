"""Prefix trie of conversations, its subtree totals rolled up along a centroid decomposition.

A node is a distinct sequence of first turns, known by 128 bits: the exclusive or of hashes of (place, turn) along it, so that a
conversation of any length is summed up in range partitions with a carry from one to the next, and no conversation is a task
of its own. The smallest conversation through a node owns it.

Totals. A centroid of a component of the parent-edge forest is its deepest node with at least half of the component below it
(itself included); the nodes with that property are just the path from the centroid to the component's top. What the part
below the centroid adds up to is added along that path; then the centroid is taken out, each child below it becomes the top of
a component of its own, and the part above goes on with sizes reduced along the path. Every node takes part in one component a
round, and components halve, so even a chain takes a logarithmic number of rounds. Components of more than `task_nodes` nodes
take their rounds as joins and grouped sums over tables in the shared folder, smaller ones inside tasks, many at a time. The
subtree sizes that pick the first centroids come from counting what each member owns below a node.

Null roles and texts are empty texts; rows without conv_id belong to no conversation and are left out. Turns with the same
number (null comes first) are ordered by role, then text, so repeated rows are repeated turns. Texts are used whole, by digest.
An empty table gives no nodes. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from colsift.plans.session import cut_lineage, discard

TASK_NODES = 100_000
CHUNK_IDS = 50_000
ROW_BITS = 33  # of monotonically_increasing_id, the rest is the partition
NO_ENDS = hashlib.sha256(b"").hexdigest()


def _in_ranges(rows: DataFrame, keys: list, label: str) -> DataFrame:
    """The rows in range partitions by keys, each with its partition and its place there."""
    placed = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("place", F.monotonically_increasing_id())
    return cut_lineage(placed.withColumn("part", F.shiftrightunsigned("place", ROW_BITS)), label)


def _earlier(agg: Column) -> Column:
    """`agg` over the partitions before, of the same conversation: at most one row a partition."""
    return agg.over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))


def numbered(turns: DataFrame) -> DataFrame:
    """conv_id, k (from 1, in the order of turns), role and text."""
    clean = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", *[
        F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")]).filter("conv_id IS NOT NULL")
    placed = _in_ranges(clean, ["conv_id", F.asc_nulls_first("turn"), "role", "text"], "turns")
    runs = placed.groupBy("conv_id", "part").agg(F.min("place").alias("begin"), F.count("*").alias("n"))
    runs = runs.withColumn("before", F.coalesce(_earlier(F.sum("n")), F.lit(0))).drop("n")
    return placed.join(runs, ["conv_id", "part"]).select(
        "conv_id", (F.col("place") - F.col("begin") + F.col("before") + 1).alias("k"), "role", "text")


def digested(numbered_turns: DataFrame) -> DataFrame:
    """conv_id, k, two digests of the turn and the code points of its text."""
    return numbered_turns.select("conv_id", "k", F.xxhash64(F.lit("one"), "role", F.lit("text"), "text").alias("d1"), F.xxhash64(
        "text", F.lit("two"), "role").alias("d2"), F.length("text").cast("bigint").alias("chars"))


def _id(high: str, low: str) -> Column:
    return F.unhex(F.concat(F.lpad(F.hex(high), 16, "0"), F.lpad(F.hex(low), 16, "0")))


def paths(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """(conv_id, depth, node, parent, chars) for each conversation in `ids` and each number of first turns, zero included;
    `turns` is (conv_id, k, d1, d2, chars)."""
    steps = turns.select("conv_id", F.col("k").cast("bigint").alias("depth"), F.xxhash64(F.lit(1), "k", "d1", "d2").alias("s1"),
                         F.xxhash64(F.lit(2), "k", "d1", "d2").alias("s2"), "chars")
    zero = F.lit(0).cast("bigint")
    tops = ids.select("conv_id", zero.alias("depth"), zero.alias("s1"), zero.alias("s2"), zero.alias("chars"))
    placed = _in_ranges(steps.unionByName(tops), ["conv_id", "depth"], "steps")
    runs = placed.groupBy("conv_id", "part").agg(F.bit_xor("s1").alias("x1"), F.bit_xor("s2").alias("x2"))
    runs = runs.select("conv_id", "part", *[F.coalesce(_earlier(F.bit_xor(f"x{i}")), F.lit(0)).alias(f"c{i}") for i in (1, 2)])
    inside = Window.partitionBy("conv_id", "part").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    along = placed.join(runs, ["conv_id", "part"]).withColumns(
        {f"h{i}": F.bit_xor(f"s{i}").over(inside).bitwiseXOR(F.col(f"c{i}")) for i in (1, 2)}).withColumns(
        {f"p{i}": F.col(f"h{i}").bitwiseXOR(F.col(f"s{i}")) for i in (1, 2)})
    return along.select("conv_id", "depth", _id("h1", "h2").alias("node"), F.when(F.col("depth") > 0, _id("p1", "p2")).alias("parent"), "chars")


def ends_digest(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) from (node, conv_id): the digest of the ids in ascending order, joined by commas.

    Ids are sorted in range partitions. Nodes inside one partition are done there; the ids of the first and the last node of a
    partition go on as texts of many ids, and a node's texts then stream through one task, since a digest has no parts.
    """
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        node, ids, first = None, [], True

        def close(edge: bool):
            if node is not None and ids:
                text = ",".join(map(str, ids))
                rows.append((node, ids[0], text, None) if edge else (node, ids[0], None, hashlib.sha256(text.encode()).hexdigest()))

        cut = False
        for batch in batches:
            for n, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if n != node:
                    close(first or cut)
                    first = node is None
                    node, ids, cut = n, [], False
                elif len(ids) == CHUNK_IDS:
                    close(True)
                    ids, cut = [], True
                ids.append(i)
            if rows:
                yield _batch(rows)
                rows.clear()
        close(True)
        yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * 4
        types = (pa.binary(), pa.int64(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["node", "first", "ids", "ends_sha256"])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        done: list[tuple] = []
        for batch in batches:
            for n, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if n != node:
                    if node is not None:
                        done.append((node, state.hexdigest()))
                    node, state = n, hashlib.sha256(text.encode())
                else:
                    state.update(b"," + text.encode())
        if node is not None:
            done.append((node, state.hexdigest()))
        columns = list(zip(*done)) or [(), ()]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.string())], ["node", "ends_sha256"])

    spread = ends.select("node", "conv_id").repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id")
    parts = cut_lineage(spread.mapInArrow(join, "node binary, first bigint, ids string, ends_sha256 string"), "ends")
    edges = parts.filter("ids IS NOT NULL").repartition("node").sortWithinPartitions("node", "first")
    return parts.filter("ids IS NULL").select("node", "ends_sha256").unionByName(
        edges.select("node", "ids").mapInArrow(stream, "node binary, ends_sha256 string"))


def decompose(top: np.ndarray, parent: np.ndarray, size: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Subtree totals of `weights` (one column each) in many components at once.

    `top` is the row of each row's component top, `parent` its parent's row (-1 for tops), which comes before it; `size` counts
    the nodes below a row in its component, itself included.
    """
    n = len(top)
    # rows in depth-first order are intervals: a row's place, and the size of what is below it
    place, free, at = [0] * n, [0] * n, 0
    for i, (p, s) in enumerate(zip(parent.tolist(), size.tolist())):
        if p < 0:
            place[i], at = at, at + s
        else:
            place[i] = free[p]
            free[p] += s
        free[i] = place[i] + 1
    place, below = np.array(place, np.int64), size.copy()
    size, total = size.copy(), np.zeros_like(weights)
    rows, label = np.arange(n), top.copy()
    while len(rows):
        _, comp = np.unique(label[rows], return_inverse=True)
        m = int(comp.max()) + 1
        whole, least = np.zeros(m, np.int64), np.full(m, np.iinfo(np.int64).max)
        np.maximum.at(whole, comp, size[rows])
        on_path = 2 * size[rows] >= whole[comp]
        np.minimum.at(least, comp[on_path], size[rows][on_path])
        found = on_path & (size[rows] == least[comp])
        centroid = np.empty(m, np.int64)
        centroid[comp[found]] = rows[found]
        mine = centroid[comp]
        under = (place[rows] >= place[mine]) & (place[rows] < place[mine] + below[mine])
        sums = np.zeros((m, weights.shape[1]), np.int64)
        np.add.at(sums, comp[under], weights[rows[under]])
        path = rows[on_path]
        total[path] += sums[comp[on_path]]
        size[path] -= size[mine[on_path]] * (path != mine[on_path])
        # the last child before a row in its component; components cut out earlier may lie in between
        key = comp * n + place[rows]
        child, moved = np.flatnonzero(parent[rows] == mine), np.flatnonzero(under & (rows != mine))
        child = child[np.argsort(key[child])]
        label[rows[moved]] = rows[child[np.searchsorted(key[child], key[moved], "right") - 1]]
        rows = rows[rows != mine]
    return total


def _inside_tasks(ready: DataFrame, task_nodes: int) -> DataFrame:
    """(node, leaves, saved) of components that fit a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0

        def flush(table: pa.Table) -> pa.RecordBatch:
            nodes, parents, comps = (table.column(c).to_pylist() for c in ("node", "parent", "comp"))
            row = {node: i for i, node in enumerate(nodes)}
            top = np.array([row[c] for c in comps], np.int64)
            own = np.arange(len(nodes))
            parent = np.array([-1 if c == node else row[p] for node, p, c in zip(nodes, parents, comps)], np.int64)
            number = lambda name: table.column(name).to_numpy().astype(np.int64)
            total = decompose(top, parent, number("size"), np.stack([number("leaf"), number("save")], axis=1)) if len(own) else np.zeros((0, 2), np.int64)
            return pa.RecordBatch.from_arrays([table.column("node").combine_chunks(), pa.array(total[:, 0] + number("leaves")),
                                               pa.array(total[:, 1] + number("saved"))], ["node", "leaves", "saved"])

        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count >= task_nodes:
                table = pa.Table.from_batches(held).combine_chunks()
                comps = table.column("comp")
                last, cut = comps[-1].as_py(), len(comps) - 1
                while cut and comps[cut - 1].as_py() == last:  # the last component may go on
                    cut -= 1
                if cut:
                    yield flush(table.slice(0, cut).combine_chunks())
                    held, count = table.slice(cut).to_batches(), len(comps) - cut
        if held:
            yield flush(pa.Table.from_batches(held).combine_chunks())

    return ready.repartition("comp").sortWithinPartitions("comp", "depth").mapInArrow(run, "node binary, leaves bigint, saved bigint")


STATE = ["node", "parent", "conv_id", "depth", "comp", "size", "leaf", "save", "leaves", "saved"]


def _round(state: DataFrame, along: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One round for components too big for a task: the state after it, and the totals of the centroids taken out."""
    whole = state.filter("node = comp").select("comp", F.col("size").alias("whole"))
    half = state.join(whole, "comp").filter(2 * F.col("size") >= F.col("whole"))
    centroids = half.groupBy("comp", "whole").agg(F.min(F.struct("size", "node", "depth")).alias("c"))
    centroids = centroids.select("comp", "whole", F.col("c.node").alias("c_node"), F.col("c.size").alias("c_size"), F.col("c.depth").alias("c_depth"))
    # the node one step below the centroid on the owner's path, if that path goes through the centroid
    step = along.select(F.col("conv_id").alias("s_conv"), F.col("depth").alias("s_depth"), F.col("node").alias("s_node"), F.col("parent").alias("s_parent"))
    seen = state.join(centroids, "comp")
    seen = seen.join(step, (seen["conv_id"] == step["s_conv"]) & (step["s_depth"] == seen["c_depth"] + 1) & (seen["depth"] > seen["c_depth"])
                     & (step["s_parent"] == seen["c_node"]), "left")
    is_centroid, on_path = F.col("node") == F.col("c_node"), 2 * F.col("size") >= F.col("whole")
    marked = cut_lineage(seen.select(*STATE, "c_size", is_centroid.alias("is_centroid"), on_path.alias("on_path"), F.col("s_node").alias("moved")), "round")
    sums = marked.filter("is_centroid OR moved IS NOT NULL").groupBy("comp").agg(F.sum("leaf").alias("t_leaf"), F.sum("save").alias("t_save"))
    after = marked.join(sums, "comp").withColumns({
        "leaves": F.col("leaves") + F.when(F.col("on_path"), F.col("t_leaf")).otherwise(0),
        "saved": F.col("saved") + F.when(F.col("on_path"), F.col("t_save")).otherwise(0),
        "size": F.col("size") - F.when(F.col("on_path") & ~F.col("is_centroid"), F.col("c_size")).otherwise(0),
        "comp": F.coalesce("moved", "comp")})
    rest = cut_lineage(after.filter("NOT is_centroid").select(*STATE), "forest")
    taken = cut_lineage(after.filter("is_centroid").select("node", "leaves", "saved"), "centroids")
    discard(marked)
    return rest, taken


def rolled_up(nodes: DataFrame, along: DataFrame, task_nodes: int = TASK_NODES) -> DataFrame:
    """(node, leaves, saved): sums of `leaf` and `save` over the subtree of each of `nodes`; `along` are the paths."""
    owned = nodes.groupBy("conv_id").agg(F.min("depth").alias("start"))
    lengths = along.groupBy("conv_id").agg(F.max("depth").alias("end"))
    owners = owned.join(lengths, "conv_id")
    members = along.select("conv_id", "depth", "node").join(owners, "conv_id")
    sizes = members.groupBy("node").agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("start", "depth") + 1)).alias("size"))
    top = F.unhex(F.lit("00" * 16))
    zero = F.lit(0).cast("bigint")
    state = cut_lineage(nodes.join(sizes, "node").withColumns({"comp": top, "leaves": zero, "saved": zero}).select(*STATE), "forest")
    done, ready = [], []
    while True:
        whole = state.filter("node = comp").select("comp", (F.col("size") > task_nodes).alias("big"))
        # written, so that dealing the components out is a shuffle of its own and not that of this join, which may be split
        sorted_out = cut_lineage(state.join(whole, "comp").select(*STATE, "big"), "forest")
        discard(state)
        ready.append(sorted_out.filter("NOT big").select(*STATE))
        big = sorted_out.filter("big").select(*STATE)
        if big.isEmpty():
            break
        state, centroids = _round(big, along)
        done.append(centroids)
    everything = ready[0]
    for more in ready[1:]:
        everything = everything.unionByName(more)
    result = _inside_tasks(everything, task_nodes)
    for more in done:
        result = result.unionByName(more)
    return result


def trie(turns: DataFrame, ids: DataFrame, task_nodes: int = TASK_NODES) -> DataFrame:
    """The nodes of all conversations in `ids` (conv_id), whose turns are (conv_id, k, d1, d2, chars): node, parent, conv_id
    (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256.

    The text of a node at depth d is that of turn d of its conv_id.
    """
    along = cut_lineage(paths(turns, ids), "paths")
    grouped = along.groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.first("depth").alias("depth"),
                                        F.first("parent").alias("parent"), F.first("chars").alias("chars"))
    kept = cut_lineage(grouped, "nodes")
    children = kept.filter("depth > 0").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    nodes = cut_lineage(kept.join(children, "node", "left").fillna(0, ["n_children"]).withColumns({
        "leaf": (F.col("n_children") == 0).cast("bigint"), "save": (F.col("n_convs") - 1) * F.col("chars")}), "nodes")
    last = along.groupBy("conv_id").agg(F.max_by("node", "depth").alias("node"))
    above = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return (nodes.join(above, "parent", "left").join(rolled_up(nodes, along, task_nodes), "node").join(ends_digest(last), "node", "left")
            .select("node", "parent", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"),
                    F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256")))


def conversation_trie(conversations: DataFrame, task_nodes: int = TASK_NODES) -> DataFrame:
    """The trie of a table (conv_id, turn, role, text), with each node's last role and text."""
    turns = cut_lineage(numbered(conversations), "numbered")
    nodes = trie(digested(turns), turns.select("conv_id").distinct(), task_nodes)
    said = turns.select("conv_id", F.col("k").alias("depth"), "role", "text")
    return nodes.join(said, ["conv_id", "depth"], "left")
