"""SimHash near-duplicate groups by a Gray-order hierarchical index of fingerprints.

Top of the index: four masks of 16 bits. Fingerprints within `reach` = 3 differing bits agree on at least one of them, so each
fingerprint stands under its pattern of each mask, and only fingerprints under the same pattern are compared; a pattern with
many fingerprints is split into chunks, and each pair of chunks is a group of its own. Below, the fingerprints of a group are
sorted by Gray rank, which brings those with common bits together, and grouped eight by eight, level by level. A node holds
the bits on which all its fingerprints agree. Two nodes are compared top down: the differences on the bits that both have
fixed accumulate from level to level, and as soon as they exceed the reach, all pairs below are pruned. Nodes whose members
are linked already are not compared again, so a dense group costs no more than its spanning links.

Links go out as stars (each fingerprint to the smallest one linked to it in its group), and components come from alternating
large and small star rounds on a table in the shared folder. No fingerprint passes through the driver.

Null and empty texts have fingerprint zero, which links like any other. Repeated rows share a fingerprint. A component id is
the smallest non-null doc_id reached. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StructType

from colsift.llm.texts import free_name, map_texts, narrow
from colsift.plans.session import cut_lineage

SEED = 42
REACH = 3
MASKS = 4
MASK_BITS = 16
FAN = 8
# a pattern's fingerprints are split beyond this many, or beyond eight times what an even spread would give, up to the maximum
GROUP_ROWS = 1024
MAX_GROUP_ROWS = 1_000_000
BATCH_ROWS = 100_000
PAIRS_AT_ONCE = 8192


def fingerprinter(width: int):
    """From a list of texts to their fingerprints as signed 64-bit numbers."""
    def run(texts: list[str | None]):
        hashes, sizes = [], []
        for text in texts:
            words = (text or "").encode("utf-8", "surrogatepass").lower().split()
            if not words:
                sizes.append(0)
                continue
            line, ends, at = b" ".join(words), [], -1
            for word in words:
                at += len(word) + 1
                ends.append(at)
            starts = [0, *(e + 1 for e in ends[:len(ends) - width])] if len(words) > width else [0]
            hashes.extend([xxhash.xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts, ends[min(width, len(words)) - 1:])])
            sizes.append(len(starts))
        result = np.zeros(len(texts), np.uint64)
        sizes = np.array(sizes, np.int64)
        some = np.flatnonzero(sizes)
        if len(some):
            table = np.array(hashes, np.uint64)
            first = np.r_[0, np.cumsum(sizes[some])[:-1]]
            for bit in range(64):
                ones = np.add.reduceat(((table >> np.uint64(bit)) & np.uint64(1)).astype(np.int32), first)
                result[some] |= (2 * ones > sizes[some]).astype(np.uint64) << np.uint64(bit)
        return [result.view(np.int64)]

    return run


def with_fingerprints(docs: DataFrame, name: str = "fp", width: int = 3, text_column: str = "text",
                      keep: list[str] | None = None) -> DataFrame:
    """`keep` (all columns by default) and the fingerprint of each text."""
    return map_texts(docs, text_column, lambda: fingerprinter(width), f"`{name}` bigint", keep)


def gray_rank(bits: np.ndarray) -> np.ndarray:
    """The place of each bit pattern in Gray order: the prefix sums of its bits modulo 2."""
    rank = bits.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class Forest:
    """Classes of row numbers; each row's `root` is the smallest row of its class."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        """Join the classes of a[i] and b[i]: larger roots hook to smaller ones, then all paths are halved to the root."""
        while len(a):
            x, y = self.root[a], self.root[b]
            np.minimum.at(self.root, np.maximum(x, y), np.minimum(x, y))
            while True:
                onward = self.root[self.root]
                if np.array_equal(onward, self.root):
                    break
                self.root = onward
            apart = self.root[a] != self.root[b]
            a, b = a[apart], b[apart]


def linked_roots(fps: np.ndarray, group: np.ndarray) -> np.ndarray:
    """For each row the first row linked to it, directly or not, within its group. `group` is nondecreasing."""
    rank = gray_rank(fps)
    order = np.lexsort((rank, group))
    fps, group = fps[order], group[order]
    forest = Forest(len(fps))
    # levels of nodes: first row of each node, the bits all its rows have, and those that none has
    begins = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    levels = [(np.arange(len(fps)), fps, ~fps, begins)]
    while len(levels[-1][0]) > len(begins):
        first, ones, zeros, bucket = levels[-1]
        size = np.diff(np.r_[bucket, len(first)])
        within = np.arange(len(first)) - np.repeat(bucket, size)
        head = np.flatnonzero(within % FAN == 0)
        levels.append((first[head], np.bitwise_and.reduceat(ones, head), np.bitwise_and.reduceat(zeros, head),
                       np.searchsorted(head, bucket)))
        levels[-2] += (head,)

    def settled(level: int) -> np.ndarray:
        """For each node the class that all its rows share, or a number of its own below zero."""
        first = levels[level][0]
        low, high = np.minimum.reduceat(forest.root, first), np.maximum.reduceat(forest.root, first)
        return np.where(low == high, low, -1 - np.arange(len(first)))

    top = len(levels) - 1
    stack = [(top, np.arange(len(begins)), np.arange(len(begins)))]
    step = np.arange(FAN)
    while stack:
        level, x, y = stack.pop()
        if len(x) > PAIRS_AT_ONCE:
            stack.append((level, x[PAIRS_AT_ONCE:], y[PAIRS_AT_ONCE:]))
            x, y = x[:PAIRS_AT_ONCE], y[:PAIRS_AT_ONCE]
        if level == 0:
            forest.link(x, y)
            continue
        same = settled(level)
        open_ = same[x] != same[y] if level < top else np.ones(len(x), bool)
        # a node against itself is settled once all its rows are linked
        itself = x == y
        open_[itself] = same[x[itself]] < 0
        single = np.diff(np.r_[levels[level][0], len(fps)]) == 1
        open_ &= ~(itself & single[x])
        x, y = x[open_], y[open_]
        if not len(x):
            continue
        _, ones, zeros, _, head = levels[level - 1]
        stop = np.r_[head[1:], len(ones)]
        left, right = head[x][:, None, None] + step[:, None], head[y][:, None, None] + step
        left, right = np.broadcast_arrays(left, right)
        there = (left < stop[x][:, None, None]) & (right < stop[y][:, None, None]) & (
            (x != y)[:, None, None] | (left < right) | ((left == right) & (level > 1)))
        left, right = left[there], right[there]
        apart = np.bitwise_count((ones[left] & zeros[right]) | (zeros[left] & ones[right]))
        near = apart <= REACH
        if near.any():
            stack.append((level - 1, left[near], right[near]))
    roots = np.empty(len(fps), np.int64)
    roots[order] = order[forest.root]
    return roots


def _links_of_partition(batches):
    """Star links (u, v) from rows (part, pattern, a, b, fp) sorted by their group."""
    held: list[pa.RecordBatch] = []

    def flush(table: pa.Table):
        keys = [table.column(n).to_numpy() for n in ("part", "pattern", "a", "b")]
        fps = table.column("fp").to_numpy().view(np.uint64)
        changed = np.zeros(len(fps), bool)
        changed[0] = True
        for key in keys:
            changed[1:] |= key[1:] != key[:-1]
        group = np.cumsum(changed)
        many = np.bincount(group)[group] > 1
        fps, group = fps[many], group[many]
        if len(fps):
            roots = linked_roots(fps, group)
            moved = roots != np.arange(len(fps))
            u, v = fps[moved].view(np.int64), fps[roots[moved]].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], ["u", "v"])

    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= BATCH_ROWS:
            table = pa.Table.from_batches(held).combine_chunks()
            keys = [table.column(n).to_numpy() for n in ("part", "pattern", "a", "b")]
            open_ = np.ones(len(keys[0]), bool)
            for key in keys:
                open_ &= key == key[-1]
            cut = int(np.flatnonzero(~open_)[-1]) + 1 if not open_.all() else 0  # the last group may go on
            if cut:
                yield from flush(table.slice(0, cut))
                held = table.slice(cut).to_batches()
                rows -= cut
    if rows:
        yield from flush(pa.Table.from_batches(held).combine_chunks())


def near_links(fps: DataFrame, group_rows: int | None = None) -> DataFrame:
    """Links (u, v), u > v, that connect all distinct fingerprints (fp) within the reach, directly or through others.

    Splitting n fingerprints of a pattern sends each to 2 n / group_rows groups, so the bound grows with the table: only
    patterns that stand out are split.
    """
    if group_rows is None:
        group_rows = max(GROUP_ROWS, min(MAX_GROUP_ROWS, 8 * fps.count() >> MASK_BITS))
    def pattern(part: int) -> Column:
        turned = F.shiftrightunsigned(F.shiftleft("fp", MASK_BITS * part), 64 - MASK_BITS)
        return F.struct(F.lit(part).alias("part"), turned.cast("int").alias("pattern"))

    rows = fps.select("fp", F.explode(F.array(*map(pattern, range(MASKS)))).alias("k")).select("fp", "k.part", "k.pattern")
    sizes = rows.groupBy("part", "pattern").agg(F.count("*").alias("n")).filter(F.col("n") > 1)
    # at least 2 chunks where there is a split, so that every pair of chunks holds whole chunks only
    chunks = F.when(F.col("n") > group_rows, F.ceil(2 * F.col("n") / group_rows)).otherwise(1).cast("int")
    sized = rows.join(sizes.select("part", "pattern", chunks.alias("chunks")), ["part", "pattern"])
    own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    other = F.when(F.col("chunks") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("chunks") - 1))
    pairs = sized.withColumn("own", own).withColumn("other", F.explode(other)).filter(
        (F.col("chunks") == 1) | (F.col("own") != F.col("other"))).select(
        "part", "pattern", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "fp")
    keys = ["part", "pattern", "a", "b"]
    grouped = pairs.repartition(*keys).sortWithinPartitions(*keys)
    return grouped.mapInArrow(_links_of_partition, StructType().add("u", LongType()).add("v", LongType()))


def star_components(links: DataFrame) -> DataFrame:
    """(u, v) with v the smallest node of u's component, for every node of `links` (u > v) that is not it.

    Rounds of large and small stars (Kiveris et al. 2014), each written to the shared folder, until nothing changes.
    """
    now, mark = cut_lineage(links.distinct(), "links"), None
    while True:
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()
        if tuple(state) == mark or state[0] == 0:
            return now
        mark = tuple(state)
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        ends = F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v"))))
        now = cut_lineage(large.join(down, "u").select(ends.alias("e")).select("e.u", "e.v").filter("u <> v").distinct(), "links")


def components_of(fingerprinted: DataFrame) -> DataFrame:
    """(fp, root, component_id): a fingerprint of each component, and the smallest doc_id in it, from (doc_id, fp)."""
    least = cut_lineage(fingerprinted.groupBy("fp").agg(F.min("doc_id").alias("d")), "fingerprints")
    stars = star_components(near_links(least.select("fp"))).select(F.col("u").alias("fp"), F.col("v").alias("root"))
    rooted = least.join(stars, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = rooted.groupBy("root").agg(F.min("d").alias("component_id"))
    return rooted.join(smallest, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row."""
    found = cut_lineage(with_fingerprints(narrow(docs, id_column, text_column), width=width, keep=["doc_id"]), "simhash")
    return found.join(components_of(found), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 3) -> DataFrame:
    """One row of each near-duplicate group, that of the smallest id (nulls last; of repeated rows any); all columns stay."""
    fp, number = free_name(docs, "_llm_fp"), free_name(docs, "_llm_row")
    marked = cut_lineage(with_fingerprints(docs, fp, width, text_column).withColumn(number, F.monotonically_increasing_id()), "simhash")
    rows = marked.select(F.col(f"`{id_column}`").alias("doc_id"), F.col(fp).alias("fp"), F.col(number).alias("_llm_row"))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_llm_row")
    first = rows.join(components_of(rows), "fp").groupBy("root").agg(F.min(order).alias("first")).select(
        F.col("first._llm_row").alias(number))
    return marked.join(first, number, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
