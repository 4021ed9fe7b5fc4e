"""Removal of long passages that occur more than once, by a family of sparse suffix arrays with geometric merges.

A string of `length` = 400 bytes that starts at two places is removed at both. Suffixes are sampled where content decides it:
each window of 400 bytes has one anchor, the place of the smallest hash of 100 bytes in it (the leftmost of equal ones), so
equal windows have their anchor at the same offset. Consecutive windows with one anchor form its span, about 550 bytes. Spans
that occur twice byte for byte settle all their windows by their 128-bit digest. What is left are spans whose 100 bytes at
the anchor occur elsewhere in another span; these are indexed:

* a batch of them gets a suffix array, sorted by group (hash of the 100 bytes) and suffix from the anchor;
* it is merge-scanned with every level of the index: in a group, common prefixes of neighbours join suffixes from the longest
  down; each suffix of the smaller part looks up the nearest left contexts in the larger part, which give the longest match.
  Pairs beyond these are covered by longer ones, so no pairs are formed; a match counts from `length` bytes;
* then it becomes a level, and levels of equal size are merged, so an entry is rewritten once a doubling.

A group of more than `group_rows` spans is not left to one task: windows are dealt by ranges of their offset to the anchor, and
regrouped by the bytes that all windows of a range share; ranges get narrower until they hold one window, which is settled by
counting. So no group is cut and none is unbounded.

Null and empty texts have no bytes. Repeated rows are copies of each other, so their long passages go from all of them. Ties
there are none: every occurrence goes. Long texts are read in overlapping blocks. An empty table gives no rows. Extra columns
are ignored. Rows are known by a 128-bit digest of id and text, so that jobs repeated after a loss agree.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from colsift.llm.texts import explode_texts, narrow, slices
from colsift.plans.session import cut_lineage, discard

BLOCK_BITS = 21  # of a place within a block
NARROWER = 4


@dataclass(frozen=True)
class Settings:
    length: int = 400
    seed_length: int = 100
    group_rows: int = 2000
    batches: int = 4


@lru_cache(maxsize=1)
def _rolling():
    """A random number for each byte, powers of an odd number and of its inverse, modulo 2**64."""
    pick = np.random.default_rng(13)
    numbers = pick.integers(0, 2**64, 256, dtype=np.uint64)
    base = int(pick.integers(0, 2**63)) * 2 + 1
    size = (1 << BLOCK_BITS) + 1
    power = lambda b: np.cumprod(np.r_[np.uint64(1), np.full(size - 1, b, np.uint64)])
    return numbers, power(np.uint64(base)), power(np.uint64(pow(base, -1, 1 << 64)))


def seed_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of the `size` bytes that begin at each place."""
    numbers, power, inverse = _rolling()
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(numbers[data] * power[:len(data)], out=total[1:])
    h = (total[size:] - total[:-size]) * inverse[:len(total) - size]
    for shift, factor in ((32, 0xD6E8FEB86659FD93), (29, 0xA0761D6478BD642F)):
        h ^= h >> np.uint64(shift)
        h *= np.uint64(factor)
    return h ^ (h >> np.uint64(32))


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each `width` neighbours: running minima from both ends of blocks of that width."""
    blocks = -(-len(values) // width)
    table = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    table[:len(values)] = values
    table = table.reshape(blocks, width)
    forward = np.minimum.accumulate(table, axis=1).ravel()
    backward = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(values) - width + 1
    return np.minimum(backward[:n], forward[width - 1:width - 1 + n])


def spans_of(data: np.ndarray, usable: np.ndarray, length: int, seed_length: int):
    """Anchor, first and last window of each span, and the anchor's hash, among the usable windows of at most 2**21 bytes."""
    h = seed_hashes(data, seed_length)
    low = np.uint64((1 << BLOCK_BITS) - 1)
    ranked = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    anchor = (sliding_minimum(ranked, length - seed_length + 1) & low).astype(np.int64)
    windows = np.flatnonzero(usable[:len(anchor)])
    if not len(windows):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    at = anchor[windows]
    begin = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return at[begin], windows[begin], windows[np.r_[begin[1:], len(at)] - 1], h[at[begin]]


SPANS = "seed bigint, span binary, key binary, at int, first int, last int"


def spans(docs: DataFrame, settings: Settings) -> DataFrame:
    """The spans of all texts (key, text): seed (hash of the bytes at the anchor), digest of the span, place."""
    length, step = settings.length, (1 << BLOCK_BITS) - settings.length + 1

    def of_block(data, keys, starts, ends, shift):
        usable = np.zeros(len(data), bool)
        for a, b in zip(starts, ends):
            usable[a:max(a, b - length + 1)] = True
        at, first, last, seed = spans_of(data, usable, length, settings.seed_length)
        own = np.searchsorted(starts, first, "right") - 1
        base = np.asarray(starts)[own] - shift
        view = memoryview(data)
        digests = [xxhash.xxh3_128_digest(view[a:b]) for a, b in zip(first.tolist(), (last + length).tolist())]
        return {"seed": seed.view(np.int64), "span": digests, "key": [keys[i] for i in own.tolist()], "at": (at - base).astype(np.int32),
                "first": (first - base).astype(np.int32), "last": (last - base).astype(np.int32)}

    def make():
        def add(part):
            held, keys, size = [], [], 0

            def flush():
                ends = np.cumsum([len(t) for t in held])
                return of_block(np.frombuffer(b"".join(held), np.uint8), keys, ends - [len(t) for t in held], ends, 0)

            for key, text in zip(part["key"], part["text"]):
                data = (text or "").encode("utf-8", "surrogatepass")
                if len(data) < length:
                    continue
                if len(data) > step:  # blocks that share all bytes but the first of a window
                    whole = np.frombuffer(data, np.uint8)
                    for start in range(0, len(data) - length + 1, step):
                        block = whole[start:start + step + length - 1]
                        yield of_block(block, [key], [0], [len(block)], start)
                    continue
                if size + len(data) > step:
                    yield flush()
                    held, keys, size = [], [], 0
                held.append(data)
                keys.append(key)
                size += len(data)
            if held:
                yield flush()

        return add, lambda: ()

    return explode_texts(docs, make, SPANS)


def settled(members: DataFrame, more: list[str]) -> tuple[DataFrame, DataFrame]:
    """Of members (seed, span, n, key, at, first, last and `more`): those whose span occurs twice, and the different spans of
    seeds with several of them, one member each with `n` occurrences and the number of `spans` of its seed."""
    place = F.struct("key", "at", "first", "last", *more)
    kinds = members.groupBy("seed", "span").agg(F.sum("n").alias("n"), F.min(place).alias("place"))
    seeds = kinds.groupBy("seed").agg(F.count("*").alias("spans"), F.sum("n").alias("total")).filter("total > 1").drop("total")
    kinds = cut_lineage(kinds.join(seeds, "seed"), "spans")
    twice = members.filter("n = 1").join(kinds.filter("n > 1").select("seed", "span"), ["seed", "span"], "left_semi")
    return twice, kinds.filter("spans > 1").select("seed", "n", "spans", "place.*")


def with_bytes(kinds: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """`kinds` with the bytes of their spans, taken from the texts (key, text)."""
    named = F.struct("seed", "n", "spans", "at", "first", "last")
    wanted = kinds.groupBy("key").agg(F.collect_list(named).alias("cuts"))  # at most one a few bytes of its text
    out = StructType.fromDDL("seed bigint, n bigint, spans bigint, key binary, at int, first int, last int, content binary")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                rows = []
                for key, text, cuts in zip(*(c.to_pylist() for c in part.columns)):
                    data = text.encode("utf-8", "surrogatepass")
                    rows += [{**c, "key": key, "content": data[c["first"]:c["last"] + length]} for c in cuts]
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([
                    ("seed", pa.int64()), ("n", pa.int64()), ("spans", pa.int64()), ("key", pa.binary()), ("at", pa.int32()),
                    ("first", pa.int32()), ("last", pa.int32()), ("content", pa.binary())]))

    return docs.select("key", "text").join(wanted, "key").mapInArrow(cut, out)


def narrower(entries: DataFrame, width: int, length: int) -> DataFrame:
    """The windows of each entry dealt by ranges of `width` offsets to the anchor, as members of a new seed: the old one, the
    range and the bytes that all windows of the range share."""
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for e in batch.to_pylist():
                at, first = e["at"], e["first"]
                low, high = at - e["last"], at - first  # offsets of the anchor in the windows
                for r in range(low // width, high // width + 1):
                    a, b = at - min(high, (r + 1) * width - 1), at - max(low, r * width)  # first and last window here
                    core = e["content"][at - r * width - first:at - (r + 1) * width + 1 + length - first]
                    content = e["content"][a - first:b + length - first]
                    seed = xxhash.xxh3_64_intdigest(b"%d %d " % (e["seed"], r) + core) - (1 << 63)
                    rows.append({"seed": seed, "span": xxhash.xxh3_128_digest(content), "n": e["n"], "key": e["key"], "at": at,
                                 "first": a, "last": b, "content": content})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([
                ("seed", pa.int64()), ("span", pa.binary()), ("n", pa.int64()), ("key", pa.binary()), ("at", pa.int32()),
                ("first", pa.int32()), ("last", pa.int32()), ("content", pa.binary())]))

    return entries.mapInArrow(deal, "seed bigint, span binary, n bigint, key binary, at int, first int, last int, content binary")


def common_prefix(a: bytes, b: bytes) -> int:
    size = min(len(a), len(b))
    return size - ((int.from_bytes(a[:size], "big") ^ int.from_bytes(b[:size], "big")).bit_length() + 7) // 8


def longest_matches(left: list[bytes], suffix: list[bytes], length: int) -> list[tuple[int, int] | None]:
    """For each entry how far its matches of at least `length` bytes reach to the left and to the right of the anchor.

    `suffix` is sorted; `left` are the bytes before the anchor, turned around. Parts of the suffix array join at the common
    prefixes of neighbours, longest first; the larger part takes in the smaller one. The nearest left contexts to a newcomer
    give its longest match in the larger part, and for the others there what they do not have already from those nearest.
    """
    n = len(suffix)
    by_left = sorted(range(n), key=left.__getitem__)
    rank = [0] * n
    for r, i in enumerate(by_left):
        rank[i] = r
    shared = [common_prefix(suffix[i], suffix[i + 1]) for i in range(n - 1)]
    part, members, reach = list(range(n)), [[r] for r in rank], [None] * n

    def root(i: int) -> int:
        while part[i] != i:
            part[i] = i = part[part[i]]
        return i

    for i in sorted(range(n - 1), key=shared.__getitem__, reverse=True):
        right, small, large = shared[i], root(i), root(i + 1)
        if len(members[small]) > len(members[large]):
            small, large = large, small
        into, found = members[large], []
        for r in members[small]:
            place = bisect_left(into, r)
            for other in into[max(0, place - 1):place + 1]:
                x, y = by_left[r], by_left[other]
                before = common_prefix(left[x], left[y])
                if before + right >= length:
                    found += [(x, before), (y, before)]
        for x, before in found:
            reach[x] = (before, right) if reach[x] is None else (max(before, reach[x][0]), max(right, reach[x][1]))
        if len(members[small]) * 8 > len(into):
            members[large] = sorted(into + members[small])
        else:
            for r in members[small]:
                insort(into, r)
        members[small], part[small] = [], large
    return reach


class SuffixIndex:
    """Suffix arrays of all entries added so far, in levels of doubling size."""

    def __init__(self, length: int):
        self.length = length
        self.levels: list[tuple[int, DataFrame]] = []

    @staticmethod
    def ordered(entries: DataFrame) -> DataFrame:
        return entries.repartition("seed").sortWithinPartitions("seed", "suffix")

    def add(self, entries: DataFrame) -> list[DataFrame]:
        """Index a batch (seed, n, key, at, first, content). Gives the matches found in it and between it and what was there
        before, as tables (key, start, stop)."""
        suffix = F.substring("content", F.col("at") - F.col("first") + 1, F.octet_length("content"))
        new = cut_lineage(self.ordered(entries.select(
            "seed", "n", "key", "at", F.substring("content", F.lit(1), F.col("at") - F.col("first")).alias("left"), suffix.alias("suffix"))), "suffixes")
        found = [cut_lineage(self.scan(new, level), "matches") for _, level in self.levels] or [cut_lineage(self.scan(new), "matches")]
        self.levels.append((0, new))
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (size, a), (_, b) = self.levels[-2:]
            merged = cut_lineage(self.ordered(a.unionAll(b)), "suffixes")
            discard(a, b)
            self.levels[-2:] = [(size + 1, merged)]
        return found

    def scan(self, new: DataFrame, level: DataFrame | None = None) -> DataFrame:
        length = self.length
        both = new.withColumn("new", F.lit(True))
        if level is not None:
            both = both.unionAll(level.withColumn("new", F.lit(False)))

        def matches(rows: list[tuple]) -> Iterator[tuple]:
            if len(rows) > 1 and any(r[6] for r in rows):
                reach = longest_matches([r[4][::-1] for r in rows], [r[5] for r in rows], length)
                for r, found in zip(rows, reach):
                    if found and r[1] == 1:
                        yield r[2], r[3] - found[0], r[3] + found[1]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            group: list[tuple] = []
            for batch in batches:
                found: list[tuple] = []
                for row in zip(*(c.to_pylist() for c in batch.columns)):
                    if group and group[0][0] != row[0]:
                        found += matches(group)
                        group = []
                    group.append(row)
                yield _places(found)
            yield _places(list(matches(group)))

        return self.ordered(both.select("seed", "n", "key", "at", "left", "suffix", "new")).mapInArrow(run, "key binary, start int, stop int")


def _places(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int32())],
                                      ["key", "start", "stop"])


def repeated_places(docs: DataFrame, settings: Settings) -> DataFrame:
    """Ranges (key, start, stop) of bytes in (key, text) that together cover every string of `length` that occurs twice."""
    if not 0 < settings.seed_length <= settings.length < 1 << (BLOCK_BITS - 1):
        raise ValueError("the seed must fit in the string, and the string in half a block")
    ranges = lambda members: members.select("key", F.col("first").alias("start"), (F.col("last") + settings.length).alias("stop"))
    twice, kinds = settled(cut_lineage(spans(docs, settings), "anchors").withColumn("n", F.lit(1).cast("bigint")), [])
    found, ready = [ranges(twice)], []
    entries, width = cut_lineage(with_bytes(kinds, docs, settings.length), "entries"), settings.length - settings.seed_length + 1
    while True:
        ready.append(entries.filter(F.col("spans") <= settings.group_rows).drop("spans"))
        crowded = entries.filter(F.col("spans") > settings.group_rows)
        if width == 1 or crowded.isEmpty():
            break
        width = -(-width // NARROWER)
        twice, kinds = settled(cut_lineage(narrower(crowded, width, settings.length), "narrower"), ["content"])
        found.append(ranges(twice))
        entries = cut_lineage(kinds, "entries")
    indexed, index = reduce(DataFrame.unionByName, ready), SuffixIndex(settings.length)
    batch = F.pmod(F.xxhash64("key"), F.lit(settings.batches))
    for number in range(settings.batches):
        found += index.add(indexed.filter(batch == number))
    return reduce(DataFrame.unionByName, found)


def keyed(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return narrow(docs, id_column, text_column).select(
        F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(" "), text))).alias("key"),
        "doc_id", text.alias("text"))


def without_repeats(docs: DataFrame, settings: Settings = Settings(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_bytes, spans (removed ranges of bytes, ascending and apart) and kept (the bytes left) of every row. What is
    left may end inside a character."""
    rows = keyed(docs, id_column, text_column)
    places = repeated_places(rows, settings).groupBy("key").agg(F.collect_list(F.struct("start", "stop")).alias("ranges"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                sizes, removed, kept = [], [], []
                for text, ranges in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    data, joined, rest, at = text.encode("utf-8", "surrogatepass"), [], [], 0
                    for a, b in sorted((r["start"], r["stop"]) for r in ranges or []):
                        if joined and a <= joined[-1][1]:
                            joined[-1][1] = max(b, joined[-1][1])
                        else:
                            joined.append([a, b])
                    for a, b in joined:
                        rest.append(data[at:a])
                        at = b
                    rest.append(data[at:])
                    sizes.append(len(data))
                    removed.append([{"start": a, "stop": b} for a, b in joined])
                    kept.append(b"".join(rest))
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array(sizes, pa.int64()),
                    pa.array(removed, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))), pa.array(kept, pa.binary())],
                    ["doc_id", "n_bytes", "spans", "kept"])

    return rows.join(places, "key", "left").select("doc_id", "text", "ranges").mapInArrow(
        remove, f"doc_id {kind}, n_bytes bigint, spans array<struct<start:int, stop:int>>, kept binary")
