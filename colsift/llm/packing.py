"""Best-fit packing by patterns, fitted to the length histogram with non-negative least squares.

Documents are tokenised, and cut where longer than a sequence; only the histogram of piece lengths (one row per length) goes
to the driver. There, patterns of two and three lengths that fill a sequence are enumerated, their repeat counts are fitted
to the histogram by non-negative least squares (coordinate descent) and rounded, and what is left of the histogram is packed
best-fit, longest first, again as patterns with repeat counts. The plan is a list of runs: "the pieces number f to f + n - 1
of length l stand at offset o of the sequences s to s + n - 1". Pieces are numbered within their length on the executors;
lengths that many pieces share are numbered in salted cells, so no length is one task's work.

Null texts are empty, and empty texts are the end token alone. Every row is packed, repeated rows and ids included. An empty
table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from colsift.llm.texts import explode_texts, narrow, tokenizer, vocabulary_path
from colsift.llm.token_counts import byte_symbols
from colsift.plans.session import cut_lineage

LONG_TEXT = 200_000
SWEEPS = 4

Pattern = tuple[int, ...]


class Ids:
    """Token ids as the tokenizers library gives them for a byte-level vocabulary file.

    The file's vocabulary is handed to tiktoken, which merges the same pairs four times as fast; the tests hold both against
    each other. Texts beyond `LONG_TEXT` characters go to the tokenizers library itself, whose regular expressions need no
    stack there.
    """

    def __init__(self, name: str):
        import public_tokenizers
        import tiktoken
        with open(vocabulary_path(name), encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        byte_of = byte_symbols()
        ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.library = tokenizer(name)
        self.fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def __call__(self, text: str | None) -> bytes:
        """Little-endian 32-bit ids."""
        if text and len(text) > LONG_TEXT:
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return self.fast.encode_to_numpy(text or "", allowed_special="all").astype("<u4", copy=False).tobytes()


@lru_cache(maxsize=2)
def ids_of_worker(name: str) -> Ids:
    """Kept for all tasks of a worker process."""
    return Ids(name)


PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def pieces(docs: DataFrame, vocabulary: str, limit: int, end_id: int) -> DataFrame:
    """The pieces of (doc_id, text): the text's ids and the end id; longer documents are cut so that all pieces but the
    first have `limit` ids."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    def make():
        ids_of = ids_of_worker(vocabulary)

        def add(rows):
            out = defaultdict(list)
            for doc_id, text in zip(rows["doc_id"], rows["text"]):
                ids = ids_of(text) + end
                n = len(ids) // 4
                stop, piece = (n - 1) % limit + 1, 0
                start = 0
                while start < n:
                    for name, value in zip(("doc_id", "piece", "start", "length", "ids_crc32"),
                                           (doc_id, piece, start, stop - start, zlib.crc32(ids[4 * start:4 * stop]))):
                        out[name].append(value)
                    start, stop, piece = stop, stop + limit, piece + 1
            if out:
                yield out

        return add, lambda: iter(())

    return explode_texts(docs, make, PIECES.replace("bigint", id_type, 1))


def fitted_patterns(counts: np.ndarray) -> list[tuple[Pattern, float]]:
    """Patterns of two or three lengths that fill a sequence, with the repeat counts that fit the histogram best.

    counts[l] is the number of pieces of length l; the last length is the sequence's. Coordinate descent on
    |sum of patterns - counts|^2 with counts >= 0: pairs first, then triples, then the pairs and triples in use again.
    """
    limit = len(counts) - 1
    there = [l for l in range(1, limit) if counts[l] > 0]
    present = set(there)
    pairs = [(limit - l, l) for l in there if 2 * l <= limit and limit - l in present]
    triples = [(limit - a - b, b, a) for i, a in enumerate(there) if 3 * a <= limit for b in there[i:]
               if a + 2 * b <= limit and limit - a - b in present]
    rest = counts.astype(float).tolist()
    fit: dict[Pattern, float] = defaultdict(float)

    def sweep(patterns):
        for p in patterns:
            weight = {l: p.count(l) for l in p} if len(set(p)) < len(p) else None
            if weight is None:
                step = sum([rest[l] for l in p]) / len(p)
            else:
                step = sum(m * rest[l] for l, m in weight.items()) / sum(m * m for m in weight.values())
            now = fit.get(p, 0.0)
            if now + step <= 0:
                step = -now
            if step:
                fit[p] = now + step
                for l in p:
                    rest[l] -= step

    for _ in range(SWEEPS):
        sweep(pairs)
    sweep(triples)
    for _ in range(SWEEPS):
        sweep([p for p, x in fit.items() if x >= 0.5])
    return sorted(((p, x) for p, x in fit.items() if x >= 0.5), key=lambda x: (-x[1], x[0]))


def best_fit(counts: np.ndarray) -> list[tuple[Pattern, int]]:
    """Best fit, longest first, on a histogram: pieces of one length go together into alike sequences, those with the least
    room first. The work follows the number of lengths and patterns, not the number of pieces."""
    limit = len(counts) - 1
    open_at: dict[int, list[list]] = defaultdict(list)  # room left -> [pattern, how many]
    room = np.zeros(limit + 1, bool)
    for length in range(limit, 0, -1):
        left = int(counts[length])
        while left:
            fits = np.flatnonzero(room[length:])
            if not len(fits):
                each = limit // length
                full, odd = divmod(left, each)
                for k, n in ((each, full), (odd, 1 if odd else 0)):
                    if n:
                        open_at[limit - k * length].append([(length,) * k, n])
                        room[limit - k * length] = True
                break
            space = length + int(fits[0])
            group = open_at[space][-1]
            n = min(left, group[1])
            group[1] -= n
            if not group[1]:
                open_at[space].pop()
                room[space] = bool(open_at[space])
            open_at[space - length].append([group[0] + (length,), n])
            room[space - length] = True
            left -= n
    return [(pattern, n) for groups in open_at.values() for pattern, n in groups]


def plan(counts: np.ndarray) -> list[tuple[Pattern, int]]:
    """Patterns with whole repeat counts that use up the histogram."""
    left = counts.astype(np.int64).copy()
    chosen: list[tuple[Pattern, int]] = []
    for pattern, wanted in fitted_patterns(counts):
        n = min([round(wanted), *(int(left[l]) // pattern.count(l) for l in pattern)])
        if n > 0:
            chosen.append((pattern, n))
            for l in pattern:
                left[l] -= n
    return chosen + best_fit(left)


def runs(patterns: list[tuple[Pattern, int]]) -> dict[str, np.ndarray]:
    """length, first, sequence and offset of each run, sorted by length and first piece."""
    used: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for pattern, n in patterns:
        offset = 0
        for length in pattern:
            rows.append((length, used[length], sequence, offset))
            used[length] += n
            offset += length
        sequence += n
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return dict(zip(("length", "first", "sequence", "offset"), table.T))


def number_within_length(cut: DataFrame, sizes: dict[int, int], cell: int) -> DataFrame:
    """`cut` with `number`, counted from 0 within each length. A length of n pieces is dealt to n / cell salted cells, which
    are counted first; the number is the cell's start and the place in the cell."""
    spark = cut.sparkSession
    cells = F.broadcast(spark.createDataFrame([(l, max(1, -(-n // cell))) for l, n in sizes.items()],
                                              "length bigint, cells bigint"))
    salted = cut.join(cells, "length").withColumn(
        "salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.rand(7)), "cells")).drop("cells")
    salted = cut_lineage(salted, "salted")  # the salt is fixed before it is counted
    start = F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    starts = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).select(
        "length", "salt", F.coalesce(start, F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32"))
    numbered = salted.withColumn("_place", place)
    return numbered.join(starts, ["length", "salt"]).withColumn("number", F.col("_start") + F.col("_place") - 1).drop(
        "_start", "_place", "salt")


def pack(docs: DataFrame, limit: int = 2048, vocabulary: str = "byte_bpe_50k.json", end_id: int = 0, id_column: str = "doc_id",
         text_column: str = "text", cell: int = 1000) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece; sequences hold at most `limit` ids."""
    spark = docs.sparkSession
    cut = cut_lineage(pieces(narrow(docs, id_column, text_column), vocabulary, limit, end_id), "pieces")
    sizes = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}  # at most `limit` rows
    counts = np.zeros(limit + 1, np.int64)
    for length, n in sizes.items():
        counts[length] = n
    table = spark.sparkContext.broadcast(runs(plan(counts)))
    numbered = number_within_length(cut, sizes, cell)
    import pyarrow as pa
    from pyspark.sql.types import LongType, StructType

    out = StructType([*(f for f in numbered.schema if f.name != "number")]).add("sequence_id", LongType()).add("offset", LongType())
    names = out.names[:-2]

    def place(batches):
        run = table.value
        shift = 1 << 40
        keys = run["length"] * shift + run["first"]
        for batch in batches:
            length, number = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("length", "number"))
            at = np.searchsorted(keys, length * shift + number, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), pa.array(run["sequence"][at] + number - run["first"][at]),
                 pa.array(run["offset"][at])], out.names)

    return numbered.mapInArrow(place, out)
