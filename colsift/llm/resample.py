"""Resampling towards a target distribution by importance weights over hashed n-gram features.

Features are all runs of 1 to 2 words; a feature's bucket is its CRC-32 modulo the number of buckets. The distinct features of
a slice of texts are grouped by their length in bytes into matrices of one row each, and the CRCs of all rows advance together,
column by column; buckets are scattered back to the places of the features. Each text's buckets are written once, two bytes a
feature. Their totals over the corpus and over the target give every bucket a gain, a text weighs the floored mean of its
gains, and the texts with the highest sums of weight and Gumbel noise are drawn, which samples without replacement in
proportion to the weights. The noise is a hash of the id, so a draw is the same on every run.

What passes through the driver are the bucket totals, at most `buckets` numbers a corpus. Ranks come from range partitions
and their row counts; rows with equal score, id and number of features differ in nothing and are spread by a random last key.

Null and empty texts have no features and weigh 0. A null id has no noise: its score and rank are null and it is not counted
among the texts to draw from. Repeated rows are drawn each for itself, with equal scores; ties go to smaller ids, then to
fewer features. Texts beyond the slice size are read piece by piece. An empty table gives no rows, an empty target gives gains
by the corpus alone. Extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from colsift.llm.texts import SLICE_BYTES, map_texts, narrow
from colsift.plans.session import cut_lineage, discard

CRC_POLYNOMIAL = 0xEDB88320
MATRIX_LENGTH = 256  # longer features, of which a slice has few, go one by one
ROW_BITS = 33  # of monotonically_increasing_id, the rest is the partition


@dataclass(frozen=True)
class Settings:
    buckets: int = 10_000
    least_words: int = 20
    percent: int = 25
    scale: int = 1000
    seed: int = 7


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = (table >> np.uint32(1)) ^ np.where(table & np.uint32(1), np.uint32(CRC_POLYNOMIAL), np.uint32(0))
    return table


CRC_TABLE = _crc_table()
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32
IN_WORD = np.zeros(256, bool)
IN_WORD[ord("0"):ord("9") + 1] = IN_WORD[ord("a"):ord("z") + 1] = IN_WORD[128:] = True


def crcs_of_matrix(rows: np.ndarray) -> np.ndarray:
    """CRC-32 of each row of a uint8 matrix."""
    state = np.full(len(rows), 0xFFFFFFFF, np.uint32)
    for column in np.ascontiguousarray(rows.T):
        state = CRC_TABLE[(state ^ column) & np.uint32(255)] ^ (state >> np.uint32(8))
    return ~state


def crcs(features: pa.BinaryArray) -> np.ndarray:
    """CRC-32 of each feature, by matrices of equal length."""
    ends = np.frombuffer(features.buffers()[1], np.int32)[features.offset:features.offset + len(features) + 1].astype(np.int64)
    data = np.frombuffer(features.buffers()[2] or b"", np.uint8)
    sizes, found = np.diff(ends), np.empty(len(features), np.uint32)
    order = np.argsort(sizes, kind="stable")
    lengths, first = np.unique(sizes[order], return_index=True)
    for length, rows in zip(lengths.tolist(), np.split(order, first[1:])):
        if length <= MATRIX_LENGTH:
            found[rows] = crcs_of_matrix(data[ends[rows][:, None] + np.arange(length)])
        else:
            found[rows] = [zlib.crc32(data[ends[r]:ends[r] + length]) for r in rows]
    return found


def _buckets_of_words(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, text: np.ndarray, buckets: int):
    """Buckets of all words of lower-cased bytes, those of all pairs of neighbours in one text, and the texts of the pairs."""
    begin, end = (int(starts[0]), int(stops[-1])) if len(starts) else (0, 0)
    part = data[begin:end]
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(stops - starts, out=offsets[1:])
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(part[IN_WORD[part]])])
    coded = words.dictionary_encode()
    codes, distinct = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    beside = np.flatnonzero(text[1:] == text[:-1])
    size = max(1, len(distinct))
    pairs = pa.array(codes[beside] * size + codes[beside + 1]).dictionary_encode()
    first, second = np.divmod(pairs.dictionary.to_numpy(), size)
    joined = pc.binary_join_element_wise(distinct.take(pa.array(first)), distinct.take(pa.array(second)), b" ")
    scatter = lambda features, place: (crcs(features) % np.uint32(buckets)).astype("<u2")[place]
    return scatter(distinct, codes), scatter(joined, pairs.indices.to_numpy()), text[beside]


def buckets_of_texts(texts: list[str | None], buckets: int) -> tuple[list[int], list[bytes]]:
    """Number of words, and the buckets of all features as unsigned 16-bit numbers, of each text."""
    encoded = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = LOWER[np.frombuffer(b" ".join(encoded), np.uint8)]
    bounds = np.r_[0, np.cumsum([len(t) + 1 for t in encoded])]
    edges = np.flatnonzero(np.diff(IN_WORD[data], prepend=False, append=False))
    starts, stops = edges[::2], edges[1::2]
    text = np.searchsorted(bounds, starts, "right") - 1
    # pieces of bounded size, each with the last word of the piece before in front, so that no pair is lost
    cuts = np.unique(np.searchsorted(starts, np.arange(0, len(data) + SLICE_BYTES, SLICE_BYTES)))
    words, pairs, pair_text = [np.zeros(0, "<u2")], [np.zeros(0, "<u2")], [np.zeros(0, np.int64)]
    for a, b in zip(cuts[:-1], cuts[1:]):
        before = max(a - 1, 0)
        w, p, t = _buckets_of_words(data, starts[before:b], stops[before:b], text[before:b], buckets)
        words.append(w[a - before:])
        pairs.append(p)
        pair_text.append(t)
    words, pairs = np.concatenate(words), np.concatenate(pairs)
    every = np.arange(len(texts) + 1)
    at, pair_at = np.searchsorted(text, every), np.searchsorted(np.concatenate(pair_text), every)
    return np.diff(at).tolist(), [words[at[i]:at[i + 1]].tobytes() + pairs[pair_at[i]:pair_at[i + 1]].tobytes()
                                  for i in range(len(texts))]


def with_buckets(docs: DataFrame, buckets: int, keep: list[str]) -> DataFrame:
    """`keep`, n_words and the features' buckets of each text."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("between 1 and 65536 buckets")
    return map_texts(docs, "text", lambda: lambda texts: buckets_of_texts(texts, buckets), "n_words bigint, buckets binary", keep)


def bucket_totals(featured: DataFrame, buckets: int) -> np.ndarray:
    """How many features of the corpus fall in each bucket: counted in each task, then summed over the tasks."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for value in batch.column(0):
                total += np.bincount(np.frombuffer(value.as_buffer(), "<u2"), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    counted = featured.select("buckets").mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n"))
    result = np.zeros(buckets, np.int64)
    for bucket, n in counted.collect():  # one row a bucket
        result[bucket] = n
    return result


def gains_of(corpus: np.ndarray, target: np.ndarray, scale: int) -> np.ndarray:
    """Floored, scaled log ratio of the smoothed shares of each bucket in the target and in the corpus."""
    s, t = float(corpus.sum() + len(corpus)), float(target.sum() + len(target))
    return np.array([math.floor(scale * math.log((b + 1.0) * s / ((a + 1.0) * t))) for a, b in zip(corpus.tolist(), target.tolist())],
                    np.int64)


def weighed(featured: DataFrame, gains: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight of each text."""
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            features, weights = [], []
            for value in batch.column("buckets"):
                numbers = np.frombuffer(value.as_buffer(), "<u2")
                features.append(len(numbers))
                weights.append(int(gains[numbers].sum()) // max(1, len(numbers)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), pa.array(features, pa.int64()),
                                              pa.array(weights, pa.int64())], ["doc_id", "n_words", "n_features", "weight"])

    kind = featured.schema["doc_id"].dataType.simpleString()
    return featured.select("doc_id", "n_words", "buckets").mapInArrow(
        weigh, f"doc_id {kind}, n_words bigint, n_features bigint, weight bigint")


def ranked(scored: DataFrame) -> DataFrame:
    """`scored` (doc_id, score, n_features and more) with the place of each row by falling score, from 1: range partitions
    in order, a row's place in its own and the rows of those before."""
    keys = [F.desc("score"), F.asc("doc_id"), F.asc("n_features"), F.asc("tie")]
    spread = scored.withColumn("tie", F.rand(5)).repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = cut_lineage(spread.drop("tie").withColumn("place", F.monotonically_increasing_id()), "ranked")
    part = F.shiftrightunsigned("place", ROW_BITS)
    sizes = [tuple(r) for r in placed.groupBy(part.alias("part")).count().orderBy("part").collect()]  # one row a partition
    before, rows = 0, []
    for number, size in sizes:
        rows.append((number, before))
        before += size
    base = placed.sparkSession.createDataFrame(rows, "part bigint, rows_before bigint")
    return placed.withColumn("part", part).join(F.broadcast(base), "part").withColumn(
        "rank", F.col("rows_before") + F.col("place").bitwiseAND((1 << ROW_BITS) - 1) + 1).drop("part", "place", "rows_before")


def resample(docs: DataFrame, target: DataFrame, settings: Settings = Settings(), id_column: str = "doc_id",
             text_column: str = "text", target_id: str = "item_id", target_text: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every row; the rank of rows that are not drawn is null."""
    featured = cut_lineage(with_buckets(narrow(docs, id_column, text_column), settings.buckets, ["doc_id"]), "features")
    wanted = with_buckets(narrow(target, target_id, target_text), settings.buckets, [])
    gains = gains_of(bucket_totals(featured, settings.buckets), bucket_totals(wanted, settings.buckets), settings.scale)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{settings.seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10)
    noise = F.floor(-settings.scale * F.log(-F.log((h.cast("double") + 0.5) / 4294967296.0)))
    scored = cut_lineage(weighed(featured, gains).withColumn("score", F.col("weight") + noise), "weights")
    discard(featured)
    may = (F.col("n_words") >= settings.least_words) & F.col("score").isNotNull()
    drawn = scored.filter(may).count() * settings.percent // 100
    places = ranked(scored.filter(may)).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = scored.filter(~may).withColumn("rank", F.lit(None).cast("bigint"))
    return places.unionByName(rest)


def resampled(docs: DataFrame, target: DataFrame, settings: Settings = Settings(), id_column: str = "doc_id",
              text_column: str = "text", **names: str) -> DataFrame:
    """The drawn rows of `docs` with all their columns. Of rows that share an id all are kept if one is drawn."""
    chosen = resample(docs, target, settings, id_column, text_column, **names).filter("rank IS NOT NULL").select("doc_id").distinct()
    row = docs.select(F.col(f"`{id_column}`").alias("doc_id"), F.struct("*").alias("row"))
    return row.join(chosen, "doc_id", "left_semi").select("row.*")
