"""Global order without one big task: range buckets of a sort key, bucket totals, and work inside each bucket.

The split points come from a bounded sample of the keys, so they only steer the balance; which bucket a row falls in is a
pure function of its key. Every job can therefore be recomputed after a lost executor and two scans agree.
"""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from colsift.functions.values import ref

ROWS_PER_BUCKET = 1_000_000
MAX_BUCKETS = 32_768
SAMPLE_PER_BUCKET = 8


def split_points(df: DataFrame, keys: list[str], rows: int, rows_per_bucket: int = ROWS_PER_BUCKET) -> list[tuple]:
    """At most MAX_BUCKETS - 1 ascending keys that cut the table into about equal ranges."""
    buckets = min(MAX_BUCKETS, -(-rows // rows_per_bucket))
    if buckets <= 1:
        return []
    wanted = buckets * SAMPLE_PER_BUCKET
    picked = df.select(*[ref(k) for k in keys]).sample(fraction=min(1.0, wanted / rows), seed=7)
    size = picked.count()
    if size == 0:
        return []
    # the sample is bounded by `wanted`, so one task may sort it; its places that begin a new bucket are the cuts
    place = F.row_number().over(Window.orderBy(*[ref(k) for k in keys])) - 1
    bucket = lambda p: F.floor(p * buckets / F.lit(size))
    cuts = picked.withColumn("_place", place).filter(
        (F.col("_place") > 0) & (bucket(F.col("_place")) != bucket(F.col("_place") - 1))).drop("_place").distinct()
    return [tuple(r) for r in cuts.orderBy(*cuts.columns).collect()]


def _as_text(value) -> str | None:
    if value is None or isinstance(value, str):
        return value
    if isinstance(value, datetime):
        return value.isoformat(sep=" ")
    return str(value).lower() if isinstance(value, bool) else str(value)


def bucket_of(df: DataFrame, keys: list[str], points: list[tuple]) -> Column:
    """How many split points are at or below the row's key: binary search over a literal array."""
    if not points:
        return F.lit(0)
    names = [f"k{i}" for i in range(len(keys))]
    types = [df.schema[k].dataType for k in keys]
    if isinstance(types[0], T.ArrayType):
        cuts = F.array(*[F.struct(*[F.lit(v).cast(t).alias(n) for n, v, t in zip(names, p, types)]) for p in points])
    else:
        # one text literal that the optimizer folds to the array, however many points there are
        text = json.dumps([{n: _as_text(v) for n, v in zip(names, p)} for p in points])
        cuts = F.from_json(F.lit(text), "array<struct<" + ",".join(f"{n}:string" for n in names) + ">>").cast(
            "array<struct<" + ",".join(f"{n}:{t.simpleString()}" for n, t in zip(names, types)) + ">>")
    key = F.struct(*[ref(k).cast(t).alias(n) for n, k, t in zip(names, keys, types)])
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(points).bit_length()))])
    return F.aggregate(
        steps, F.lit(0),
        lambda place, step: F.when((place + step <= len(points)) & (F.try_element_at(cuts, place + step) <= key),
                                   place + step).otherwise(place),
    )


def fill_along(df: DataFrame, column: str, order_by: list[str], backward: bool = False,
               rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Missing values take the nearest earlier (or later) one in the order of `order_by`.

    Rows with equal keys come in the order of a hash of the whole row, so a key that most rows share is cut into many
    buckets. Copies of a row get the same value wherever they fall: a random last key spreads them.
    """
    if not order_by:
        raise ValueError("order_by is required: a DataFrame has no row order")
    value = ref(column)
    keyed = df.withColumn("_tie", F.xxhash64(*[ref(c) for c in df.columns if not isinstance(df.schema[c].dataType, T.MapType)]))
    keyed = keyed.withColumn("_copy", F.rand(11))
    keys = [*order_by, "_tie", "_copy"]
    points = split_points(keyed, keys, df.count(), rows_per_bucket)
    marked = keyed.withColumn("_bucket", bucket_of(keyed, keys, points))
    # backward is forward along the descending order: frames that grow are linear, those that shrink start anew at every row
    along = (lambda k: ref(k).desc()) if backward else ref
    inside = Window.partitionBy("_bucket").orderBy(*[along(k) for k in keys])
    filled = F.last(value, ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    result = marked.withColumn("_filled", filled)
    if points:
        edge = F.min_by if backward else F.max_by
        key = F.struct(*[ref(k) for k in keys])
        # one row per bucket, at most MAX_BUCKETS of them: a single window task and a broadcast are bounded
        edges = marked.groupBy("_bucket").agg(edge(value, F.when(value.isNotNull(), key)).alias("_edge"))
        across = Window.orderBy(along("_bucket"))
        carry = F.last("_edge", ignorenulls=True).over(across.rowsBetween(Window.unboundedPreceding, -1))
        carried = edges.select("_bucket", carry.alias("_carry"))
        result = result.join(F.broadcast(carried), "_bucket", "left").withColumn("_filled", F.coalesce("_filled", "_carry"))
    return result.select(*[F.col("_filled").alias(c) if c == column else ref(c) for c in df.columns])


def running_totals(df: DataFrame, key: str, results: dict[str, str], rows: int, rows_per_bucket: int = ROWS_PER_BUCKET,
                   group: str | None = None) -> DataFrame:
    """For each amount column the sum over all smaller keys, under its name in `results`; within each `group`, if one is named.
    The keys must be distinct, in their group; `rows` is how many there are."""
    keys = [key] if group is None else [group, key]
    points = split_points(df, keys, rows, rows_per_bucket)
    marked = df.withColumn("_bucket", bucket_of(df, keys, points))
    groups = [] if group is None else [group]
    before = Window.partitionBy(*groups, "_bucket").orderBy(ref(key)).rowsBetween(Window.unboundedPreceding, -1)
    summed = marked.withColumns({name: F.coalesce(F.sum(amount).over(before), F.lit(0)) for amount, name in results.items()})
    if points:
        totals = marked.groupBy(*groups, "_bucket").agg(*[F.sum(amount).alias(f"_total_{name}") for amount, name in results.items()])
        across = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        base = totals.select(*groups, "_bucket", *[F.coalesce(F.sum(f"_total_{name}").over(across), F.lit(0)).alias(f"_base_{name}")
                                                   for name in results.values()])
        summed = summed.join(F.broadcast(base), [*groups, "_bucket"]).withColumns(
            {name: F.col(name) + F.col(f"_base_{name}") for name in results.values()})
    return summed.select(*[ref(c) for c in df.columns], *results.values())


def running_total(df: DataFrame, key: str, amount: str, rows: int, result: str,
                  rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Sum of `amount` over all smaller keys. The keys must be distinct; `rows` is how many there are."""
    return running_totals(df, key, {amount: result}, rows, rows_per_bucket)


def dense_codes(df: DataFrame, column: str, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """The distinct non-null values of a column with their 0-based place in sorted order."""
    levels = df.select(ref(column).alias("level")).filter(F.col("level").isNotNull()).distinct()
    levels = levels.withColumn("_one", F.lit(1).cast("bigint"))
    coded = running_total(levels, "level", "_one", levels.count(), "code", rows_per_bucket)
    return coded.select("level", F.col("code").cast("bigint").alias("code"))
