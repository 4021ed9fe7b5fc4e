"""Value counts of many columns at once, and what follows from them: distinct counts, modes, top values.

Columns are stacked as (column, value) per type family, so one shuffle on (column, value) serves all of them, partial
counts collapse heavy values before the shuffle, and no Expand for several DISTINCTs is planned. Long texts are shuffled
as a 128-bit digest plus length; the full text is fetched only for the few values reported.
"""

from __future__ import annotations

import re
from datetime import date, datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from colsift.functions.values import is_missing, no_nan, ref
from colsift.plans.session import small_frame

LONG_TEXT = 64
DIGEST = re.compile("[0-9a-f]{32}:[0-9]+")
COUNTABLE = (T.StringType, T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType,
             T.DayTimeIntervalType)


def countable(dtype: T.DataType) -> bool:
    return isinstance(dtype, COUNTABLE)


def text_key(c: Column) -> Column:
    """The text itself, or digest and length of a long one."""
    return F.when(F.length(c) <= LONG_TEXT, c).otherwise(F.concat(F.md5(c.cast("binary")), F.lit(":"), F.length(c)))


def _family(dtype: T.DataType) -> str:
    if isinstance(dtype, (T.IntegralType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "bigint"
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return "double"
    return "string"


def _key(name: str, dtype: T.DataType) -> Column:
    c = ref(name)
    if isinstance(dtype, T.DateType):
        return F.unix_date(c).cast("bigint")
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(c)
    if isinstance(dtype, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), c)
    if isinstance(dtype, T.BooleanType):
        return c.cast("int").cast("bigint")
    if isinstance(dtype, T.StringType):
        return text_key(c)
    family = _family(dtype)
    # adding zero turns -0.0 into 0.0
    return no_nan(c.cast("double"), T.DoubleType()) + F.lit(0.0) if family == "double" else c.cast(family)


def value_counts(df: DataFrame, columns: list[str]) -> dict[str, DataFrame]:
    """Per type family a frame (column_name, value, cnt) of the non-missing values."""
    types = {f.name: f.dataType for f in df.schema}
    families: dict[str, list[str]] = {}
    for c in columns:
        if not countable(types[c]):
            raise TypeError(f"values of {c} ({types[c].simpleString()}) cannot be counted")
        families.setdefault(_family(types[c]), []).append(c)
    frames = {}
    for family, members in families.items():
        keyed = df.select(*[_key(c, types[c]).alias(f"c{i}") for i, c in enumerate(members)])
        pairs = ", ".join(f"c{i}, {i}" for i in range(len(members)))
        stacked = keyed.selectExpr(f"stack({len(members)}, {pairs}) as (value, place)")
        names = F.element_at(F.array(*[F.lit(c) for c in members]), F.col("place") + 1)
        frames[family] = (stacked.filter("value is not null").groupBy("place", "value").agg(F.count("*").alias("cnt"))
                          .select(names.alias("column_name"), "value", "cnt"))
    return frames


def cardinality(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, n_unique, top_count, low_count) for the columns that have any value."""
    return reduce(DataFrame.unionAll, [_summary(counts) for counts in value_counts(df, columns).values()])


def _summary(counts: DataFrame) -> DataFrame:
    return counts.groupBy("column_name").agg(F.count("*").alias("n_unique"), F.max("cnt").alias("top_count"),
                                             F.min("cnt").alias("low_count"))


def cardinality_and_top(df: DataFrame, columns: list[str], k: int) -> tuple[list[dict], list[dict]]:
    """The rows of `cardinality`, and (column_name, value_rank, value, cnt) of the k most frequent values.

    Ties go in value order, those of long texts in digest order. Both come from one shuffle: the branches below share
    their exchange. The rank filter becomes a window group limit, so each task passes on k rows per column.
    """
    types = {f.name: f.dataType for f in df.schema}
    parts = []
    for counts in value_counts(df, columns).values():
        order = Window.partitionBy("column_name").orderBy(F.desc("cnt"), F.asc("value"))
        best = counts.withColumn("value_rank", F.row_number().over(order)).filter(F.col("value_rank") <= k)
        parts.append(best.select("column_name", F.col("value_rank").cast("bigint"), F.col("value").cast("string").alias("key"),
                                 "cnt", *[F.lit(None).cast("bigint").alias(c) for c in ("top_count", "low_count")]))
        parts.append(_summary(counts).select("column_name", F.lit(0).cast("bigint"), F.lit(None).cast("string"),
                                             "n_unique", "top_count", "low_count"))
    rows = [r.asDict() for r in reduce(DataFrame.unionAll, parts).collect()]
    totals = [{"column_name": r["column_name"], "n_unique": r["cnt"], "top_count": r["top_count"], "low_count": r["low_count"]}
              for r in rows if r["value_rank"] == 0]
    best = sorted((r for r in rows if r["value_rank"] > 0), key=lambda r: (columns.index(r["column_name"]), r["value_rank"]))
    texts = _full_texts(df, [(r["column_name"], r["key"]) for r in best
                             if isinstance(types[r["column_name"]], T.StringType) and DIGEST.fullmatch(r["key"])])
    return totals, [{"column_name": r["column_name"], "value_rank": r["value_rank"], "cnt": r["cnt"],
                     "value": texts.get((r["column_name"], r["key"])) or _shown(r["key"], types[r["column_name"]])}
                    for r in best]


def _shown(key: str, dtype: T.DataType) -> str:
    """The value of a key as text."""
    if isinstance(dtype, T.DateType):
        return str(date(1970, 1, 1) + timedelta(days=int(key)))
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return str(datetime(1970, 1, 1) + timedelta(microseconds=int(key)))
    if isinstance(dtype, T.BooleanType):
        return "true" if key == "1" else "false"
    return key


def _full_texts(df: DataFrame, wanted: list[tuple]) -> dict[tuple, str]:
    """The texts behind the digests of the few values reported."""
    if not wanted:
        return {}
    columns = sorted({c for c, _ in wanted})
    hits = {c: text_key(ref(c)).isin([k for n, k in wanted if n == c]) for c in columns}
    cells = F.array(*[F.when(hits[c], F.struct(F.lit(c).alias("column_name"), text_key(ref(c)).alias("key"),
                                               ref(c).alias("full"))) for c in columns])
    found = (df.filter(reduce(lambda a, b: a | b, hits.values())).select(F.explode(F.array_compact(cells)).alias("t"))
             .groupBy("t.column_name", "t.key").agg(F.min("t.full").alias("full")))
    return {(r["column_name"], r["key"]): r["full"] for r in found.collect()}


TOP_SCHEMA = "column_name string, value_rank bigint, value string, cnt bigint"


def top_values(df: DataFrame, columns: list[str], k: int) -> DataFrame:
    """(column_name, value_rank, value, cnt): the k most frequent values of each column as text."""
    best = cardinality_and_top(df, columns, k)[1] if columns else []
    return small_frame(df.sparkSession, best, TOP_SCHEMA)


def frequencies_of(df: DataFrame, column: str) -> DataFrame:
    """(value, cnt) of one column in its own type, missing excluded."""
    dtype = df.schema[column].dataType
    return (df.select(ref(column).alias("value")).filter(~is_missing(F.col("value"), dtype))
            .groupBy("value").agg(F.count("*").alias("cnt")))
