"""Row identity without shuffling whole rows: two 64-bit hashes and the pattern of nulls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from colsift.functions.values import no_nan, ref


def fingerprint(df: DataFrame, columns: list[str] | None = None) -> list[Column]:
    """128 hash bits over the values. Spark's hash skips nulls, so their positions are hashed as well."""
    columns = columns or df.columns
    types = {f.name: f.dataType for f in df.schema}
    parts = []
    for c in columns:
        value = ref(c)
        parts.append(F.to_json(value) if isinstance(types[c], (T.MapType, T.VariantType))
                     else no_nan(value, types[c]))
    nulls = F.concat(*[F.when(p.isNull(), "1").otherwise("0") for p in parts])
    return [F.xxhash64(nulls, *parts).alias("_h1"), F.xxhash64(F.lit("second"), *parts, nulls).alias("_h2")]


def duplicate_count(df: DataFrame, columns: list[str] | None = None) -> int:
    """Rows equal to an earlier one in the columns, all by default; missing equals missing."""
    copies = df.select(*fingerprint(df, columns)).groupBy("_h1", "_h2").agg(F.count("*").alias("copies"))
    return copies.agg(F.coalesce(F.sum(F.col("copies") - 1), F.lit(0))).first()[0]
