"""Work on two tables or two versions: merge, compare, difference, snapshots; and the one-click clean."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from colsift.functions.values import ref
from colsift.operators.clean import column_mode, drop_duplicates, without_nan
from colsift.operators.profile import column_profile
from colsift.plans.fingerprints import fingerprint
from colsift.plans.session import cut_lineage, small_frame
from colsift.plans.stats import TableStats

JOINS = ["inner", "left", "right", "full", "left_semi", "left_anti"]


def auto_clean(df: DataFrame) -> DataFrame:
    """Drop duplicate rows, then fill numeric columns by median and the others by mode."""
    kept = cut_lineage(drop_duplicates(df), "dedup")
    stats = TableStats(kept)
    gaps = [c for c in df.columns if stats.need("nulls").fact(c, "n_null")]
    stats.need_quantiles(0.5)
    filled = {}
    for c in gaps:
        dtype = stats.roles.types[c]
        if c in stats.roles.numeric:
            filled[c] = F.coalesce(stats.numeric(c), F.lit(stats.fact(c, "q0.5")))
        elif isinstance(dtype, T.AtomicType):
            filled[c] = F.coalesce(ref(c), F.lit(column_mode(kept, c)).cast(dtype))
    return kept.select(*[filled.get(c, ref(c)).alias(c) for c in df.columns])


def merge_tables(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    if how not in JOINS:
        raise ValueError(f"unknown join: {how}")
    return left.join(right, on, how)


def compare_tables(left: DataFrame, right: DataFrame) -> DataFrame:
    """Both column profiles side by side; NULL where a table lacks the column."""
    keep = ["data_type", "non_null_count", "null_count", "unique_values"]
    sides = [column_profile(TableStats(t)).select("column_name", *[F.col(c).alias(f"{c}_{s}") for c in keep])
             for t, s in ((left, "left"), (right, "right"))]
    return sides[0].join(sides[1], "column_name", "full")


def diff_versions(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that were added, removed or changed between two versions with the same columns.

    Missing keys are a key, missing values are equal, and a key with several rows is changed if the rows' counts differ. The
    two versions are stacked as row fingerprints that count up and down, so no join is needed and copies collapse early.
    """
    def side(df: DataFrame, sign: int) -> DataFrame:
        df = without_nan(df.select(*[ref(c) for c in old.columns]))
        rest = [c for c in old.columns if c not in keys]
        return df.select(*[ref(k) for k in keys], *(fingerprint(df, rest) if rest else [F.lit(0).alias("_h1"), F.lit(0).alias("_h2")]),
                         F.lit(sign).alias("_n"))

    rows = side(old, -1).unionAll(side(new, 1)).groupBy(*[ref(k) for k in keys], "_h1", "_h2").agg(
        F.sum("_n").alias("_net"), F.bool_or(F.col("_n") < 0).alias("_old"), F.bool_or(F.col("_n") > 0).alias("_new"))
    found = rows.groupBy(*[ref(k) for k in keys]).agg(
        F.bool_or(F.col("_net") != 0).alias("_differs"), F.bool_or("_old").alias("_old"), F.bool_or("_new").alias("_new"))
    change = F.when(~F.col("_old"), "added").when(~F.col("_new"), "removed").when(F.col("_differs"), "changed")
    return found.select(*[ref(k) for k in keys], change.alias("change")).filter("change is not null")


class Snapshots:
    """Versions of a table below one folder; undoing is reading an earlier version."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def save(self, df: DataFrame, version: int, label: str = "") -> None:
        df.write.mode("errorifexists").parquet(f"{self.folder}/v{version}")
        entry = [{"version": version, "label": label, "columns": ",".join(df.columns)}]
        small_frame(self.spark, entry, "version bigint, label string, columns string").coalesce(1).write.mode(
            "append").parquet(f"{self.folder}/manifest")

    def read(self, version: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/v{version}")

    def manifest(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/manifest")
