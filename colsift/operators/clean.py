"""Cleaning steps. `Cleaner` is an immutable pair of a lazy table and a log; every step returns a new one."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window, functions as F, types as T

from colsift.functions.values import as_double, is_missing, no_nan, ref, standardize, to_time
from colsift.plans import ordering
from colsift.plans.fingerprints import duplicate_count
from colsift.plans.frequencies import frequencies_of
from colsift.plans.quantiles import exact_quantiles
from colsift.plans.session import small_frame

LOG_SCHEMA = ("step bigint, action string, column_name string, method string, rows_before bigint, rows_after bigint, "
              "n_changed bigint, missing_before bigint, missing_after bigint, from_type string, to_type string, "
              "success boolean, message string")

# The target types of a conversion and the Spark type each becomes.
TARGET_TYPES = {"int": "bigint", "float": "double", "string": "string", "datetime": "timestamp", "category": "string"}


def without_nan(df: DataFrame) -> DataFrame:
    """NaN made NULL, so that missing equals missing in every comparison that follows."""
    return df.select(*[no_nan(ref(f.name), f.dataType).alias(f.name) for f in df.schema])


def drop_duplicates(df: DataFrame, subset: list[str] | None = None, order_by: list[str] | None = None) -> DataFrame:
    """Whole-row duplicates, or the first row in the order of `order_by` per combination of `subset`."""
    df = without_nan(df)
    if not subset:
        return df.dropDuplicates()
    if not order_by:
        raise ValueError("order_by is required: a DataFrame has no row order")
    # row_number = 1 is limited before the shuffle, so each task passes on one row per key
    first = F.row_number().over(Window.partitionBy(*[ref(c) for c in subset]).orderBy(*[ref(k) for k in order_by]))
    return df.withColumn("_place", first).filter("_place = 1").drop("_place")


def column_mean(df: DataFrame, column: str):
    return df.agg(F.avg(as_double(ref(column), df.schema[column].dataType))).first()[0]


def column_median(df: DataFrame, column: str):
    x = as_double(ref(column), df.schema[column].dataType)
    n = df.agg(F.count(x)).first()[0]
    return exact_quantiles(df, {column: x}, {column: n}, [0.5])[column][0]


def column_mode(df: DataFrame, column: str):
    """The most frequent value, the smallest of those tied."""
    best = frequencies_of(df, column).orderBy(F.desc("cnt"), F.asc("value")).first()
    return best["value"] if best else None


def fill_missing(df: DataFrame, column: str, method: str, value=None, order_by: list[str] | None = None) -> DataFrame:
    """Fill by mean, median, mode, forward_fill, backward_fill or custom."""
    dtype = df.schema[column].dataType
    gap = is_missing(ref(column), dtype)
    if method in ("forward_fill", "backward_fill"):
        present = df.withColumn(column, F.when(~gap, ref(column)))
        return ordering.fill_along(present, column, order_by or [], backward=method == "backward_fill")
    if method in ("mean", "median"):
        if not isinstance(dtype, T.NumericType):
            raise TypeError(f"{method} needs a numeric column, {column} is {dtype.simpleString()}")
        found = (column_mean if method == "mean" else column_median)(df, column)
        result = "double"
    elif method == "mode":
        found, result = column_mode(df, column), dtype
    elif method == "custom" and value is not None:
        found, result = value, dtype
    else:
        raise ValueError(f"invalid method: {method}")
    filled = F.when(gap, F.lit(found).cast(result)).otherwise(ref(column).cast(result))
    return df.select(*[filled.alias(c) if c == column else ref(c) for c in df.columns])


def iqr_bounds(df: DataFrame, column: str, threshold: float = 1.5) -> tuple[float, float] | None:
    x = as_double(ref(column), df.schema[column].dataType)
    n = df.agg(F.count(x)).first()[0]
    q1, q3 = exact_quantiles(df, {column: x}, {column: n}, [0.25, 0.75])[column]
    return None if q1 is None else (q1 - threshold * (q3 - q1), q3 + threshold * (q3 - q1))


def inlier(df: DataFrame, column: str, method: str = "iqr", threshold: float = 1.5):
    """The condition a row must meet to stay; it is not met where the value is missing."""
    x = as_double(ref(column), df.schema[column].dataType)
    if method == "iqr":
        bounds = iqr_bounds(df, column, threshold)
        return F.lit(False) if bounds is None else F.coalesce(x.between(*bounds), F.lit(False))
    if method == "zscore":
        n, mean, std = df.agg(F.count(x), F.avg(x), F.stddev_pop(x)).first()
        if not n:
            # nothing to score: the table stays as it is
            return F.lit(True)
        return F.coalesce(F.abs(F.try_divide(x - F.lit(mean), F.lit(std))) < threshold, F.lit(False))
    raise ValueError(f"invalid method: {method}")


def drop_outliers(df: DataFrame, column: str, method: str = "iqr", threshold: float = 1.5) -> DataFrame:
    return df.filter(inlier(df, column, method, threshold))


def standardize_text(df: DataFrame, column: str, operations: list[str]) -> DataFrame:
    return df.withColumn(column, standardize(ref(column), operations))


def convert_type(df: DataFrame, column: str, target: str) -> DataFrame:
    """Cast with bad values becoming missing; a fractional number refuses the cast to int."""
    if target not in TARGET_TYPES:
        raise ValueError(f"unknown type: {target}")
    dtype, c = df.schema[column].dataType, ref(column)
    if target == "int":
        if isinstance(dtype, T.IntegralType):
            return df.withColumn(column, c.cast("bigint"))
        x = as_double(c, dtype)
        if df.agg(F.bool_or(x != F.floor(x))).first()[0]:
            raise ValueError(f"{column} holds fractional values")
        # whole numbers in plain digits keep all 64 bits; others, such as 1e3, go through double
        exact = c.try_cast("bigint") if isinstance(dtype, T.StringType) else c.cast("bigint")
        return df.withColumn(column, F.coalesce(F.when(x.isNotNull(), exact), x.cast("bigint")))
    if target == "float":
        return df.withColumn(column, as_double(c, dtype))
    if target == "datetime":
        return df.withColumn(column, to_time(c, dtype).cast("timestamp"))
    return df.withColumn(column, c.cast("string"))


def category_levels(df: DataFrame, column: str) -> DataFrame:
    """(level, code): the distinct values with their place in sorted order."""
    return ordering.dense_codes(df, column)


def encode_category(df: DataFrame, column: str, result: str | None = None) -> DataFrame:
    """The column's level codes beside it; missing has no code."""
    levels = category_levels(df, column).select(F.col("level").alias("_level"), F.col("code").alias(result or f"{column}_code"))
    return df.join(levels, ref(column) == F.col("_level"), "left").drop("_level")


def low_variance_columns(df: DataFrame, threshold: float = 0.01) -> list[str]:
    numeric = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]
    if not numeric:
        return []
    row = df.agg(*[F.var_samp(as_double(ref(c), df.schema[c].dataType)).alias(f"v{i}") for i, c in enumerate(numeric)]).first()
    return [c for i, c in enumerate(numeric) if row[i] is not None and row[i] < threshold]


@dataclass(frozen=True)
class Cleaner:
    df: DataFrame
    log: tuple[dict, ...] = field(default=())

    def _next(self, df: DataFrame, **record) -> "Cleaner":
        return Cleaner(df, self.log + ({"step": len(self.log) + 1, "success": True, **record},))

    def remove_duplicates(self, subset: list[str] | None = None, order_by: list[str] | None = None) -> "Cleaner":
        before = self.df.count()
        kept = drop_duplicates(self.df, subset, order_by)
        after = before - duplicate_count(self.df, subset)
        return self._next(kept, action="remove_duplicates", rows_before=before, rows_after=after,
                          n_changed=before - after, message=f"Removed {before - after} duplicate rows")

    def _gaps(self, column: str) -> int:
        return self.df.agg(F.count_if(is_missing(ref(column), self.df.schema[column].dataType))).first()[0]

    def fill_missing(self, column: str, method: str, value=None, order_by: list[str] | None = None) -> "Cleaner":
        before = self._gaps(column)
        if before == 0:
            return self._next(self.df, action="fill_missing", column_name=column, method=method, n_changed=0,
                              missing_before=0, missing_after=0, message=f"No missing values found in '{column}'")
        filled = fill_missing(self.df, column, method, value, order_by)
        after = self._gaps_left(column, method, before, order_by)
        return self._next(filled, action="fill_missing", column_name=column, method=method, n_changed=before - after,
                          missing_before=before, missing_after=after,
                          message=f"Filled {before - after} missing values of '{column}' by {method}")

    def _gaps_left(self, column: str, method: str, before: int, order_by: list[str] | None) -> int:
        """Gaps a fill cannot reach, without running it: those ahead of the first value, or behind the last."""
        if method == "custom":
            return 0
        present = ~is_missing(ref(column), self.df.schema[column].dataType)
        key = F.when(present, F.struct(*[ref(k) for k in order_by or [column]]))
        edge = self.df.agg((F.max if method == "backward_fill" else F.min)(key)).first()[0]
        if edge is None:
            return before
        if method not in ("forward_fill", "backward_fill"):
            return 0
        side = ordering.bucket_of(self.df, order_by, [tuple(edge)])
        return self.df.filter(~present & (side == (1 if method == "backward_fill" else 0))).count()

    def remove_outliers(self, column: str, method: str = "iqr", threshold: float = 1.5) -> "Cleaner":
        keep = inlier(self.df, column, method, threshold)
        before, after = self.df.agg(F.count("*"), F.count_if(keep)).first()
        return self._next(self.df.filter(keep), action="remove_outliers", column_name=column, method=method,
                          rows_before=before, rows_after=after, n_changed=before - after,
                          message=f"Removed {before - after} rows with outliers in '{column}'")

    def standardize_text(self, column: str, operations: list[str]) -> "Cleaner":
        return self._next(standardize_text(self.df, column, operations), action="standardize_text", column_name=column,
                          method=",".join(operations), message=f"Cleaned the text of '{column}'")

    def convert_type(self, column: str, target: str) -> "Cleaner":
        """A refused conversion leaves the table as it is and is logged as not successful."""
        record = {"action": "convert_type", "column_name": column, "to_type": target,
                  "from_type": self.df.schema[column].dataType.simpleString()}
        try:
            return self._next(convert_type(self.df, column, target), **record,
                              message=f"Converted '{column}' to {target}")
        except ValueError as error:
            return self._next(self.df, **{**record, "success": False}, message=str(error))

    def remove_low_variance(self, threshold: float = 0.01) -> "Cleaner":
        removed = low_variance_columns(self.df, threshold)
        return self._next(self.df.select(*[ref(c) for c in self.df.columns if c not in removed]),
                          action="remove_low_variance", n_changed=len(removed), method=",".join(removed),
                          message=f"Removed {len(removed)} columns with low variance")

    def log_frame(self) -> DataFrame:
        return small_frame(self.df.sparkSession, list(self.log), LOG_SCHEMA)

    def summary(self) -> DataFrame:
        rows = [{"total_operations": len(self.log), "operations": ",".join(r["action"] for r in self.log),
                 "final_rows": self.df.count(), "final_columns": len(self.df.columns)}]
        return small_frame(self.df.sparkSession, rows,
                           "total_operations bigint, operations string, final_rows bigint, final_columns bigint")
