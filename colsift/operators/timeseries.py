"""Daily and monthly means of a value over time, trend and range."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from colsift.functions.values import as_double, ref
from colsift.plans.pairs import correlation
from colsift.plans.roles import column_roles


def _points(df: DataFrame, time: str, value: str) -> DataFrame:
    roles = column_roles(df)
    if time not in roles.datetime:
        raise ValueError(f"{time} is not a datetime column")
    if value not in roles.numeric:
        raise ValueError(f"{value} is not a numeric column")
    return df.select(ref(time).alias("t"), as_double(ref(value), roles.types[value]).alias("v")).dropna()


def _series(points: DataFrame, period, step: str) -> DataFrame:
    """Mean per period, the periods without a value included as NULL."""
    means = points.groupBy(period.alias("period")).agg(F.avg("v").alias("mean_value"))
    ends = means.agg(F.min("period").alias("first"), F.max("period").alias("last"))
    grid = ends.select(F.explode(F.sequence("first", "last", F.expr(f"interval {step}"))).alias("period"))
    return grid.join(means, "period", "left")


def daily(df: DataFrame, time: str, value: str) -> DataFrame:
    return _series(_points(df, time, value), F.col("t").cast("date"), "1 day").select(
        F.date_format("period", "yyyy-MM-dd").alias("day"), "mean_value")


def monthly(df: DataFrame, time: str, value: str) -> DataFrame:
    return _series(_points(df, time, value), F.trunc(F.col("t").cast("date"), "MM"), "1 month").select(
        F.date_format("period", "yyyy-MM").alias("month"), "mean_value")


def trend(df: DataFrame, time: str, value: str) -> DataFrame:
    """Least-squares line through the daily means, numbered without gaps: direction, slope and |r|."""
    means = _points(df, time, value).groupBy(F.col("t").cast("date").alias("day")).agg(F.avg("v").alias("y"))
    # one row per calendar day, so a single ordered task is bounded by the span of the data
    numbered = means.select("y", (F.row_number().over(Window.orderBy("day")) - 1).cast("double").alias("x"))
    slope = F.coalesce(F.when(F.count("*") >= 2, F.regr_slope("y", "x")), F.lit(0.0))
    strength = F.coalesce(F.abs(correlation(F.col("x"), F.col("y"))), F.lit(0.0))
    return numbered.agg(slope.alias("s"), strength.alias("r"), F.count("*").alias("n_days")).select(
        F.when(F.col("s") > 0, "increasing").when(F.col("s") < 0, "decreasing").otherwise("stable").alias("direction"),
        F.round("s", 4).alias("slope"), F.round("r", 2).alias("strength"), "n_days")


def time_range(df: DataFrame, time: str, value: str) -> DataFrame:
    return _points(df, time, value).agg(F.min("t").alias("start"), F.max("t").alias("end")).select(
        "start", "end", F.timestamp_diff("DAY", F.col("start"), F.col("end")).alias("duration_days"))
