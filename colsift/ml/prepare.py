"""Features ready for a model: label codes, imputation, a deterministic split and scaling fitted on the train part."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F, types as T

from colsift.functions.values import as_double, is_missing, ref
from colsift.operators.clean import column_mode
from colsift.plans.ordering import dense_codes
from colsift.plans.stats import TableStats

MISSING_LABEL = "nan"
FEATURES = "features"
LABEL = "label"


def label_codes(df: DataFrame, column: str) -> DataFrame:
    """(level, code) of a text column; missing is the label 'nan' of its own."""
    return dense_codes(df.select(F.coalesce(ref(column), F.lit(MISSING_LABEL)).alias(column)), column)


def apply_codes(df: DataFrame, column: str, levels: DataFrame, unseen: int | None = None) -> DataFrame:
    """Replace the labels by their codes; labels without one become `unseen`."""
    table = levels.select(F.col("level").alias("_level"), F.col("code").alias("_code"))
    joined = df.join(table, F.coalesce(ref(column), F.lit(MISSING_LABEL)) == F.col("_level"), "left")
    code = F.col("_code") if unseen is None else F.coalesce("_code", F.lit(unseen))
    return joined.select(*[code.cast("double").alias(c) if c == column else ref(c) for c in df.columns])


def recode(df: DataFrame, column: str, levels: DataFrame, source: str, result: str) -> DataFrame:
    """Replace numeric values by the other side of a level table."""
    table = levels.select(F.col(source).cast("double").alias("_from"), F.col(result).cast("double").alias("_to"))
    joined = df.join(table, ref(column).cast("double") == F.col("_from"), "left")
    return joined.select(*[F.col("_to").alias(c) if c == column else ref(c) for c in df.columns])


def encode(df: DataFrame, columns: list[str]) -> tuple[DataFrame, dict[str, DataFrame]]:
    levels = {}
    for c in columns:
        levels[c] = label_codes(df, c)
        df = apply_codes(df, c, levels[c])
    return df, levels


def impute(df: DataFrame, columns: list[str]) -> DataFrame:
    """Numeric gaps take the median, other gaps the mode."""
    stats = TableStats(df.select(*[ref(c) for c in columns]))
    gaps = [c for c in columns if stats.need("nulls").fact(c, "n_null")]
    numeric = [c for c in gaps if c in stats.roles.numeric]
    if numeric:
        stats = TableStats(df.select(*[ref(c) for c in numeric])).need_quantiles(0.5)
    filled = {}
    for c in gaps:
        if c in numeric:
            filled[c] = F.coalesce(stats.numeric(c), F.lit(stats.fact(c, "q0.5")))
        else:
            dtype = df.schema[c].dataType
            filled[c] = F.when(is_missing(ref(c), dtype), F.lit(column_mode(df, c))).otherwise(ref(c)).cast(dtype)
    return df.select(*[filled.get(c, ref(c)).alias(c) for c in df.columns])


@dataclass
class Prepared:
    """Encoded and imputed features, all double, with the target as `label` where there is one."""

    df: DataFrame
    features: list[str]
    has_label: bool
    problem: str
    levels: dict[str, DataFrame] = field(default_factory=dict)
    target_levels: DataFrame | None = None
    decode: bool = False


def _class_codes(df: DataFrame, target: str) -> DataFrame | None:
    """(level, code) of a numeric class target; None where the classes are 0, 1, .. already."""
    levels = dense_codes(df.select(ref(target).cast("double").alias(target)), target)
    return None if levels.filter("level <> code").isEmpty() else levels


def prepare(df: DataFrame, target: str | None, problem: str, features: list[str] | None = None) -> Prepared:
    if problem not in ("classification", "regression", "clustering"):
        raise ValueError(f"unknown problem type: {problem}")
    has_label = target is not None and target in df.columns
    names = [c for c in (features or df.columns) if c != target]
    texts = [c for c in names if isinstance(df.schema[c].dataType, T.StringType)]
    if has_label:
        df = df.filter(~is_missing(ref(target), df.schema[target].dataType))
    data, levels = encode(df, texts)
    target_levels, decode = None, False
    if has_label and isinstance(df.schema[target].dataType, T.StringType):
        target_levels = dense_codes(data, target)
        data = apply_codes(data, target, target_levels)
    elif has_label and problem == "classification":
        target_levels = _class_codes(data, target)
        if target_levels is not None:
            data = recode(data, target, target_levels, "level", "code")
            decode = True
    data = impute(data, names)
    types = {f.name: f.dataType for f in data.schema}
    moments = [_number(c, types[c]).alias(c) for c in names]
    label = [as_double(ref(target), types[target]).alias(LABEL)] if has_label else []
    return Prepared(data.select(*moments, *label), names, has_label, problem, levels, target_levels, decode)


def _number(name: str, dtype: T.DataType):
    if isinstance(dtype, T.DateType):
        return F.unix_date(ref(name)).cast("double")
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast(dtype), ref(name)) / 1e6
    return as_double(ref(name), dtype)


def split(df: DataFrame, test_size: float = 0.2, seed: int = 42, key: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Train and test by a hash: the same rows on every run, copies on the same side.

    Without `key` the whole row is hashed. With the name of a key column, whole numbers or text, its md5 decides, which other
    engines can repeat.
    """
    if key is None:
        place = F.pmod(F.xxhash64(F.lit(seed), *[ref(c) for c in df.columns]), F.lit(10_000))
    else:
        value = ref(key) if isinstance(df.schema[key].dataType, T.StringType) else ref(key).cast("bigint").cast("string")
        digest = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(value, F.lit(""))))
        place = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % 10_000
    cut = round(test_size * 10_000)
    return df.filter(place >= cut), df.filter(place < cut)


@dataclass(frozen=True)
class Scaler:
    """z-scores with the population deviation of the data it was fitted on; a constant feature becomes 0, a gap stays one."""

    centre: dict[str, float]
    spread: dict[str, float]

    @staticmethod
    def fit(df: DataFrame, columns: list[str]) -> "Scaler":
        stats = TableStats(df.select(*[ref(c) for c in columns])).need("moments")
        return Scaler({c: stats.fact(c, "mean") for c in columns}, {c: stats.fact(c, "std_pop") for c in columns})

    def transform(self, df: DataFrame) -> DataFrame:
        scaled = {c: (ref(c) - F.lit(m)) / F.lit(self.spread[c]) if self.spread[c] else F.lit(0.0) for c, m in self.centre.items()}
        return df.select(*[scaled.get(c, ref(c)).alias(c) for c in df.columns])
