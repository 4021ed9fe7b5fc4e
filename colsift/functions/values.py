"""Column expressions for missing values, lenient casts and text normalisation."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

# The texts a CSV reader takes for "missing".
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
]

# A decimal number or infinity with optional white space around it.
NUMBER = r"^\s*[+-]?(?:\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?|(?i:inf|infinity))\s*$"

# White space at either end.
PADDING = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"

# Date layouts tried after Spark's own parser, each with its outline; the first that fits wins. The outline goes first,
# because a failed parse costs an exception per row.
DATE_FORMATS = {
    "yyyy/MM/dd": r"^\d{4}/\d{2}/\d{2}$",
    "MM/dd/yyyy": r"^\d{2}/\d{2}/\d{4}$",
    "dd-MM-yyyy": r"^\d{2}-\d{2}-\d{4}$",
    "dd MMM yyyy": r"^\d{2} [A-Za-z]{3} \d{4}$",
    "MMM d, yyyy": r"^[A-Za-z]{3} \d{1,2}, \d{4}$",
}


def ref(name: str) -> Column:
    """A column by its literal name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def no_nan(c: Column, dtype: T.DataType) -> Column:
    """NaN becomes NULL, so that Spark's aggregates skip it."""
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(c), c)
    return c


def is_missing(c: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def to_number(c: Column) -> Column:
    """Text to double, NULL where it is not a plain decimal number.

    The pattern goes first: it refuses Java forms such as 1d or 0x1p3, and a failed parse costs an exception per row.
    """
    return F.when(c.rlike(NUMBER), c.try_cast("double"))


def as_double(c: Column, dtype: T.DataType) -> Column:
    """The numeric view of a column: double, NaN as NULL, text by `to_number`."""
    if isinstance(dtype, T.StringType):
        return to_number(c)
    if isinstance(dtype, T.BooleanType):
        return c.cast("int").cast("double")
    return no_nan(c, dtype).cast("double")


def lenient_number(c: Column) -> Column:
    """Text to double by keeping digits, dot and minus; for a complex number its real part; else 0."""
    real = F.regexp_extract(c, r"^\s*\(?([+-]?[0-9.]+(?:[eE][+-]?[0-9]+)?)[+-][0-9.]+j\)?\s*$", 1)
    digits = F.regexp_replace(c, r"[^0-9.\-]", "")
    return F.coalesce(to_number(c), to_number(real), to_number(digits), F.lit(0.0))


def to_time(c: Column, dtype: T.DataType) -> Column:
    """Text to timestamp, NULL where no layout fits; dates and timestamps pass, numbers count nanoseconds since 1970."""
    if isinstance(dtype, T.StringType):
        return F.coalesce(F.try_to_timestamp(c), *[F.when(c.rlike(outline), F.try_to_timestamp(c, F.lit(layout)))
                                                   for layout, outline in DATE_FORMATS.items()])
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return c
    if isinstance(dtype, T.NumericType):
        return F.timestamp_micros(F.floor(no_nan(c, dtype) / 1000).cast("bigint"))
    return c.cast("string").try_cast("timestamp")


def strip(c: Column) -> Column:
    """Drop Unicode white space at both ends (`trim` drops U+0020 only)."""
    return F.regexp_replace(c, PADDING, "")


def is_padded(c: Column) -> Column:
    """Whether `strip` would change the text."""
    return c.rlike(PADDING)


def remove_special(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)[^a-zA-Z0-9\s]", "")


TEXT_STEPS = {"lowercase": F.lower, "strip": strip, "remove_special": remove_special}


def standardize(c: Column, operations: list[str]) -> Column:
    """Apply the named steps, always in the order lowercase, strip, remove_special."""
    unknown = sorted(set(operations) - set(TEXT_STEPS))
    if unknown:
        raise ValueError(f"unknown text operations: {unknown}")
    for name, step in TEXT_STEPS.items():
        if name in operations:
            c = step(c)
    return c


def value_class(c: Column) -> Column:
    """What a text value looks like: int, float, bool, timestamp or text."""
    number = to_number(c)
    return (
        F.when(c.isNull(), None)
        .when(number.isNotNull() & c.rlike(r"^\s*[+-]?[0-9]+\s*$"), "int")
        .when(number.isNotNull(), "float")
        .when(F.lower(strip(c)).isin("true", "false"), "bool")
        .when(c.rlike(r"^\s*\d{4}-\d{1,2}-\d{1,2}") & F.try_to_timestamp(c).isNotNull(), "timestamp")
        .otherwise("text")
    )
