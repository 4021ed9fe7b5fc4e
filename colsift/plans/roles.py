"""Column roles from the schema, in the two conventions the operators need.

Flavor E: numeric is integer, floating and decimal; categorical is text; datetime is date and timestamp; boolean has no
role. Flavor A: boolean counts as numeric and a day-time interval as datetime.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, types as T

from colsift.plans.session import small_frame

DATETIME_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)


@dataclass(frozen=True)
class Roles:
    numeric: list[str]
    categorical: list[str]
    datetime: list[str]
    types: dict[str, T.DataType]

    def role(self, name: str) -> str:
        for label in ("numeric", "categorical", "datetime"):
            if name in getattr(self, label):
                return label
        return "other"


def column_roles(df: DataFrame, flavor: str = "E") -> Roles:
    if flavor not in ("E", "A"):
        raise ValueError(f"unknown flavor: {flavor}")
    numeric, categorical, datetime = [], [], []
    for field in df.schema:
        kind = field.dataType
        if isinstance(kind, T.NumericType) or (flavor == "A" and isinstance(kind, T.BooleanType)):
            numeric.append(field.name)
        elif isinstance(kind, T.StringType):
            categorical.append(field.name)
        elif isinstance(kind, DATETIME_TYPES) or (flavor == "A" and isinstance(kind, T.DayTimeIntervalType)):
            datetime.append(field.name)
    return Roles(numeric, categorical, datetime, {f.name: f.dataType for f in df.schema})


def roles_frame(df: DataFrame, flavor: str = "E") -> DataFrame:
    """One row per column: position, name, type text and role."""
    roles = column_roles(df, flavor)
    rows = [
        {"position": i, "column_name": f.name, "dtype": f.dataType.simpleString(), "role": roles.role(f.name)}
        for i, f in enumerate(df.schema)
    ]
    return small_frame(df.sparkSession, rows, "position bigint, column_name string, dtype string, role string")
