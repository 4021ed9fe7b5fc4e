"""Export of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame

FORMATS = ["csv", "tsv", "json", "parquet"]


def export(df: DataFrame, path: str, format: str = "csv", mode: str = "errorifexists") -> str:
    """Write a folder of files whose name ends in the format, so that `load` finds its reader; returns the path."""
    if format not in FORMATS:
        raise ValueError(f"unsupported file format: {format}")
    path = path if path.endswith(f".{format}") else f"{path}.{format}"
    writer = df.write.mode(mode)
    if format in ("csv", "tsv"):
        # missing is an empty field and an empty text a quoted one; both read back as missing, as CSV has no NULL
        writer.options(header=True, sep="," if format == "csv" else "\t", quote='"', escape='"',
                       timestampNTZFormat="yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]",
                       ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    elif format == "json":
        writer.option("ignoreNullFields", False).json(path)
    else:
        writer.parquet(path)
    return path
