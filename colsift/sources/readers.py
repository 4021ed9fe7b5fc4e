"""Table readers, type inference for text columns, descriptor and preview."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from colsift.functions.values import NA_TOKENS, ref, to_number
from colsift.plans.session import scratch_path, small_frame
from colsift.sources.ranges import array_records, column_cells, csv_records, pieces

CSV_OPTIONS = {"header": True, "inferSchema": False, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False,
               "ignoreTrailingWhiteSpace": False}
COLUMNS_PER_SCAN = 60
# white space of the patterns, signs, digits, the point and infinity
NUMBERS_BEGIN = list(" \t\n\x0b\f\r+-.0123456789iI")


def value_kind(value: Column) -> Column:
    """1 whole number, 2 other number, 3 truth value, 4 other text, NULL for none. What a number cannot begin with is seen at once."""
    whole = value.rlike(r"^\s*[+-]?[0-9]+\s*$") & value.try_cast("bigint").isNotNull()
    return (F.when(value.isNull(), None).when(value.isin("True", "TRUE", "true", "False", "FALSE", "false"), 3)
            .when(~F.substring(value, 1, 1).isin(NUMBERS_BEGIN), 4).when(whole, 1).when(to_number(value).isNotNull(), 2).otherwise(4))


def infer_types(df: DataFrame) -> DataFrame:
    """Text columns with NA tokens as missing, cast to bigint, double or boolean where every value fits.

    Whole numbers stay whole when some are missing; an all-missing column becomes double.
    """
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    clean = df.select(*[F.when(~ref(c).isin(NA_TOKENS), ref(c)).alias(c) if c in texts else ref(c) for c in df.columns])
    target: dict[str, str] = {}
    for start in range(0, len(texts), COLUMNS_PER_SCAN):
        part = texts[start:start + COLUMNS_PER_SCAN]
        kinds = clean.select(*[value_kind(ref(c)).alias(f"k{i}") for i, c in enumerate(part)])
        row = kinds.agg(*[F.struct(F.min(k), F.max(k)) for k in kinds.columns]).first()
        for c, (low, high) in zip(part, row):
            if high is None:
                target[c] = "double"
            elif high <= 2:
                target[c] = "bigint" if high == 1 else "double"
            elif low == high == 3:
                target[c] = "boolean"
    casts = {"bigint": lambda c: ref(c).try_cast("bigint"), "double": lambda c: to_number(ref(c)),
             "boolean": lambda c: ref(c).try_cast("boolean")}
    return clean.select(*[casts[target[c]](c).alias(c) if c in target else ref(c) for c in df.columns])


def read_csv(spark: SparkSession, path: str, sep: str = ",", infer: bool = True) -> DataFrame:
    """A delimited table with a header, read by many tasks whether or not quoted fields hold line breaks.

    Lines end with LF or CRLF. Where quoted fields hold line breaks, the records are cut in ranges and written once.
    """
    records = csv_records(spark, path, sep)
    reader = spark.read.options(**CSV_OPTIONS).option("sep", sep)
    if records is None:
        raw = reader.csv(path)
    else:
        names = reader.option("multiLine", True).csv(path).columns  # only the first record is looked at
        schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
        options = {k: str(v) for k, v in CSV_OPTIONS.items() if k not in ("header", "inferSchema")} | {"sep": sep}
        parsed = records.select(F.from_csv("text", schema.simpleString()[7:-1].replace(":", " "), options).alias("r"))
        raw = parsed.select(*[F.col(f"r.c{i}").alias(n) for i, n in enumerate(names)])
    return infer_types(raw) if infer else raw


def read_tsv(spark: SparkSession, path: str, infer: bool = True) -> DataFrame:
    return read_csv(spark, path, "\t", infer)


def read_json(spark: SparkSession, path: str, layout: str = "auto") -> DataFrame:
    """JSON as lines, as one array of objects, as one object of columns {"col": {"0": value}}, or as one record.

    All but a single record are read by many tasks. A single object is taken for columns if all its values are objects with the
    same row labels, else for one record.
    """
    if layout == "auto":
        layout = json_layout(spark, path)
    if layout == "array":
        lines = scratch_path(spark, "lines")
        array_records(spark, path).write.text(lines)
        return read_json(spark, lines, "lines")
    if layout in ("record", "records"):
        return _in_record_order(spark.read.option("multiLine", True).json(path), _first_keys(spark, path, True))
    if layout == "lines":
        return _in_record_order(spark.read.json(path), _first_keys(spark, path, False))
    if layout != "columns":
        raise ValueError(f"unknown JSON layout: {layout}")
    return _wide(column_cells(spark, path))


def _wide(cells: DataFrame) -> DataFrame:
    cells = cells.filter("row IS NOT NULL")
    names = [r["name"] for r in cells.select("name").distinct().orderBy("name").collect()]
    return infer_types(cells.groupBy("row").pivot("name", names).agg(F.first("cell")).drop("row"))


def _first_keys(spark: SparkSession, path: str, whole: bool) -> list[str]:
    """The field names of the first record, read on an executor; only they come back."""
    text = spark.read.text(path, wholetext=whole).filter("trim(value) <> ''")
    found = text.select(F.json_object_keys("value").alias("keys")).limit(1).collect()
    return (found[0]["keys"] or []) if found else []


def _in_record_order(df: DataFrame, named: list[str]) -> DataFrame:
    """Columns as the first record names them; Spark infers them in alphabetical order."""
    known = [c for c in dict.fromkeys(named) if c in df.columns]
    return df.select(*[ref(c) for c in known + [c for c in df.columns if c not in known]])


def json_layout(spark: SparkSession, path: str) -> str:
    """array, lines, columns or record, from pieces between commas: the first character, whether one object follows another
    without a comma, and whether the first value is an object; then the cells' names and labels decide. Flags come to the driver."""
    parts = pieces(spark, path, ",").filter("trim(BOTH ' \t\r\n' FROM piece) <> ''")
    first = parts.select(F.regexp_extract("piece", r"^\s*(\S)", 1).alias("start"),
                         F.col("piece").rlike(r'^\s*\{\s*"(?:[^"\\]|\\.)*"\s*:\s*\{').alias("nested")).limit(1).collect()
    if not first or first[0]["start"] == "[":
        return "array" if first else "lines"
    if not parts.filter(F.col("piece").rlike(r"\}\s*[\r\n]\s*\{")).isEmpty():
        return "lines"
    if not first[0]["nested"]:
        return "record"
    label = F.xxhash64("row")
    columns = column_cells(spark, path).groupBy("name").agg(F.count("row").alias("n"), F.bit_xor(label).alias("x"), F.bool_or("plain").alias("plain"))
    flags = columns.agg(F.count_distinct("n", F.coalesce("x", F.lit(0))).alias("kinds"), F.bool_or("plain").alias("plain")).first()
    return "columns" if flags["kinds"] == 1 and not flags["plain"] else "record"


READERS = {".csv": read_csv, ".tsv": read_tsv, ".json": read_json,
           ".parquet": lambda spark, path: spark.read.parquet(path)}


def load(spark: SparkSession, path: str) -> DataFrame:
    """Read by the lower-cased extension and refuse an empty table."""
    extension = os.path.splitext(path.rstrip("/"))[1].lower()
    if extension not in READERS:
        raise ValueError(f"unsupported file format: {extension or path}")
    return require_rows(READERS[extension](spark, path))


def require_rows(df: DataFrame) -> DataFrame:
    if not df.columns or df.isEmpty():
        raise ValueError("the table has no data")
    return df


def descriptor(spark: SparkSession, path: str) -> DataFrame:
    """One row: file name, rows, columns, column names, size of the files in MB and time of the call."""
    df = load(spark, path)
    # the files are only listed: no content column is selected
    sizes = spark.read.format("binaryFile").load(path).select(F.col("path").alias("p"), F.col("length").alias("s"))
    row = [{"filename": os.path.basename(path.rstrip("/")), "rows": df.count(), "columns": len(df.columns),
            "column_names": ",".join(df.columns), "size_mb": sizes.agg(F.sum("s")).first()[0] / 1024**2}]
    return small_frame(spark, row, "filename string, rows bigint, columns bigint, column_names string, size_mb double"
                       ).withColumn("uploaded_at", F.current_timestamp())


def preview(df: DataFrame, order_by: list[str], n: int = 5) -> DataFrame:
    if not order_by:
        raise ValueError("order_by is required: a DataFrame has no row order")
    return df.orderBy(*[ref(k) for k in order_by]).limit(n)
