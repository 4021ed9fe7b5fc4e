"""Shared folder for cut lineages and written intermediates, and small frames made on the driver."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

_local_scratch: dict[str, str] = {}
_watching: list[list[str]] = []  # each collects the paths handed out while it is here


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a fresh temporary one only in local mode with none set."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    if context.applicationId not in _local_scratch:
        _local_scratch[context.applicationId] = tempfile.mkdtemp(prefix="colsift-")
    return _local_scratch[context.applicationId]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder."""
    path = f"{shared_folder(spark)}/colsift/{label}-{uuid.uuid4().hex}"
    for made in _watching:
        made.append(path)
    return path


def cut_lineage(df: DataFrame, label: str = "step") -> DataFrame:
    """Write the table to the shared folder and go on from the files: computed once, and lost executors do no harm."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _written_folders(df: DataFrame) -> set[str]:
    """Folders below ours that the table is read from."""
    ours = f"{shared_folder(df.sparkSession)}/colsift/".split(":")[-1]
    return {f.rsplit("/", 1)[0] for f in df.inputFiles() if ours in f}


def discard(*frames: DataFrame) -> None:
    """Remove tables that `cut_lineage` wrote, once nothing reads them any more."""
    for df in frames:
        for folder in _written_folders(df):
            _remove(df.sparkSession, folder)


def materialized(spark: SparkSession, make: Callable[[], DataFrame], label: str) -> DataFrame:
    """The table that `make` gives, written, and every other intermediate that was written meanwhile removed."""
    made: list[str] = []
    _watching.append(made)
    try:
        result = cut_lineage(make(), label)
    finally:
        _watching.remove(made)
    for path in made:
        if not any(f.endswith(path.split(":")[-1].lstrip("/")) for f in _written_folders(result)):
            _remove(spark, path)
    return result


ROWS_PER_TASK = 50_000


def spread_rows(df: DataFrame, rows: int, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """The `rows` rows of the table over so many tasks that a task holds about `rows_per_task`: for work that keeps much more for
    a row than its bytes in the files, by which Spark deals them out. A table of one such task stays as it is."""
    tasks = -(-rows // rows_per_task)
    return df.repartition(tasks) if tasks > 1 else df


def together(spark: SparkSession, calls: list[Callable[[], object]], at_once: int = 4) -> list:
    """Run independent jobs side by side, so that the tail of one does not leave the executors idle."""
    if len(calls) == 1:
        return [calls[0]()]
    with ThreadPoolExecutor(max_workers=at_once) as pool:
        return [done.result() for done in [pool.submit(inheritable_thread_target(spark)(c)) for c in calls]]


def small_frame(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A local relation from a few statistics rows; Catalyst folds what is computed on it."""
    fields = StructType.fromDDL(schema)
    data = [{f.name: r.get(f.name) for f in fields} for r in rows]
    return spark.createDataFrame(pa.Table.from_pylist(data, schema=to_arrow_schema(fields)), fields)
