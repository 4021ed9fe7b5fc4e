"""What the text operators share: batches of bounded size, training folds, bounded samples, vocabulary files."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

SLICE_BYTES = 2 << 20
LETTERS = regex.compile(r"\p{L}+")


def free_name(docs: DataFrame, name: str) -> str:
    """`name`, or that behind as many underscores as it takes to differ from all columns."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def fold(id_column: str, parts: int) -> Column:
    """crc32 of the id as text, modulo `parts`; NULL for a null id."""
    return F.crc32(F.col(f"`{id_column}`").cast("string")) % parts


def is_fold(id_column: str, parts: int, number: int) -> Column:
    """Whether the id falls in that fold. A null id always does: such a row is held out and never learned from."""
    return F.coalesce(fold(id_column, parts) == number, F.lit(True))


def narrow(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **more: Column) -> DataFrame:
    """`doc_id` and `text` alone, plus `more`; other columns, whatever their names, are left behind."""
    return docs.select(F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{text_column}`").cast("string").alias("text"),
                       *[c.alias(n) for n, c in more.items()])


def slices(batch: pa.RecordBatch, column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts of a batch with at most `limit` bytes of text each, or one row where a single text is longer."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends, start = np.cumsum(sizes, dtype=np.int64), 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def map_texts(docs: DataFrame, text_column: str, make: Callable, schema: str, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of `docs` (all by default), then those of `schema`, which are computed from the texts in slices.

    `make()` runs once a task and gives a function from a list of texts (None for null) to one sequence per new column.
    """
    added = StructType.fromDDL(schema)
    names = list(docs.columns if keep is None else keep)
    place = docs.columns.index(text_column)
    at = [docs.columns.index(n) for n in names]
    out = StructType([docs.schema[n] for n in names] + added.fields)
    types = [f.type for f in to_arrow_schema(added)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for batch in batches:
            for part in slices(batch, place):
                columns = compute(part.column(place).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(i) for i in at] + [pa.array(c, type=t, from_pandas=False) for c, t in zip(columns, types)],
                    out.names)

    return docs.mapInArrow(run, out)


def explode_texts(docs: DataFrame, make: Callable, schema: str) -> DataFrame:
    """Rows of `schema` from slices of `docs`. `make()` runs once a task and gives (add, finish): add(slice as a dict of
    lists) and finish() yield dicts of column arrays, any number of rows each."""
    out = StructType.fromDDL(schema)
    wanted, place = to_arrow_schema(out), docs.columns.index("text")

    def batch_of(columns: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in wanted], schema=wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        add, finish = make()
        for batch in batches:
            for part in slices(batch, place):
                yield from map(batch_of, add(part.to_pydict()))
        yield from map(batch_of, finish())

    return docs.mapInArrow(run, out)


def bounded_sample(rows: DataFrame, group: str, limit: int, content: str = "text") -> DataFrame:
    """At most `limit` rows of each group, those of the smallest hash of doc_id and `content`: the same on every run.

    The counts by group first thin the rows to about 1.2 times the limit, so that few texts are shuffled; the window then
    sets the bound. The result has at most `limit` x groups rows however large the table is.
    """
    spread = F.xxhash64(F.col("doc_id").cast("string"), content)
    sizes = {r[0]: r[1] for r in rows.groupBy(group).count().collect()}
    share = F.lit(1.0)
    for value, size in sizes.items():
        if size > limit:
            share = F.when(F.col(group) == value, F.lit(min(1.0, (1.2 * limit + 50) / size))).otherwise(share)
    place = (F.shiftrightunsigned(spread, 11).cast("double") / float(1 << 53))
    thin = rows.withColumn("_place", place).filter(F.col("_place") < share)
    rank = F.row_number().over(Window.partitionBy(group).orderBy("_place", "doc_id"))
    return thin.withColumn("_rank", rank).filter(F.col("_rank") <= limit).drop("_place", "_rank")


def vocabulary_path(name: str) -> str:
    """The place of a public vocabulary file; a name with a slash is a path already."""
    if "/" in name:
        return name
    import public_tokenizers
    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def tokenizer(name: str):
    """The library's tokenizer for a .json vocabulary, loaded once a worker."""
    import os
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    return Tokenizer.from_file(vocabulary_path(name))


@lru_cache(maxsize=4)
def pieces_model(name: str):
    """The sentencepiece processor of a .model vocabulary, loaded once a worker."""
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(name))


# A byte-level vocabulary cuts before each space that follows other text, so the parts between spaces can be tokenised
# alone. Only white space on both sides of a space joins two parts.
JOINED = re.compile(r"\s \s|  ")
OTHER_ASCII_SPACES = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f"


def parts_of(text: str) -> list[str] | None:
    """The parts of a text between single spaces, or None if it has to be tokenised whole."""
    if "  " in text:
        return None
    # spaces beside a line break or another white space may join parts; most texts have neither
    if (" \n" in text or "\n " in text or not text.isascii() or any(c in text for c in OTHER_ASCII_SPACES)) and JOINED.search(text):
        return None
    return text.split(" ")
