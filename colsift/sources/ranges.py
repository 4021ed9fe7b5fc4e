"""Reading one large document with many tasks: byte ranges cut at a separator, automata composed over ranges, records stitched.

A text file is read in pieces between separators, which Spark splits at any byte range. Whether a piece begins inside quotes
depends on all pieces before it, so a range is scanned once for both states it may begin in; what the scan gives is a function
from the state before to the state after, and the functions of the ranges of a file, one small row each, are composed in
order. Then every range knows where it begins and cuts its own records; what crosses a range is stitched from its fragments.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from colsift.plans.session import cut_lineage

WHOLE, OPENS, WITHIN, CLOSES = 0, 1, 2, 3
# records are handed on in batches of at most so many, or as soon as they have so many characters
RECORDS_HELD, CHARACTERS_HELD = 10_000, 4_000_000
# pieces taken out of Arrow at a time
PIECES_AT_ONCE = 500
CUT = "file string, begin bigint, number bigint, kind int, first boolean, text string"
CUT_ARROW = pa.schema([("file", pa.string()), ("begin", pa.int64()), ("number", pa.int64()), ("kind", pa.int32()), ("first", pa.bool_()),
                       ("text", pa.string())])


def pieces(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """(file, begin, piece): what stands between separators, in the order of the file within each range; `begin` is the
    range's first byte. Only LF and CRLF are line ends."""
    text = spark.read.option("lineSep", separator).text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("begin"), F.col("value").alias("piece"))


def _by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterator[pa.RecordBatch]]]:
    """The batches of each range in turn; a task may hold several ranges, one after the other."""
    def cuts():
        for batch in batches:
            files, begins = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            changes = [0, *(i for i in range(1, len(files)) if begins[i] != begins[i - 1] or files[i] != files[i - 1]), len(files)]
            for a, b in zip(changes, changes[1:]):
                if b > a:
                    yield (files[a], int(begins[a])), batch.slice(a, b - a)

    for key, group in groupby(cuts(), key=lambda c: c[0]):
        yield key, (part for _, part in group)


def composed(parts: DataFrame, scan: Callable, compose: Callable, start) -> dict[tuple, object]:
    """The state each range begins in. `scan(batches of a range)` gives what the range does to a state, as JSON values;
    `compose(state, that)` the state after it. One row a range comes to the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(*key, json.dumps(scan(group))) for key, group in _by_range(batches)]
        columns = list(zip(*rows)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())],
                                         ["file", "begin", "does"])

    states = {}
    found = sorted(map(tuple, parts.mapInArrow(run, "file string, begin bigint, does string").collect()))
    for _, ranges in groupby(found, key=lambda r: r[0]):
        state = start
        for file, begin, does in ranges:
            states[file, begin] = state
            state = compose(state, json.loads(does))
    return states


def cut(parts: DataFrame, states: dict[tuple, object], cutter: Callable) -> DataFrame:
    """Written records and fragments (CUT). `cutter(state, batches)` yields (kind, text) of a range in order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file, begin), group in _by_range(batches):
            number, held, size = 0, [], 0
            for kind, text in cutter(states[file, begin], group):
                held.append((file, begin, number, kind, begin == 0 and number == 0, text))
                number, size = number + 1, size + len(text)
                if len(held) == RECORDS_HELD or size >= CHARACTERS_HELD:
                    yield _rows(held)
                    held, size = [], 0
            yield _rows(held)

    return cut_lineage(parts.mapInArrow(run, CUT), "records")


def _texts(batch: pa.RecordBatch) -> Iterator[str]:
    """The pieces of a batch, a few at a time: a batch has a number of rows, whatever their length."""
    for i in range(0, len(batch), PIECES_AT_ONCE):
        yield from batch.column("piece").slice(i, PIECES_AT_ONCE).to_pylist()


def _rows(held: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*held)) or [()] * len(CUT_ARROW)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, CUT_ARROW)], schema=CUT_ARROW)


def stitched(written: DataFrame, keep_open: bool) -> DataFrame:
    """(first, text, file, begin, number) of all records: the whole ones, and those made of the fragments of several ranges. One that the file
    ends in is a record only if `keep_open`."""
    order = Window.partitionBy("file").orderBy("begin", "number")
    fragments = written.filter(F.col("kind") != WHOLE)  # at most two a range
    opened = F.sum(F.when(F.col("kind") == OPENS, 1).otherwise(0)).over(order)
    parts = fragments.withColumn("record", opened).groupBy("file", "record").agg(
        F.array_sort(F.collect_list(F.struct("begin", "number", "text"))).alias("parts"), F.bool_or("first").alias("first"),
        F.bool_or(F.col("kind") == CLOSES).alias("closed"))
    if not keep_open:
        parts = parts.filter("closed")
    whole = written.filter(F.col("kind") == WHOLE).select("first", "text", "file", "begin", "number")
    return whole.unionByName(parts.select("first", F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text"), "file",
                                          F.col("parts")[0]["begin"].alias("begin"), F.col("parts")[0]["number"].alias("number")))


def opens_quote(piece: Column, sep: str) -> tuple[Column, Column]:
    """Whether a line ends inside a quoted field, if it begins outside and if it begins inside one.

    A field is quoted if it begins with a quote; two quotes inside are one; what follows a closing quote up to the delimiter, and
    quotes in other fields, are plain text. A line without a quote is settled by that.
    """
    s = re.escape(sep)
    quoted = r'[^"]*+(?:""[^"]*+)*+'
    fields = f'(?:(?:"{quoted}"[^{s}]*+|[^"{s}][^{s}]*+|){s})*+'
    outside = f'^{fields}"{quoted}\\z'
    inside = f'^{quoted}(?:\\z|"[^{s}]*+{s}{fields}"{quoted}\\z)'
    quotes = F.contains(piece, F.lit('"'))
    return quotes & piece.rlike(outside), ~quotes | piece.rlike(inside)


def without_end(text: Column, end: str) -> Column:
    """The text less one `end`, a character, at its end."""
    return F.when(F.endswith(text, F.lit(end)), F.left(text, F.length(text) - 1)).otherwise(text)


def _states(batch: pa.RecordBatch, before: int) -> np.ndarray:
    """The state after each line of a batch (columns a, b), given the one before."""
    a, b = (batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("a", "b"))
    flips, fixed = np.cumsum(a > b), np.flatnonzero(a == b)
    last = np.searchsorted(fixed, np.arange(len(a)), "right") - 1
    base, gone = np.full(len(a), before), np.zeros(len(a), np.int64)
    some = last >= 0
    base[some], gone[some] = a[fixed[last[some]]], flips[fixed[last[some]]]
    return (base + flips - gone) % 2


def _scan_lines(batches: Iterator[pa.RecordBatch]) -> list[int]:
    after = [0, 1]
    for batch in batches:
        after = [int(_states(batch, s)[-1]) for s in after]
    return after


def _cut_lines(state: int, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, str]]:
    held: list[str] = []
    continued = bool(state)
    for batch in batches:
        after = _states(batch, state)
        state = int(after[-1])
        for line, inside in zip(_texts(batch), after.tolist()):
            if inside or held or continued:
                held.append(line)
                if inside:
                    continue
                line, held = "\n".join(held), []
            yield (CLOSES if continued else WHOLE), line
            continued = False
    if held:
        yield (WITHIN if continued else OPENS), "\n".join(held) + "\n"


def csv_records(spark: SparkSession, path: str, sep: str) -> DataFrame | None:
    """(text) of the records after the header of each file, quoted line breaks inside them; None if no line ends inside quotes,
    so that each line is a record."""
    lines = pieces(spark, path, "\n")
    outside, inside = opens_quote(without_end(F.col("piece"), "\r"), sep)
    if lines.filter(outside).isEmpty():
        return None
    marked = lines.withColumns({"a": outside, "b": inside})
    states = composed(marked.select("file", "begin", "a", "b"), _scan_lines, lambda state, after: after[state], 0)
    written = cut(marked.select("file", "begin", "piece", "a", "b"), states, _cut_lines)
    text = without_end(F.col("text"), "\n")
    plain = F.when(F.endswith(text, F.lit("\r")), F.replace(without_end(text, "\r"), F.lit("\r\n"), F.lit("\n"))).otherwise(text)
    return stitched(written, True).filter("NOT first").select(plain.alias("text")).filter(F.trim("text") != "")


# what decides about the structure of JSON: brackets and quotes; escapes are passed over
TOKEN = re.compile(r'\\.|["{}\[\]]', re.DOTALL)
STEP = {"{": 1, "[": 1, "}": -1, "]": -1}


def _scan_json(closing: bool) -> Callable:
    """For a range that begins outside a string and for one that begins inside: whether it ends inside, and by how much the
    depth of brackets changes. `closing`: the separator is a closing bracket itself."""
    def scan(batches: Iterator[pa.RecordBatch]) -> list:
        odd, depth = 0, [0, 0]
        for batch in batches:
            for piece in _texts(batch):
                for token in TOKEN.findall(piece):
                    if token == '"':
                        odd ^= 1
                    elif token in STEP:
                        depth[odd] += STEP[token]
                if closing:
                    depth[odd] -= 1
        # a bracket counts where the quotes before it, those before the range included, are even
        return [[odd, depth[0]], [1 - odd, depth[1]]]

    return scan


def _compose_json(state: list, does: list) -> list:
    inside, change = does[state[0]]
    return [inside, state[1] + change]


def _after(piece: str, inside: int, depth: int) -> tuple[int, int]:
    for token in TOKEN.findall(piece):
        if token == '"':
            inside ^= 1
        elif not inside and token in STEP:
            depth += STEP[token]
    return inside, depth


def _cut_elements(state: list, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, str]]:
    """The objects of an array, from pieces between closing braces."""
    (inside, depth), held = state, []
    continued = bool(inside) or depth > 1
    for batch in batches:
        for piece in _texts(batch):
            inside, depth = _after(piece, inside, depth)
            held.append(piece + "}")
            if not inside:
                depth -= 1
                if depth == 1:
                    text, held = "".join(held), []
                    yield (CLOSES, text) if continued else (WHOLE, text.lstrip(" \t\r\n,["))
                    continued = False
    if held:
        text = "".join(held)
        yield (WITHIN, text) if continued else (OPENS, text.lstrip(" \t\r\n,["))


def array_records(spark: SparkSession, path: str) -> DataFrame:
    """(text) of the objects in the array that each file holds, one line each."""
    parts = pieces(spark, path, "}")
    written = cut(parts, composed(parts, _scan_json(True), _compose_json, [0, 0]), _cut_elements)
    # line breaks are white space here, as strings hold none
    return stitched(written, False).select(F.regexp_replace("text", r"[\r\n]+", " ").alias("text"))


NAME = re.compile(r'\s*("(?:[^"\\]|\\.)*")\s*:\s*', re.DOTALL)


def _cut_cells(state: list, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, str]]:
    """The cells of an object of columns, from pieces between commas; each with the depth it begins at in front."""
    (inside, depth), held = state, []
    continued = bool(inside) or depth > 2
    begun = depth
    for batch in batches:
        for piece in _texts(batch):
            if not held:
                begun = depth
            inside, depth = _after(piece, inside, depth)
            held.append(piece)
            if not inside and depth <= 2:
                text, held = ",".join(held), []
                yield (CLOSES, text) if continued else (WHOLE, f"{begun}{text}")
                continued = False
    if held:
        text = ",".join(held) + ","
        yield (WITHIN, text) if continued else (OPENS, f"{begun}{text}")


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, begin, number, name, row, cell, plain): a cell's text taken apart. `name` is there where a column begins."""
    for batch in batches:
        rows = []
        for text, file, begin, number in zip(*(batch.column(c).to_pylist() for c in ("text", "file", "begin", "number"))):
            depth, text, name, plain = int(text[0]), text[1:].strip(), None, False
            end = _after(text, 0, depth)[1]
            if depth == 0:
                text, depth = text[1:].lstrip(), 1
            if depth == 1 and text not in ("", "}"):
                found = NAME.match(text)
                name, text = json.loads(found[1]), text[found.end():]
                plain = not text.startswith("{")
                text = text[1:]
            for _ in range(2 - end):
                text = text.rstrip()[:-1]
            found = None if plain else NAME.match(text)
            row = cell = None
            if found:
                row, value = json.loads(found[1]), text[found.end():].strip()
                cell = None if value == "null" else json.loads(value) if value.startswith('"') else value
            if found or name is not None:
                rows.append((file, begin, number, name, row, cell, plain))
        columns = list(zip(*rows)) or [()] * 7
        types = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["file", "begin", "number", "name", "row", "cell", "plain"])


def column_cells(spark: SparkSession, path: str) -> DataFrame:
    """(name, row, cell, plain) of the object of columns {"name": {"row": cell}} that each file holds. A column without cells has
    one row of nulls; a value that is no object is marked as plain."""
    parts = pieces(spark, path, ",")
    written = cut(parts, composed(parts, _scan_json(False), _compose_json, [0, 0]), _cut_cells)
    cells = cut_lineage(stitched(written, True).mapInArrow(
        _cells, "file string, begin bigint, number bigint, name string, row string, cell string, plain boolean"), "cells")
    # a cell belongs to the last column begun before it: in its range, or else in an earlier one (one row a range)
    inside = Window.partitionBy("file", "begin").orderBy("number").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    begun = cells.groupBy("file", "begin").agg(F.max_by("name", F.when(F.col("name").isNotNull(), F.col("number"))).alias("last"))
    before = F.last("last", ignorenulls=True).over(Window.partitionBy("file").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1))
    carried = begun.select("file", "begin", before.alias("carried"))
    named = cells.withColumn("own", F.last("name", ignorenulls=True).over(inside)).join(carried, ["file", "begin"])
    return named.select(F.coalesce("own", "carried").alias("name"), "row", "cell", "plain")
