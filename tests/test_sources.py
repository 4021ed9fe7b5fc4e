import json
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from colsift.sources import ranges, readers, sinks


def test_csv_types_and_missing_tokens(spark, tmp_path):
    path = tmp_path / "t.CSV"
    path.write_text('i,f,b,s,gap,none,quoted\n1,1.5,True,x,1,,"a, ""b"""\n2,NA,false,NULL,n/a,,"c\n"\n')
    text = tmp_path / "u.csv"
    text.write_text("i,f,b,s,gap,none\n1,1.5,True,x,1,\n2,NA,false,NULL,n/a,\n")
    df = readers.load(spark, str(text))
    assert dict(df.dtypes) == {"i": "bigint", "f": "double", "b": "boolean", "s": "string", "gap": "bigint", "none": "double"}
    assert [tuple(r) for r in df.orderBy("i").collect()] == [(1, 1.5, True, "x", 1, None), (2, None, False, None, None, None)]
    assert readers.load(spark, str(path)).first()["quoted"] == 'a, "b"'


def test_big_integers_stay_exact(spark, tmp_path):
    path = tmp_path / "t.tsv"
    path.write_text("id\tn\n9007199254740993\t99999999999999999999\n1\t2\n")
    df = readers.load(spark, str(path))
    assert dict(df.dtypes) == {"id": "bigint", "n": "double"} and df.agg(F.max("id")).first()[0] == 9007199254740993


@pytest.mark.parametrize("text", ['{"a": 1, "b": "x"}\n{"a": 2, "b": null}\n', '[{"a": 1, "b": "x"},\n {"a": 2, "b": null}]',
                                  '{"a": {"0": 1, "1": 2}, "b": {"0": "x", "1": null}}', '{\n"a": {"0": 1, "1": 2},\n"b": {"0": "x", "1": null}}'])
def test_json_layouts(spark, tmp_path, text):
    path = tmp_path / "t.json"
    path.write_text(text)
    assert sorted((r["a"], r["b"]) for r in readers.load(spark, str(path)).collect()) == [(1, "x"), (2, None)]


def test_lines_of_objects_are_records(spark, tmp_path):
    path = tmp_path / "t.json"
    path.write_text("".join(f'{{"user": {{"id": {i}, "name": "n{i}"}}, "geo": {{"lat": {i}.5}}}}\n' for i in range(5)))
    df = readers.load(spark, str(path))
    assert df.columns == ["user", "geo"] and sorted(r["user"]["id"] for r in df.collect()) == list(range(5))


@pytest.mark.parametrize("text, rows", [('{"a": 1,\n "b": "x"}', 1), ('{"user": {"id": 1}, "geo": {"lat": 2}}', 1),
                                        ('[{"a": {"x": 1}, "b": {"x": 2}}, {"a": {"x": 3}, "b": {"x": 4}}]', 2)])
def test_single_objects_and_arrays_are_records(spark, tmp_path, text, rows):
    path = tmp_path / "t.json"
    path.write_text(text)
    df = readers.load(spark, str(path))
    assert df.count() == rows and set(df.columns) in ({"a", "b"}, {"user", "geo"})


def test_line_breaks_in_quoted_fields(spark, tmp_path):
    df = spark.createDataFrame([(1, 'two\nlines, "quoted"'), (2, "a\r\nb\t\tc"), (3, "plain")], "i bigint, s string")
    for format in ("csv", "tsv"):
        back = readers.load(spark, sinks.export(df, str(tmp_path / "t"), format))
        assert sorted(tuple(r) for r in back.collect()) == sorted(tuple(r) for r in df.collect())


@pytest.fixture(params=[97, 700])
def small_ranges(spark, request):
    """Files read in ranges of a few bytes."""
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(request.param))
    yield request.param
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def odd_csv(seed):
    """Records with line breaks, doubled quotes, quotes in plain fields, text after a closing quote, and empty lines."""
    pick = random.Random(seed)
    fields = ["plain", "", '"a ""b"""', '"two\nlines"', '"\n\n,\n"', '5" pipe', '"x"', '"""\n"', 'ends"', '"né,\n""""\n"', "x y", '"' + "long\n" * 9 + '"']
    return "h1,h 2,\"h\n3\"\n" + "".join(",".join(pick.choice(fields) for _ in range(3)) + "\n" + "\n" * (pick.random() < 0.1) for _ in range(25))


@pytest.mark.parametrize("line_end", ["\n", "\r\n"])
def test_ranges_of_csv_equal_the_whole_file(spark, tmp_path, small_ranges, line_end):
    folder = tmp_path / "t.csv"
    folder.mkdir()
    for seed in (1, 2):
        (folder / f"{seed}.csv").write_bytes(odd_csv(seed).replace("\n", line_end).encode())
    want = spark.read.options(**readers.CSV_OPTIONS).option("multiLine", True).csv(str(folder))
    got = readers.read_csv(spark, str(folder), infer=False)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert ranges.pieces(spark, str(folder), "\n").rdd.getNumPartitions() > 2


def test_csv_that_ends_inside_quotes(spark, tmp_path, small_ranges):
    path = tmp_path / "t.csv"
    path.write_text('a,b\n1,"x\ny"\n2,"open\nto the end\n')
    want = spark.read.options(**readers.CSV_OPTIONS).option("multiLine", True).csv(str(path))
    got = readers.read_csv(spark, str(path), infer=False)
    assert [(r[0], r[1].strip()) for r in sorted(got.collect())] == [(r[0], r[1].strip()) for r in sorted(want.collect())]


@pytest.mark.parametrize("indent", [None, 1])
def test_ranges_of_json_arrays_and_columns(spark, tmp_path, small_ranges, indent):
    pick = random.Random(3)
    texts = ["}{", "[,]", 'q"q', "back\\", '\\"}', "é\n", "", "plain, text", "}\n{"]
    rows = [{"k": i, "s": pick.choice(texts), "n": {"x": [i, 2 * i], "y": [{"z": pick.choice(texts)}]}, "t": pick.choice(texts) if i % 3 else None} for i in range(16)]
    path = tmp_path / "array.json"
    path.write_text(json.dumps(rows, indent=indent, ensure_ascii=False))
    got = readers.load(spark, str(path))
    assert got.columns == ["k", "s", "n", "t"]
    want = spark.read.option("multiLine", True).json(str(path)).select(*got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 16
    path = tmp_path / "columns.json"
    path.write_text(json.dumps({c: {str(r["k"]): r[c] for r in rows} for c in ("k", "s", "t")}, indent=indent, ensure_ascii=False))
    assert readers.json_layout(spark, str(path)) == "columns"
    cells = readers.load(spark, str(path))
    missing = lambda v: None if v in (None, "") else v
    assert sorted(map(str, ((r["k"], r["s"], r["t"]) for r in cells.collect()))) == sorted(str((r["k"], missing(r["s"]), missing(r["t"]))) for r in rows)
    assert ranges.pieces(spark, str(path), ",").rdd.getNumPartitions() > 2 or small_ranges > 64


@pytest.mark.parametrize("text, layout", [("", "lines"), ("[]", "array"), ("{}", "record"), ('{"a": {}}', "columns"), ('{"a": {"0": 1}, "b": 5}', "record"),
                                          ('{"a": {"0": 1}, "b": {"1": 5}}', "record"), ('{"a": 1}\n\n{"a": 2}', "lines"), ('\n {"a": {"0": "}\\n{"}}', "columns")])
def test_layouts(spark, tmp_path, text, layout):
    path = tmp_path / "t.json"
    path.write_text(text)
    assert readers.json_layout(spark, str(path)) == layout


def test_refusals(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\n")
    with pytest.raises(ValueError):
        readers.load(spark, str(tmp_path / "t.csv"))
    with pytest.raises(ValueError):
        readers.load(spark, str(tmp_path / "t.docx"))
    with pytest.raises(ValueError):
        sinks.export(spark.range(1), str(tmp_path / "x"), "docx")
    with pytest.raises(ValueError):
        readers.preview(spark.range(1), [])


@pytest.mark.parametrize("format", sinks.FORMATS)
def test_round_trip(spark, tmp_path, format):
    df = spark.createDataFrame([(1, 0.1, " padded \"quote\", comma"), (2, None, None)], "i bigint, x double, s string")
    back = readers.load(spark, sinks.export(df, str(tmp_path / "t"), format))
    assert sorted(tuple(r) for r in back.collect()) == sorted(tuple(r) for r in df.collect())


def test_descriptor(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("a,b\n1,2\n")
    row = readers.descriptor(spark, str(path)).first()
    assert (row["filename"], row["rows"], row["columns"], row["column_names"]) == ("t.csv", 1, 2, "a,b")
    assert row["size_mb"] == pytest.approx(len(json.dumps("a,b 1,2 ")[1:-1]) / 1024**2, rel=0.01)


def test_records_are_handed_on_by_size_as_well(spark, tmp_path, monkeypatch):
    # long records: a batch by number alone would hold all of them at once
    texts = [f"{i} " + f"line {i}\n" * 40 for i in range(300)]
    (tmp_path / "long.csv").write_text("k,t\n" + "".join(f'{i},"{t}"\n' for i, t in enumerate(texts)))
    sizes, real = [], ranges._rows
    monkeypatch.setattr(ranges, "CHARACTERS_HELD", 5000)
    monkeypatch.setattr(ranges, "PIECES_AT_ONCE", 7)
    lines = pa.record_batch({"file": ["f"] * 12_000, "begin": pa.array([0] * 12_000), "piece": ["x" * 100] * 12_000,
                             "a": pa.array([False] * 12_000), "b": pa.array([True] * 12_000)})
    monkeypatch.setattr(ranges, "_rows", lambda held: sizes.append(sum(len(h[5]) for h in held)) or real(held))
    monkeypatch.setattr(ranges, "cut_lineage", lambda df, label: df)

    class Parts:
        def mapInArrow(self, run, schema):
            return [r for b in run(iter([lines])) for r in b.column("text").to_pylist()]

    assert ranges.cut(Parts(), {("f", 0): 0}, ranges._cut_lines) == ["x" * 100] * 12_000 and max(sizes) <= 5100
    monkeypatch.undo()
    got = readers.read_csv(spark, str(tmp_path / "long.csv"))
    assert {r["k"]: r["t"] for r in got.collect()} == dict(enumerate(texts))


def test_records_of_lines_are_put_right_without_patterns(spark, tmp_path):
    # each pattern over a record cost a pass over its characters, four times a read
    text = "a,b\n1,\"two\nlines\"\n2,\"c\"\r\n3,\"d\r\ne\"\r\n4,f\n"
    (tmp_path / "t.csv").write_bytes(text.encode())
    records = ranges.csv_records(spark, str(tmp_path / "t.csv"), ",")
    assert "regexp" not in records._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r["text"] for r in records.collect()) == ['1,"two\nlines"', '2,"c"', '3,"d\ne"', "4,f"]


def test_lines_without_quotes_need_no_pattern(spark):
    lines = ["", "a,b", 'a,"b', 'a"b,c', '"', '""', '"a""', 'a,"b"', '"a\t,"b']
    for sep in (",", "\t"):
        outside, inside = ranges.opens_quote(F.col("l"), sep)
        assert "contains" in str(outside) and "contains" in str(inside)
        for line, a, b in spark.createDataFrame([(x,) for x in lines], "l string").select("l", outside, inside).collect():
            state = []
            for quoted in (False, True):  # character by character
                at, fresh = 0, not quoted
                while at < len(line):
                    if quoted and line[at:at + 2] == '""':
                        at += 1
                    elif quoted and line[at] == '"':
                        quoted = False
                    elif not quoted:
                        quoted = fresh and line[at] == '"'
                        fresh = line[at] == sep
                    at += 1
                state.append(quoted)
            assert [a, b] == state, (line, sep)


def test_kinds_of_texts(spark):
    texts = {1: ["1", "-3", "+04", " 5 ", "\t6\n", "9223372036854775807"], 2: ["9223372036854775808", "1.", ".5", "-1e5", "inf", "Infinity", " +INF"],
             3: ["True", "false", "TRUE"], 4: ["x", "1d", "0x1", "tRue", "1 2", "", "infinite", "١", "NaN", "-", "e5"], None: [None]}
    rows = [(kind, t) for kind, some in texts.items() for t in some]
    got = spark.createDataFrame(rows, "kind int, t string").select("kind", "t", readers.value_kind(F.col("t")).alias("got")).collect()
    assert [(r["t"], r["got"]) for r in got] == [(r["t"], r["kind"]) for r in got]
