import random
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from colsift.operators import correlate
from colsift.plans import frequencies, ordering, quantiles, rankings
from colsift.plans.fingerprints import duplicate_count
from colsift.plans.session import scratch_path, shared_folder
from colsift.plans.stats import TableStats

PROBS = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]


def samples():
    draw = random.Random(3)
    n = 4000
    return {
        "uniform": [draw.random() * 1000 for _ in range(n)],
        "hot_value": [5.0 if i % 3 == 0 else draw.gauss(5, 2) for i in range(n)],
        "few_values": [float(draw.randrange(4)) for _ in range(n)],
        "magnitudes": [draw.choice([-1, 1]) * 10.0 ** draw.uniform(-200, 200) for _ in range(n)],
        "far_outlier": [draw.random() if i else 1e18 for i in range(n)],
        "constant": [2.5] * n,
    }


@pytest.mark.parametrize("fetch_limit", [0, 16, 100_000])
def test_selected_quantiles_are_exact(spark, fetch_limit):
    data = pd.DataFrame(samples())
    df = spark.createDataFrame(data).repartition(4)
    columns = {c: F.col(c) for c in data}
    got = quantiles.exact_quantiles(df, columns, dict.fromkeys(data, len(data)), PROBS, small_count=10, fetch_limit=fetch_limit)
    for c in data:
        assert got[c] == pytest.approx(list(np.quantile(data[c], PROBS)), rel=1e-12)


@pytest.mark.parametrize("ends", [["inf"], ["-inf"], ["inf", "-inf", "-inf"]])
def test_quantiles_with_infinities_agree_on_both_sides_of_the_limit(spark, ends):
    draw = random.Random(7)
    data = [draw.gauss(0, 1) for _ in range(3000)] + [float(e) for e in ends] * 40
    df = spark.createDataFrame([(x,) for x in data], "x double").repartition(4)
    found = [quantiles.exact_quantiles(df, {"x": F.col("x")}, {"x": len(data)}, PROBS, small, fetch)["x"]
             for small, fetch in ((10**6, 16), (10, 16), (10, 100_000))]
    # NaN, between the two infinities, is equal to itself here
    assert [list(map(str, f)) for f in found] == [list(map(str, found[0]))] * 3


def test_selection_interpolates_like_percentile(spark):
    draw = random.Random(8)
    df = spark.createDataFrame([(draw.random() * 1e3,) for _ in range(2347)], "x double")
    probs = [i / 97 for i in range(98)]
    assert (quantiles.exact_quantiles(df, {"x": F.col("x")}, {"x": 2347}, probs)
            == quantiles.exact_quantiles(df, {"x": F.col("x")}, {"x": 2347}, probs, small_count=10))


def test_small_and_empty_quantiles(spark, edge):
    stats = TableStats(edge["ages"]).need_quantiles(0.5)
    assert (stats.fact("age", "q0.25"), stats.fact("age", "q0.5"), stats.fact("age", "q0.75")) == (28, 30, 35)
    assert TableStats(edge["all_null"]).need_quantiles(0.5).fact("a", "q0.5") is None
    assert TableStats(edge["empty"]).need_quantiles(0.5).fact("a", "q0.5") is None


@pytest.mark.parametrize("backward", [False, True])
@pytest.mark.parametrize("per_bucket", [7, 50, 10_000])
def test_fill_along_matches_pandas(spark, backward, per_bucket):
    draw = random.Random(5)
    data = pd.DataFrame({"k": range(600), "t": [f"n{i % 5}" for i in range(600)],
                         "v": [None if draw.random() < 0.7 or i < 30 or i > 560 else float(i) for i in range(600)]})
    df = spark.createDataFrame([(int(r.k), r.t, None if pd.isna(r.v) else float(r.v)) for r in data.itertuples()],
                               "k int, t string, v double").repartition(5)
    got = ordering.fill_along(df, "v", ["t", "k"], backward, rows_per_bucket=per_bucket).toPandas().set_index("k").sort_index()
    want = data.sort_values(["t", "k"])
    want["v"] = (want["v"].bfill() if backward else want["v"].ffill()).astype(float)
    assert np.array_equal(got["v"].to_numpy(), want.set_index("k").sort_index()["v"].to_numpy(), equal_nan=True)


@pytest.mark.parametrize("backward", [False, True])
def test_fill_along_a_key_that_most_rows_share(spark, backward, monkeypatch):
    # 90 % of the rows have one key; values are a function of the key, so the order of ties does not show
    keys = [i if i % 10 == 0 else 500 for i in range(3000)]
    df = spark.createDataFrame([(i % 40, k, float(k) if k % 20 == 0 else None) for i, k in enumerate(keys)], "i int, k int, v double").repartition(6)
    got = ordering.fill_along(df, "v", ["k"], backward, rows_per_bucket=100)
    want = lambda k: float(-(-k // 20) * 20 if backward else k // 20 * 20)
    assert all(r["v"] == want(r["k"]) or (backward and r["k"] > 2980 and r["v"] is None) for r in got.collect())
    sizes = buckets_of_fill(spark, df, monkeypatch)
    assert max(sizes) < 3 * sorted(sizes)[len(sizes) // 2]


def buckets_of_fill(spark, df, monkeypatch):
    """Rows per bucket of a fill along k."""
    seen = []
    real = ordering.bucket_of
    monkeypatch.setattr(ordering, "bucket_of", lambda frame, keys, points: seen.append((frame, keys, points)) or real(frame, keys, points))
    ordering.fill_along(df, "v", ["k"], rows_per_bucket=100)
    frame, keys, points = seen[0]
    return [r["count"] for r in frame.groupBy(real(frame, keys, points).alias("b")).count().collect()]


@pytest.mark.parametrize("rows, limit", [(20_000, 64), (20_000, 63), (5000, 8)])
def test_no_bucket_takes_the_rest(spark, monkeypatch, rows, limit):
    monkeypatch.setattr(ordering, "MAX_BUCKETS", limit)
    df = spark.range(rows).select((F.col("id") * 7919 % 100_003).alias("k"))
    points = ordering.split_points(df, ["k"], rows, 1)
    assert len(points) == limit - 1
    sizes = sorted(r["count"] for r in df.groupBy(ordering.bucket_of(df, ["k"], points).alias("b")).count().collect())
    assert sizes[-1] < 3 * sizes[len(sizes) // 2]


def test_fill_needs_an_order(spark, edge):
    with pytest.raises(ValueError):
        ordering.fill_along(edge["ages"], "age", [])


@pytest.mark.parametrize("per_bucket", [10, 1000])
def test_running_total_and_codes(spark, per_bucket):
    df = spark.range(200).selectExpr("cast((id * 37) % 200 as double) - 100 as k", "id % 7 as n").repartition(3)
    got = {r["k"]: r["below"] for r in ordering.running_total(df, "k", "n", 200, "below", per_bucket).collect()}
    rows = sorted((r["k"], r["n"]) for r in df.collect())
    total = 0
    for k, n in rows:
        assert got[k] == total
        total += n
    words = spark.createDataFrame([(w,) for w in ["b", "a", None, "c", "a", "é", "B"]], "w string")
    codes = {r["level"]: r["code"] for r in ordering.dense_codes(words, "w", 2).collect()}
    assert codes == {w: i for i, w in enumerate(sorted({"a", "b", "c", "é", "B"}))}


def test_bucket_literal_is_folded(spark):
    df = spark.range(100).selectExpr("cast(id as double) k")
    points = [(10.0,), (50.5,)]
    plan = df.select(ordering.bucket_of(df, ["k"], points).alias("b"))._jdf.queryExecution().optimizedPlan().toString()
    assert "from_json" not in plan.lower()
    sizes = df.groupBy(ordering.bucket_of(df, ["k"], points).alias("b")).count().collect()
    assert {r["b"]: r["count"] for r in sizes} == {0: 10, 1: 41, 2: 49}


def test_timestamp_split_points(spark):
    df = spark.range(500).selectExpr("timestamp_ntz'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0,id * 1.5) as t", "id")
    points = ordering.split_points(df, ["t", "id"], 500, 50)
    assert 5 <= len(points) <= 10
    sizes = [r["count"] for r in df.groupBy(ordering.bucket_of(df, ["t", "id"], points).alias("b")).count().collect()]
    assert sum(sizes) == 500 and len(sizes) == len(points) + 1


def test_duplicates_tell_null_positions_apart(spark):
    df = spark.createDataFrame([(None, "1"), ("1", None), ("1", None), ("ab", "c"), ("a", "bc"), (None, None), (None, None)],
                               "a string, b string")
    assert duplicate_count(df) == 2
    numbers = spark.createDataFrame([(0.0, 1), (-0.0, 1), (float("nan"), 1), (None, 1)], "x double, y int")
    assert duplicate_count(numbers) == 2


def test_value_counts_of_all_types(spark):
    df = spark.sql("""SELECT cast(id % 2 = 0 as boolean) b, cast(id as decimal(10,2)) d, date'2024-01-01' + cast(id % 3 as int) dt,
        timestamp'2024-01-01 00:00:00' ts, timestamp_ntz'2024-01-01 00:00:00' tn, concat(repeat('x', 100), id % 4) long_text,
        if(id % 2 = 0, 0.0D, -0.0D) z FROM range(12)""")
    totals, best = frequencies.cardinality_and_top(df, df.columns, 2)
    assert {t["column_name"]: t["n_unique"] for t in totals} == {"b": 2, "d": 12, "dt": 3, "ts": 1, "tn": 1, "long_text": 4, "z": 1}
    first = {r["column_name"]: r["value"] for r in best if r["value_rank"] == 1}
    assert first["dt"] == "2024-01-01" and first["tn"] == "2024-01-01 00:00:00" and first["b"] == "false"
    assert first["long_text"][:100] == "x" * 100 and len(first["long_text"]) == 101
    with pytest.raises(TypeError):
        frequencies.value_counts(spark.sql("SELECT array(1) a"), ["a"])


def test_cardinality_plan_has_one_shuffle_per_family_and_no_distinct_expand(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    plan = frequencies.cardinality(df, ["l_returnflag", "l_linestatus"])._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and "ReadSchema: struct<l_returnflag:string,l_linestatus:string>" in plan


def test_pairs_match_pandas_with_gaps(spark):
    draw = random.Random(9)
    data = pd.DataFrame({"a": [draw.gauss(1e6, 3) for _ in range(300)]})
    data["b"] = data["a"] * 2 + [draw.gauss(0, 4) for _ in range(300)]
    data["c"] = [None if draw.random() < 0.4 else draw.random() for _ in range(300)]
    data["d"] = [None if draw.random() < 0.3 else float(i) for i in range(300)]
    data["e"] = 0.1
    data["f"] = [7.0 if pd.isna(v) else None for v in data["c"]]
    df = spark.createDataFrame([tuple(None if pd.isna(v) else float(v) for v in row) for row in data.to_numpy(dtype=float)],
                               ", ".join(f"{c} double" for c in data))
    got = {(r["c1"], r["c2"]): r["r"] for r in TableStats(df).pairs.collect()}
    want = data.astype(float).corr()
    for a, b in combinations(data, 2):
        if "e" in (a, b) or "f" in (a, b):
            continue
        assert got[a, b] == pytest.approx(want.loc[a, b], abs=1e-9)
    assert got["a", "e"] is None and got["c", "f"] is None


def test_shared_folder_follows_the_setting(spark):
    named = spark.conf.get("spark.checkpoint.dir")
    assert shared_folder(spark) == named and scratch_path(spark, "x").startswith(f"{named}/colsift/x-")


def test_exact_counts_on_wide_tables(spark):
    df = spark.range(50).select(*[(F.col("id") * i).alias(f"c.{i}") for i in range(90)])
    stats = TableStats(df).need("moments", "shape", "whole").need_outliers()
    assert stats.n_rows == 50 and stats.fact("c.2", "max") == 98.0 and stats.fact("c.89", "n_whole") == 50


def test_materialized_leaves_one_table(spark):
    from pathlib import Path

    from colsift.plans.session import cut_lineage, discard, materialized
    here = Path(shared_folder(spark).removeprefix("file://")) / "colsift"
    before = set(here.glob("*")) if here.exists() else set()
    kept = materialized(spark, lambda: cut_lineage(cut_lineage(spark.range(10), "a").filter("id > 3"), "b").filter("id > 5"), "c")
    assert kept.count() == 4 and len(set(here.glob("*")) - before) == 1
    discard(kept)
    assert set(here.glob("*")) == before


@pytest.mark.parametrize("backward", [False, True])
def test_fill_along_has_growing_frames_only(spark, backward, capsys):
    # a frame that ends at the last row is summed up anew at every row, which takes the square of a bucket's rows
    df = spark.createDataFrame([(i, None if i % 3 else float(i)) for i in range(400)], "k int, v double")
    ordering.fill_along(df, "v", ["k"], backward, rows_per_bucket=100).explain()
    assert "unboundedpreceding" in (plan := capsys.readouterr().out) and "unboundedfollowing" not in plan


def test_fill_backward_takes_missing_keys_where_ascending_order_has_them(spark):
    rows = [(None, 1, None), (None, 2, 5.0), (1, 3, None), (2, 4, None), (2, 5, 7.0), (3, 6, None)]
    df = spark.createDataFrame(rows, "t int, k int, v double").repartition(3)
    for per_bucket in (2, 100):
        got = {r["k"]: r["v"] for r in ordering.fill_along(df, "v", ["t", "k"], True, rows_per_bucket=per_bucket).collect()}
        assert got == {1: 5.0, 2: 5.0, 3: 7.0, 4: 7.0, 5: 7.0, 6: None}


def test_spearman_deals_out_narrow_rows(spark, monkeypatch, capsys):
    # rows partly laid side by side before the shuffle are as wide as whole ones, once for each column
    real, seen = correlate.cut_lineage, []
    monkeypatch.setattr(correlate, "cut_lineage", lambda df, label: (seen.append(df) if label == "ranks" else None) or real(df, label))
    monkeypatch.setattr(correlate, "discard", lambda *frames: None)
    df = spark.createDataFrame([(float(i % 5), float(i), None if i % 4 else float(-i)) for i in range(40)], "a double, b double, c double")
    found = correlate.spearman_pairs(TableStats(df))
    seen[0].explain()
    assert "REPARTITION_BY_COL" in capsys.readouterr().out
    want = df.toPandas().corr("spearman")
    assert found == pytest.approx([want.loc[p] for p in (("a", "b"), ("a", "c"), ("b", "c"))])


def test_spearman_keeps_rows_in_blocks(spark, monkeypatch):
    # neither rows nor their ranks are written one by one: they were, with all columns side by side
    real, written = correlate.cut_lineage, {}

    def noted(df, label):
        kept = real(df, label)
        written[label] = kept.count()
        return kept

    monkeypatch.setattr(correlate, "cut_lineage", noted)
    df = spark.range(4000).selectExpr("(id * 7919) % 4000 as a", "cast(id % 13 as double) as b", "if(id % 3 = 0, null, -sqrt(id)) as c").repartition(2)
    found = correlate.spearman_pairs(TableStats(df))
    want = df.toPandas().corr("spearman")
    assert found == pytest.approx([want.loc[p] for p in (("a", "b"), ("a", "c"), ("b", "c"))])
    assert set(written) == {"cells", "ranks"} and max(written.values()) < 100


@pytest.mark.parametrize("per_bucket", [7, 100_000])
def test_spearman_over_many_blocks(spark, monkeypatch, per_bucket):
    monkeypatch.setattr(rankings, "BLOCK_ROWS", 37)
    draw = random.Random(per_bucket)
    rows = []
    for i in range(500):
        a = draw.choice([0.0, -0.0, float("inf"), float("-inf"), 1e300, -5e-324]) if i % 4 == 0 else draw.gauss(0, 9)
        rows.append((a, draw.randrange(2**53) if i % 3 else None, float(i // 400), None, float("nan") if i % 7 == 0 else a + draw.gauss(0, 5), i if i % 5 else None))
    df = spark.createDataFrame(rows, "a double, b bigint, c double, d double, e double, f int").repartition(5)
    want = pd.DataFrame([[float("nan") if v is None else v for v in r] for r in rows], columns=list("abcdef")).rank()
    got = correlate.spearman_pairs(TableStats(df), per_bucket)
    for (x, y), r in zip(combinations("abcdef", 2), got):
        both = want[[x, y]].dropna().index
        p = pd.DataFrame([[float("nan") if v is None else v for v in rows[i]] for i in both], columns=list("abcdef"))[[x, y]].rank() if len(both) else None
        if p is None or p[x].std() == 0 or p[y].std() == 0:
            assert r is None
        else:
            assert r == pytest.approx(p[x].corr(p[y]), abs=1e-12)


def test_spearman_of_nothing(spark):
    assert correlate.spearman_pairs(TableStats(spark.createDataFrame([], "a double, b double"))) == [None]
    assert correlate.spearman_pairs(TableStats(spark.createDataFrame([(1.0,)], "a double"))) == []
    assert correlate.spearman_pairs(TableStats(spark.createDataFrame([(None, None)] * 3, "a double, b double"))) in ([None], [])
