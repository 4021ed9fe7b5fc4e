import math
import random
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from colsift.operators import (charts, clean, correlate, distribution, insights, outliers, patterns, profile, reports, scores,
                               tables, timeseries, validate)
from colsift.plans.roles import column_roles
from colsift.plans.stats import TableStats


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_roles_in_both_flavors(spark):
    df = spark.sql("""SELECT 1 i, 1.5D f, cast(1 as decimal(10,2)) d, true b, 's' s, date'2024-01-01' dt,
        timestamp_ntz'2024-01-01 00:00:00' ts, array(1) arr""")
    e, a = column_roles(df, "E"), column_roles(df, "A")
    assert e.numeric == ["i", "f", "d"] and a.numeric == ["i", "f", "d", "b"]
    assert e.categorical == ["s"] and e.datetime == ["dt", "ts"] and e.role("arr") == "other" and e.role("b") == "other"


def test_ages_lose_one_outlier(edge):
    cleaner = clean.Cleaner(edge["ages"]).remove_outliers("age")
    assert clean.iqr_bounds(edge["ages"], "age") == (17.5, 45.5)
    assert cleaner.df.count() == 4 and cleaner.log[0]["n_changed"] == 1


def test_fill_methods(spark, edge):
    gaps = spark.createDataFrame([(25.0,), (30.0,), (None,), (40.0,), (50.0,)], "age double")
    assert clean.fill_missing(gaps, "age", "median").filter("age = 35").count() == 1
    assert clean.fill_missing(gaps, "age", "mean").filter("age = 36.25").count() == 1
    assert clean.column_mode(edge["ties"], "v") == 2
    assert clean.fill_missing(gaps, "age", "custom", 1).agg(F.sum("age")).first()[0] == 146
    for bad in (("custom", None), ("guess", 1)):
        with pytest.raises(ValueError):
            clean.fill_missing(gaps, "age", *bad)
    nan = spark.createDataFrame([(float("nan"),), (2.0,)], "x double")
    assert clean.fill_missing(nan, "x", "mean").filter("x = 2").count() == 2


@pytest.mark.parametrize("method,left", [("forward_fill", 2), ("backward_fill", 1), ("mode", 0)])
def test_fill_report_counts_what_is_left(spark, method, left):
    values = [None, None, 1.0, None, 4.0, None]
    df = spark.createDataFrame(list(enumerate(values)), "k int, v double")
    step = clean.Cleaner(df).fill_missing("v", method, order_by=["k"])
    assert step.log[0]["missing_after"] == left == step.df.filter("v is null").count()
    assert step.log[0]["n_changed"] == 4 - left
    empty = clean.Cleaner(df.withColumn("v", F.lit(None).cast("double"))).fill_missing("v", method, order_by=["k"])
    assert empty.log[0]["missing_after"] == 6


def test_numbers_are_valid_dates(spark):
    df = spark.createDataFrame([(1_700_000_000_000_000_000, "soon")], "update_time long, due_date string")
    assert [r["column_name"] for r in rows(validate.date_issues(TableStats(df)))] == ["due_date"]
    assert clean.convert_type(df, "update_time", "datetime").first()["update_time"].year == 2023


def test_outlier_rules_drop_missing_and_constant(spark, edge):
    gaps = spark.createDataFrame([(1.0,), (2.0,), (None,)], "x double")
    assert clean.drop_outliers(gaps, "x").count() == 2
    assert clean.drop_outliers(edge["constant"], "a", "zscore").count() == 0
    assert clean.drop_outliers(edge["constant"], "a", "iqr").count() == 3
    with pytest.raises(ValueError):
        clean.drop_outliers(gaps, "x", "guess")


def test_dedup_keeps_the_first_of_a_hot_key(spark):
    df = spark.range(3000).selectExpr("if(id % 3 = 0, 0, id) as k", "3000 - id as place").repartition(6)
    kept = clean.drop_duplicates(df, ["k"], ["place"])
    assert kept.count() == 2001 and kept.filter("k = 0").first()["place"] == 3
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    once = clean.drop_duplicates(df.unionAll(df))
    assert once.count() == 3000 == clean.drop_duplicates(once).count()
    with pytest.raises(ValueError):
        clean.drop_duplicates(df, ["k"])


def test_casts(spark):
    texts = spark.createDataFrame([("25",), ("x",), (None,), ("9007199254740993",)], "age string")
    assert [r[0] for r in clean.convert_type(texts, "age", "int").collect()] == [25, None, None, 9007199254740993]
    half = clean.Cleaner(spark.createDataFrame([("1.5",)], "v string")).convert_type("v", "int")
    assert not half.log[0]["success"] and half.df.schema["v"].dataType.simpleString() == "string"
    levels = spark.createDataFrame([("Kumasi",), ("Accra",), (None,)], "c string")
    assert sorted(clean.category_levels(levels, "c").collect()) == [("Accra", 0), ("Kumasi", 1)]
    with pytest.raises(ValueError):
        clean.convert_type(texts, "age", "colour")


def test_low_variance(spark):
    df = spark.createDataFrame([(1.0, 1.0, "x"), (1.001, 5.0, "x")], "a double, b double, c string")
    assert clean.low_variance_columns(df) == ["a"]
    assert clean.low_variance_columns(df.limit(1)) == []


def test_cleaner_is_immutable(edge):
    start = clean.Cleaner(edge["ages"])
    step = start.standardize_text("name", ["lowercase"]).convert_type("age", "float")
    assert start.log == () and [r["step"] for r in step.log] == [1, 2]
    assert step.summary().first()["operations"] == "standardize_text,convert_type"
    assert step.log_frame().count() == 2


@pytest.mark.parametrize("name", ["empty", "one_row", "all_null", "constant", "nan_inf", "ties"])
def test_every_report_runs_on_edge_tables(edge, name):
    df = edge[name]
    assert all(r["level"] in ("issue", "warning", "info") for r in rows(validate.validate_all(TableStats(df))))
    assert reports.full_report(TableStats(df)).filter("section = 'overview'").count() == 5
    reports.comprehensive_analysis(TableStats(df, "A")).collect()
    reports.statistical_analysis(TableStats(df, "A")).collect()
    score = scores.deducting_score(TableStats(df, "A")).first()["quality_score"]
    assert 0 <= score <= 100
    insights.insights_summary(TableStats(df, "A")).collect()
    charts.boxplots(TableStats(df)).collect()
    scores.ml_next_steps(TableStats(df)).collect()
    scores.target_candidates(TableStats(df)).collect()
    outliers.outlier_advice(TableStats(df)).collect()


def test_one_row_statistics(edge):
    row = rows(profile.numeric_profile(TableStats(edge["one_row"])))[0]
    assert row["std_dev"] == 0.0 and row["skewness"] == 0.0
    assert rows(profile.describe(TableStats(edge["one_row"])))[0]["std"] is None


def test_constant_correlation_is_null(edge):
    assert rows(correlate.correlation_pairs(TableStats(edge["constant"])))[0]["r"] is None


def test_findings(spark):
    df = spark.createDataFrame([("Apple ", "USA", 1), ("Apple", "usa", 1), ("Pear", "Usa", 2)], "s string, c string, user_id int")
    stats = TableStats(df)
    assert rows(validate.whitespace(stats))[0]["affected_rows"] == 1
    case = rows(validate.case_inconsistency(stats))
    assert [(r["column_name"], r["n_unique"], r["n_unique_lower"]) for r in case] == [("c", 3, 1)]
    assert rows(validate.identifier_duplicates(stats))[0]["duplicate_count"] == 1
    assert {r["column_name"] for r in rows(validate.type_issues(stats))} == {"s", "c"}
    assert validate.type_issues(stats, mixed_only=True).count() == 0


def test_duplicate_positions_of_a_hot_group(spark):
    df = spark.range(900).selectExpr("if(id < 300, 'same', cast(id as string)) v", "id % 1 as one").repartition(7)
    again = df.unionAll(df.filter("v > '89'"))
    found = validate.duplicate_positions(again, ["v"], limit=50, salts=4)
    repeated = [r["v"] for r in found.collect()]
    assert repeated == sorted(repeated) and len(repeated) == 50
    want = again.toPandas().sort_values("v", kind="stable")
    assert repeated == list(want[want.duplicated()]["v"].head(50))


@pytest.mark.parametrize("per_bucket", [7, 10_000])
def test_spearman_of_all_pairs_with_gaps(spark, per_bucket):
    draw = random.Random(4)
    rows = []
    for i in range(200):
        a = float(draw.randrange(15))
        rows.append((a, a + draw.gauss(0, 3) if i % 5 else None, float(draw.randrange(4)) if i % 3 else None, 7.0, -a if i % 7 else None))
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double").repartition(3)
    want = pd.DataFrame(rows, columns=list("abcde")).corr(method="spearman")
    got = correlate.spearman_pairs(TableStats(df), per_bucket)
    for (x, y), r in zip(combinations("abcde", 2), got):
        assert (r is None and "d" in (x, y)) or r == pytest.approx(want.loc[x, y], abs=1e-12)


def brute_tau(x, y):
    con = dis = tx = ty = 0
    for i in range(len(x)):
        for j in range(i):
            a, b = np.sign(x[i] - x[j]), np.sign(y[i] - y[j])
            con += a * b > 0
            dis += a * b < 0
            tx += a == 0 != b
            ty += b == 0 != a
    return (con - dis) / math.sqrt((con + dis + tx) * (con + dis + ty))


@pytest.mark.parametrize("per_bucket", [5, 10_000])
def test_rank_correlations(spark, per_bucket):
    draw = random.Random(2)
    x = [float(draw.randrange(12)) if i % 3 else 4.0 for i in range(150)]
    y = [v + draw.randrange(8) for v in x]
    df = spark.createDataFrame(list(zip(x, y)) + [(1.0, None), (None, 2.0)], "x double, y double")
    assert correlate.kendall(df, "x", "y", per_bucket) == pytest.approx(brute_tau(x, y), abs=1e-12)
    ranks = pd.DataFrame({"x": x, "y": y}).rank().corr().iloc[0, 1]
    assert correlate.spearman(df, "x", "y", per_bucket) == pytest.approx(ranks, abs=1e-12)
    flat = df.withColumn("y", F.lit(1.0))
    assert correlate.kendall(flat, "x", "y") is None and correlate.spearman(flat, "x", "y") is None


def test_strongest_pair_is_off_the_diagonal(spark):
    df = spark.createDataFrame([(1.0, 2.0, 9.0), (2.0, 4.0, 1.0), (3.0, 6.1, 5.0)], "a double, b double, c double")
    best = correlate.strongest_pair(TableStats(df)).first()
    assert (best["c1"], best["c2"], best["type"]) == ("a", "b", "positive")


@pytest.mark.parametrize("bins", [20, "auto"])
def test_histograms_match_numpy(spark, bins):
    draw = random.Random(4)
    data = {"u": [draw.random() for _ in range(700)], "n": [draw.gauss(0, 3) for _ in range(700)],
            "k": [0.1 * draw.randrange(20) for _ in range(700)], "c": [3.0] * 700}
    df = spark.createDataFrame(pd.DataFrame(data))
    got = distribution.histogram(TableStats(df), list(data), bins).toPandas()
    for c, values in data.items():
        counts, edges = np.histogram(values, bins=bins)
        mine = got[got.column_name == c].sort_values("bin")
        assert list(mine["cnt"]) == list(counts)
        assert list(mine["lower"]) == pytest.approx(list(edges[:-1])) and list(mine["upper"]) == pytest.approx(list(edges[1:]))


def test_patterns(spark):
    days = spark.sql("SELECT date'2024-01-01' + cast(id as int) d, 7.0D c, id % 2 b, 'x' t FROM range(40)")
    found = {(r["column_name"], r["pattern"]) for r in rows(patterns.detect_patterns(TableStats(days, "A")))}
    assert {("d", "daily frequency"), ("c", "constant value"), ("b", "binary"), ("t", "dominated by one category (100.0%)")} <= found
    with pytest.raises(ValueError):
        patterns.detect_patterns(TableStats(days), "colour")


def test_clean_table_looks_great(spark):
    df = spark.range(2000).selectExpr("id % 50 as n", "cast(id as double) as v")
    assert [r["title"] for r in rows(insights.insights(TableStats(df)))] == ["Data Looks Great!"]
    assert scores.ml_readiness(TableStats(df)).first()["readiness_level"] == "Ready"
    assert rows(scores.ml_next_steps(TableStats(df)))[0]["step"].startswith("Your data is ready")


def test_time_series_squeezes_gaps_for_the_trend(spark):
    df = spark.createDataFrame([("2024-01-01", 1.0), ("2024-01-01", 3.0), ("2024-01-04", 4.0), ("2024-03-01", 6.0)],
                               "d string, v double").withColumn("d", F.col("d").cast("date"))
    assert timeseries.daily(df, "d", "v").count() == 61
    months = {r["month"]: r["mean_value"] for r in rows(timeseries.monthly(df, "d", "v"))}
    assert months == {"2024-01": pytest.approx(8 / 3), "2024-02": None, "2024-03": 6.0}
    line = timeseries.trend(df, "d", "v").first()
    assert (line["slope"], line["strength"], line["direction"]) == (2.0, 1.0, "increasing")
    assert timeseries.trend(df.limit(1), "d", "v").first()["direction"] == "stable"
    with pytest.raises(ValueError):
        timeseries.daily(df, "v", "v")


def test_diff_and_snapshots(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "k int, v string")
    new = spark.createDataFrame([(1, "a"), (2, "b"), (4, "d")], "k int, v string")
    got = {r["k"]: r["change"] for r in rows(tables.diff_versions(old, new, ["k"]))}
    assert got == {2: "changed", 3: "removed", 4: "added"}
    kept = tables.Snapshots(spark, str(tmp_path / "versions"))
    kept.save(old, 1, "raw")
    kept.save(new, 2)
    assert kept.read(1).count() == 3 and kept.manifest().count() == 2
    with pytest.raises(ValueError):
        tables.merge_tables(old, new, ["k"], "sideways")


def test_messages(edge):
    found = insights.finding_text(profile.overview(TableStats(edge["ages"])), "dataset_overview").first()
    assert found["message"] == "Dataset of 5 rows and 2 columns"
    with pytest.raises(ValueError):
        insights.finding_text(edge["ages"], "poem")


def test_history_appends(spark, edge, tmp_path):
    table = profile.overview(TableStats(edge["ages"])).withColumn("column_name", F.lit("*"))
    part = profile.long_form("overview", table, "column_name", ["total_rows"])
    for run in ("a", "b"):
        reports.append_history(part, "quick", run, str(tmp_path / "history"))
    assert spark.read.parquet(str(tmp_path / "history")).count() == 2


def test_histogram_counts_infinities_apart(spark):
    from colsift.operators import distribution
    inf = float("inf")
    df = spark.createDataFrame([(x, inf) for x in [0.0, 1.0, 2.0, 4.0, inf, inf, -inf, None, float("nan")]], "x double, y double")
    for bins in (4, "auto"):
        rows = {(r["column_name"], r["bin"]): r for r in distribution.histogram(TableStats(df), ["x", "y"], bins).collect()}
        size = max(b for c, b in rows if c == "x")
        assert (rows["x", -1]["cnt"], rows["x", size]["cnt"]) == (1, 2) and rows["x", size]["lower"] == inf
        assert sum(r["cnt"] for (c, b), r in rows.items() if c == "x" and 0 <= b < size) == 4
        assert sum(r["cnt"] for (c, _), r in rows.items() if c == "y") == 9 and ("y", -1) not in rows
