import hashlib
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from colsift.ml import components, density, engine, leafwise, metrics, models, prepare, spacetree


@pytest.fixture(scope="module")
def homes(spark):
    """A price and a class that follow from the other columns, with gaps and a text feature."""
    return spark.range(600).selectExpr(
        "if(id % 11 = 0, null, cast(id % 40 as double)) as size", "if(id % 13 = 0, null, element_at(array('Accra', 'Kumasi', 'Tema'), cast(id % 3 as int) + 1)) as city",
        "cast((id * 7) % 50 as int) as age", "cast(3 * (id % 40) + 20 * (id % 3) + 5 as double) as price",
        "if(id % 40 >= 20, 'dear', 'cheap') as band")


def test_label_codes_are_alphabetical(spark):
    df = spark.createDataFrame([(25, "Male"), (30, "Female"), (1, None)], "age int, gender string")
    coded, levels = prepare.encode(df, ["gender"])
    assert {r["age"]: r["gender"] for r in coded.collect()} == {25: 1.0, 30: 0.0, 1: 2.0}
    assert levels["gender"].count() == 3


def test_split_is_whole_disjoint_and_stable(homes):
    train, test = prepare.split(homes.withColumn("id", F.monotonically_increasing_id()), 0.2)
    again = prepare.split(homes.withColumn("id", F.monotonically_increasing_id()), 0.2)[1]
    assert train.count() + test.count() == 600 and train.join(test, "id").count() == 0
    assert test.exceptAll(again).count() == 0 and 80 <= test.count() <= 160


def test_scaler_uses_the_population_deviation(spark):
    df = spark.createDataFrame([(1.0, 4.0), (3.0, 4.0)], "x double, c double")
    assert sorted(tuple(r) for r in prepare.Scaler.fit(df, ["x", "c"]).transform(df).collect()) == [(-1.0, 0.0), (1.0, 0.0)]


@pytest.mark.parametrize("name", ["logistic_regression", "Decision Tree", "naive_bayes", "svm"])
def test_classifiers_beat_the_majority(homes, name):
    bench = engine.ModelBench(homes, "band", "classification", ["size", "city", "age"])
    assert bench.train(name).metrics.first()["accuracy"] > 0.6


def test_forest_importance_and_options(homes):
    bench = engine.ModelBench(homes, "price", "regression", ["size", "city", "age"])
    trained = bench.train("random forest", n_estimators=10, max_depth=6)
    assert trained.metrics.first()["r2"] > 0.5
    top = trained.importance.collect()
    assert sum(r["importance"] for r in top) == pytest.approx(1) and top[0]["feature"] == "size"
    ranked = bench.compare(["linear_regression", "decision_tree"]).collect()
    assert [r["rank"] for r in ranked] == [1, 2] and ranked[0]["is_best"] and ranked[0]["score"] >= ranked[1]["score"]
    assert set(bench.test_data().columns) == {"size", "city", "age", "price"}


def test_multi_class(homes):
    df = homes.withColumn("band", F.concat("band", (F.col("age") % 2).cast("string")))
    bench = engine.ModelBench(df, "band", "classification", ["size", "age"])
    assert bench.train("decision_tree").metrics.first()["accuracy"] > 0.4


def test_numeric_classes_come_back_as_they_were(homes):
    df = homes.withColumn("band", F.expr("if(band = 'dear', 7, -3)"))
    bench = engine.ModelBench(df, "band", "classification", ["size", "age"])
    trained = bench.train("logistic_regression")
    assert trained.metrics.first()["accuracy"] > 0.6
    found = bench.predict(trained, df.filter("size is not null").select("size", "age"))
    assert {r["prediction"] for r in found.distinct().collect()} == {-3.0, 7.0}
    assert {r["band"] for r in bench.test_data().select("band").distinct().collect()} == {-3.0, 7.0}


def test_unseen_labels_count_as_the_first(homes):
    bench = engine.ModelBench(homes, "band", "classification", ["size", "city", "age"])
    trained = bench.train("decision_tree")
    new = homes.filter("size is not null").limit(20)
    known = bench.predict(trained, new.withColumn("city", F.lit("Accra"))).agg(F.sum("prediction")).first()[0]
    assert bench.predict(trained, new.withColumn("city", F.lit("Atlantis"))).agg(F.sum("prediction")).first()[0] == known


def test_names_and_options_are_checked():
    for problem, name in (("classification", "svr"), ("clustering", "random_forest"), ("regression", "magic")):
        with pytest.raises(ValueError):
            models.estimator(problem, name)
    with pytest.raises(ValueError):
        models.estimator("classification", "naive_bayes", n_estimators=3)


def test_metrics_of_a_class_never_predicted(spark):
    df = spark.createDataFrame([(0.0, 0.0), (1.0, 0.0), (0.0, 0.0), (1.0, 0.0)], "label double, prediction double")
    row = metrics.classification_metrics(df).first()
    assert (row["accuracy"], row["precision"], row["recall"]) == (0.5, 0.25, 0.5)
    assert row["f1_score"] == pytest.approx(1 / 3)


def test_kmeans_cost_is_the_sum_of_squared_distances(spark, homes):
    trained = engine.ModelBench(homes, None, "clustering", ["size", "age"]).train("kmeans", n_clusters=3)
    centers = trained.model.clusterCenters()
    cost = sum(float(((r["features"].toArray() - centers[r["prediction"]]) ** 2).sum()) for r in trained.predictions.collect())
    row = trained.metrics.first()
    assert row["inertia"] == pytest.approx(cost) and row["n_clusters"] == 3


def brute_force(points, eps, min_samples):
    """Cluster of every point: the core points by connection, border points as the set they may join."""
    points = np.array(points)
    near = ((points[:, None] - points[None]) ** 2).sum(axis=2) <= eps * eps
    core = near.sum(axis=1) >= min_samples
    label = [-1] * len(points)
    for i in range(len(points)):
        if core[i] and label[i] < 0:
            stack, label[i] = [i], i
            while stack:
                for j in np.flatnonzero(near[stack.pop()] & core):
                    if label[j] < 0:
                        label[j] = i
                        stack.append(j)
    return core, label, near


@pytest.mark.parametrize("dimensions,eps", [(1, 0.05), (2, 0.3), (3, 0.8), (6, 1.6)])
def test_dbscan_matches_brute_force(spark, dimensions, eps, **options):
    draw = random.Random(dimensions)
    points = [tuple(draw.gauss(3 * (i % 4), 0.6) for _ in range(dimensions)) for i in range(300)]
    # a third of the table is one point, and some pairs lie exactly eps apart
    points += [(1.0,) * dimensions] * 150 + [tuple([10.0 + k * eps] + [5.0] * (dimensions - 1)) for k in range(8)]
    names = [f"x{i}" for i in range(dimensions)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "id int, " + ", ".join(f"{n} double" for n in names))
    got = {r["id"]: r["prediction"] for r in density.dbscan(df, names, eps, 5, **options).collect()}
    core, label, near = brute_force(points, eps, 5)
    assert len(got) == len(points)
    renamed = {}
    for i in range(len(points)):
        if core[i]:
            assert renamed.setdefault(label[i], got[i]) == got[i]
        else:
            reachable = {label[j] for j in np.flatnonzero(near[i] & core)}
            assert (got[i] == -1) == (not reachable)
    assert len(set(renamed.values())) == len(renamed)
    for i in range(len(points)):
        if not core[i] and got[i] >= 0:
            assert got[i] in {renamed[label[j]] for j in np.flatnonzero(near[i] & core)}


def test_dbscan_splits_crowded_boxes(spark, monkeypatch):
    monkeypatch.setattr(density, "PAIRS_COMPARED", 4)
    test_dbscan_matches_brute_force(spark, 2, 0.7)


@pytest.mark.parametrize("dimensions,eps", [(5, 1.3), (8, 1.9)])
def test_dbscan_on_small_leaves(spark, monkeypatch, dimensions, eps):
    monkeypatch.setattr(density, "PAIRS_COMPARED", 4)
    test_dbscan_matches_brute_force(spark, dimensions, eps, leaf_rows=12)


def test_leaves_hold_all_neighbours(spark):
    draw = random.Random(9)
    points = [tuple(draw.choice([draw.gauss(0, 3), float(draw.randrange(-4, 5)), 2.0]) for _ in range(6)) for _ in range(900)]
    points = sorted(set(points))
    df = spark.createDataFrame([(list(p), i) for i, p in enumerate(points)], "x array<double>, i int")
    eps = 1.0
    rows = spacetree.with_leaves(df, 6, eps, 40).collect()
    home = {r["i"]: r["key"] for r in rows if r["home"]}
    found = {(r["key"], r["i"]) for r in rows}
    assert len(home) == len(points) == sum(r["home"] for r in rows) and len(found) == len(rows) and len(set(home.values())) > 10
    x = np.array(points)
    for i, j in np.argwhere(((x[:, None] - x[None]) ** 2).sum(axis=2) <= eps * eps):
        assert (home[i], j) in found


def test_coarse_leaves_and_those_passed_on_hold_all_neighbours(spark, monkeypatch):
    monkeypatch.setattr(spacetree, "SAMPLE_PER_LEAF", 8)
    monkeypatch.setattr(spacetree, "COARSE_ROWS", 60)
    monkeypatch.setattr(spacetree.with_leaves, "__defaults__", (40, 60))
    test_leaves_hold_all_neighbours(spark)
    for large in (8, 0.5):
        monkeypatch.setattr(spacetree, "TOO_LARGE", large)
        test_dbscan_on_small_leaves(spark, monkeypatch, 5, 1.3)


def test_cuts_in_gaps_make_no_guests(spark):
    # steps wider than eps in two dimensions: rows meet only those of their own step
    draw = random.Random(4)
    points = [(float(draw.randrange(7)), float(draw.randrange(9)), *(draw.uniform(0, 3) for _ in range(6))) for _ in range(6300)]
    df = spark.createDataFrame([(list(p),) for p in points], "x array<double>")
    rows = spacetree.with_leaves(df, 8, 0.9, 200).agg({"*": "count"}).first()[0]
    assert rows == len(points)


def test_dbscan_compares_few_pairs_in_six_dimensions(spark):
    draw = random.Random(2)
    points = [tuple(draw.uniform(0, 100) for _ in range(6)) for _ in range(6000)]
    df = spark.createDataFrame(points, "a double, b double, c double, d double, e double, f double")
    pairs = density.compared_pairs(df, df.columns, 2.0, 5, leaf_rows=100)
    assert 6000 <= pairs <= 6000 * 4 * 100


def test_dbscan_writes_no_pairs_of_many_features(spark, monkeypatch):
    # every point has hundreds of neighbours: what is written must follow the points and not their pairs
    draw = random.Random(5)
    points = [tuple(draw.uniform(0, 1) for _ in range(6)) for _ in range(1500)]
    df = spark.createDataFrame(points, "a double, b double, c double, d double, e double, f double")
    written = {}
    for module in (density, leafwise, components):
        def noted(frame, label="step", real=module.cut_lineage):
            kept = real(frame, label)
            written[label] = max(written.get(label, 0), kept.count())
            return kept
        monkeypatch.setattr(module, "cut_lineage", noted)
    sizes = sorted(r["count"] for r in density.dbscan(df, df.columns, 0.5, 2).groupBy("prediction").count().collect())
    core, label, _ = brute_force(points, 0.5, 2)
    assert sizes == sorted([n for n in np.unique(np.array(label)[core], return_counts=True)[1]] + [np.count_nonzero(~core)] * (not core.all()))
    assert written and max(written.values()) <= 2 * len(points), written


@pytest.mark.parametrize("coarse", [20_000, 60])
def test_leaf_by_leaf_agrees_with_joins(spark, monkeypatch, coarse):
    # copies, missing, infinite and undefined coordinates; clusters and border points have the same numbers either way
    draw = random.Random(coarse)
    odd = [None, float("nan"), float("inf"), float("-inf"), -0.0, 1e12]
    points = [tuple(draw.choice(odd) if draw.random() < 0.02 else draw.gauss(2.5 * (i % 3), 0.7) for _ in range(5)) for i in range(300)]
    points += points[::4] + [(1.0, 1.0, None, 1.0, 1.0), (1.0, 1.0, None, 1.0, 1.05), (None, 1.0, 1.0, 1.0, 1.0)] * 3
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "id int, a double, b double, c double, d double, e double")
    monkeypatch.setattr(spacetree, "COARSE_ROWS", coarse)
    monkeypatch.setattr(spacetree, "SAMPLE_PER_LEAF", 8)
    clustered = lambda: [tuple(r) for r in density.dbscan(df, list("abcde"), 1.1, 4, 30, "core").select("id", "prediction", "core").orderBy("id").collect()]
    got = clustered()
    assert len(got) == len(points) and len({p for _, p, _ in got}) > 3 and {c for _, _, c in got} == {True, False}
    monkeypatch.setattr(leafwise, "clusters", lambda *_: None)
    assert got == clustered()


@pytest.mark.parametrize("far", [0.0, 1e7])
def test_near_points_agree_with_plain_sums(far):
    draw = np.random.default_rng(3)
    x = draw.integers(0, 9, (400, 6)) * 0.1 + far  # many pairs lie exactly eps apart
    rows = np.arange(400)
    for eps in (0.1, 0.3, 0.5):
        want = sum((x[:, None, k] - x[None, :, k]) ** 2 for k in range(6)) <= eps * eps
        got = np.concatenate([near for _, near in leafwise.near_blocks(x, rows, rows, eps)])
        assert (got == want).all()


def test_dbscan_needs_a_feature(spark):
    with pytest.raises(ValueError):
        density.dbscan(spark.range(1), [])


def test_components_of_a_chain_a_star_and_a_loner(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)]
    nodes = sorted({n for e in edges for n in e} | {500})
    got = components.components(spark.createDataFrame([(n,) for n in nodes], "node int"),
                                spark.createDataFrame(edges, "u int, v int"))
    assert {r["node"]: r["root"] for r in got.collect()} == {n: 0 if n <= 40 else 100 if n < 500 else 500 for n in nodes}


def test_compare_goes_on_after_a_failure_and_says_why(spark):
    df = spark.createDataFrame([(float(i), float(i % 7), "a" if i < 60 else "b") for i in range(120)], "x double, z double, y string")
    with engine.ModelBench(df, "y", "classification") as bench:
        rows = bench.compare(["no such model", "Decision Tree"]).orderBy("rank").collect()
        folder = bench.prepared.df.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")
        assert os.path.exists(folder)
    assert not os.path.exists(folder)
    assert [(r["model_type"], r["is_best"], r["error"] is None) for r in rows] == [("decision_tree", True, True), ("no_such_model", False, False)]
    assert "accuracy" in rows[0]["metrics"] and "accuracy" in rows[0]["reason"] and "unknown" in rows[1]["error"]


def test_predict_fills_gaps_with_fitted_medians(spark):
    df = spark.createDataFrame([(float(i), "low" if i < 50 else "high") for i in range(101)], "x double, y string")
    bench = engine.ModelBench(df, "y", "classification")
    trained = bench.train("decision_tree")
    new = spark.createDataFrame([(1, None), (2, 50.0)], "id int, x double")
    got = {r["id"]: r["prediction"] for r in bench.predict(trained, new).collect()}
    assert got[1] == got[2]


def test_split_by_key_is_the_md5_of_the_key(spark):
    df = spark.createDataFrame([(i, i * 2.0) for i in range(500)], "k bigint, x double")
    train, test = prepare.split(df, 0.3, 7, "k")
    want = {i for i in range(500) if int(hashlib.md5(f"7|{i}".encode()).hexdigest()[:8], 16) % 10_000 < 3000}
    assert {r["k"] for r in test.collect()} == want and train.count() == 500 - len(want)
