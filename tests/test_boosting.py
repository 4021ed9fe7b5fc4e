"""Boosted trees against plain row-by-row versions."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler

from colsift.ml import boosting, engine
from colsift.ml.boosting import Boosting, Settings, derivatives
from colsift.plans import session


def table(spark, x, y):
    names = [f"x{i}" for i in range(x.shape[1])]
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)], [*names, "label"])
    return VectorAssembler(inputCols=names, outputCol="features", handleInvalid="keep").transform(df)


def plain_tree(x, g, h, depth, settings):
    """Values of all rows from a tree that tries every cut of every feature on the rows themselves."""
    whole = lambda m: g[m].sum() ** 2 / (h[m].sum() + settings.regLambda)
    value = -g.sum() / (h.sum() + settings.regLambda) * settings.stepSize
    best = (1e-6, None)
    for f in range(x.shape[1]) if depth else ():
        for cut in np.unique(x[:, f][~np.isnan(x[:, f])]):
            for gaps_left in (True, False):
                left = np.where(np.isnan(x[:, f]), gaps_left, x[:, f] <= cut)
                if min(h[left].sum(), h[~left].sum()) < settings.minChildWeight:
                    continue
                gain = whole(left) + whole(~left) - whole(np.ones(len(g), bool))
                if gain > best[0] + 1e-9:
                    best = (gain, left)
    if best[1] is None:
        return np.full(len(g), value)
    out = np.empty(len(g))
    for side in (best[1], ~best[1]):
        out[side] = plain_tree(x[side], g[side], h[side], depth - 1, settings)
    return out


def plain_scores(x, y, settings):
    margins = np.full((len(x), settings.scores), 0.0 if settings.classes else y.mean())
    for _ in range(settings.maxIter):
        g, h = derivatives(margins, y, settings)
        margins = margins + np.stack([plain_tree(x, g[:, k], h[:, k], settings.maxDepth, settings) for k in range(settings.scores)], axis=1)
    return margins


@pytest.mark.parametrize("rows_in_task", [10_000, 10])
@pytest.mark.parametrize("classes", [0, 2, 3])
def test_scores_are_those_of_trying_every_cut(spark, classes, rows_in_task):
    draw = np.random.default_rng(classes)
    x = draw.integers(0, 12, (160, 3)).astype(float)
    x[draw.random(x.shape) < 0.1] = np.nan
    signal = np.nan_to_num(x[:, 0], nan=9) * 2 + np.nan_to_num(x[:, 1]) + draw.normal(size=160)
    y = signal if not classes else np.digitize(signal, np.quantile(signal, np.arange(1, classes) / classes)).astype(float)
    options = {"classes": classes, "maxIter": 3, "maxDepth": 3}
    model = Boosting(**options, rows_in_task=rows_in_task).fit(table(spark, x, y))
    assert np.allclose(model.margins(x), plain_scores(x, y, Settings(**options)))


def test_both_ways_agree_over_rewritten_rows(spark):
    draw = np.random.default_rng(1)
    x = draw.normal(size=(400, 2))
    df = table(spark, x, x[:, 0] ** 2 + x[:, 1])
    fits = [Boosting(maxIter=12, maxDepth=2, rows_in_task=n).fit(df) for n in (1000, 10)]
    assert np.allclose(fits[0].margins(x), fits[1].margins(x))
    assert abs(fits[0].featureImportances.toArray().sum() - 1) < 1e-12
    guesses = [r[0] for r in fits[0].transform(df).select("prediction").collect()]
    assert np.allclose(sorted(guesses), sorted(fits[0].margins(x)[:, 0]))


def test_tables_without_rows_or_without_a_split(spark):
    flat = table(spark, np.ones((5, 1)), np.full(5, 2.0))
    assert [r[0] for r in Boosting(maxIter=2).fit(flat).transform(flat).select("prediction").collect()] == [2.0] * 5
    with pytest.raises(ValueError):
        Boosting().fit(flat.limit(0))
    assert Boosting(maxIter=1).fit(flat).transform(flat.limit(0)).count() == 0


def test_rows_are_written_in_spread_blocks_and_sums_meet_either_way(spark, monkeypatch):
    draw = np.random.default_rng(3)
    x = draw.integers(0, 9, (500, 2)).astype(float)
    df = table(spark, x, x[:, 0] * 2 + x[:, 1]).coalesce(1)
    written = []
    real = boosting._written_form
    monkeypatch.setattr(boosting, "_written_form", lambda rows, model: written.append(real(rows, model)) or written[-1])
    monkeypatch.setattr(boosting, "BLOCK", 60)
    monkeypatch.setattr(boosting, "spread_rows", lambda rows, n: session.spread_rows(rows, n, 100))
    options = {"maxIter": 4, "maxDepth": 3, "rows_in_task": 10}
    fits = []
    for bound in (0, 10**9):
        monkeypatch.setattr(boosting, "SUMS_AT_ONCE", bound)
        fits.append(Boosting(**options).fit(df))
    assert written[0].rdd.getNumPartitions() == 5 and all(len(r["bins"]) <= 120 for r in written[0].collect())
    assert np.allclose(fits[0].margins(x), fits[1].margins(x))
    assert np.allclose(fits[0].margins(x), plain_scores(x, x[:, 0] * 2 + x[:, 1], Settings(maxIter=4, maxDepth=3)))


def test_fits_deal_rows_out_by_their_number(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(engine, "spread_rows", lambda df, n: seen.append(session.spread_rows(df, n, 100)) or seen[-1])
    df = spark.createDataFrame([(i / 7, i / 7 + i % 3) for i in range(900)], "a double, y double").coalesce(1)
    with engine.ModelBench(df, "y", "regression", ["a"]) as bench:
        found = bench.train("svr").metrics.first()
        # asked while the bench is open, as it removes what the rows are read from
        assert seen[0].rdd.getNumPartitions() == -(-seen[0].count() // 100) and seen[1].rdd.getNumPartitions() > 1
        assert seen[0].count() + seen[1].count() == 900
    assert found["r2"] > 0
