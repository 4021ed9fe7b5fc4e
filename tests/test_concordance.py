import random
from itertools import combinations

import numpy as np
import pytest

from colsift.operators import correlate
from colsift.plans import concordance
from colsift.plans.stats import TableStats


def brute_tau(rows, a, b):
    both = [(r[a], r[b]) for r in rows if r[a] is not None and r[b] is not None and r[a] == r[a] and r[b] == r[b]]
    x, y = (np.greater.outer(v, v).astype(int) - np.less.outer(v, v) for v in np.array(both, float).reshape(-1, 2).T)
    agree, spread = (x * y).sum(), np.sqrt(float((x != 0).sum()) * float((y != 0).sum()))
    return agree / spread if spread else None


@pytest.mark.parametrize("per_bucket", [3, 40, 10_000])
def test_kendall_of_all_pairs(spark, per_bucket):
    pick = random.Random(per_bucket)
    rows = []
    for i in range(240):
        a = 5.0 if i % 3 == 0 else float(pick.randrange(30))  # a third of all rows share a value
        rows.append((a, a + pick.gauss(0, 6) if i % 5 else None, pick.randrange(4) if i % 4 else 2, 7.0, -a if i % 7 else float("nan"),
                     float("inf") if i % 9 == 0 else pick.random(), None, float(i)))
    df = spark.createDataFrame(rows, "a double, b double, c int, d double, e double, f double, g double, h double").repartition(3)
    got = correlate.correlation_pairs(TableStats(df), "kendall").orderBy("pair").collect()
    names = "abcdefgh"
    assert [(r["c1"], r["c2"]) for r in got] == list(combinations(names, 2))
    for r in got:
        want = brute_tau(rows, names.index(r["c1"]), names.index(r["c2"]))
        assert (r["r"] is None and want is None) or r["r"] == pytest.approx(want, abs=1e-12), r
    fixed = concordance.kendall_pairs(df, per_bucket)
    for (x, y), r in zip(combinations(range(8), 2), fixed):
        want = brute_tau(rows, x, y)
        assert (r is None and want is None) or r == pytest.approx(want, abs=1e-12), (x, y)


def test_inversions():
    pick = np.random.default_rng(2)
    for n in (0, 1, 2, 3, 17, 64, 200):
        ranks = pick.integers(0, max(1, n // 2) + 1, n)
        assert concordance.inversions(ranks) == sum(int((ranks[i + 1:] < ranks[i]).sum()) for i in range(n))


def test_kendall_of_empty_and_single_columns(spark):
    assert concordance.kendall_pairs(spark.createDataFrame([], "a double, b double")) == [None]
    assert concordance.kendall_pairs(spark.createDataFrame([(1.0,)], "a double")) == []


def test_inversions_of_any_length_and_of_large_numbers():
    draw = np.random.default_rng(3)
    for n in (0, 1, 2, 15, 16, 17, 33, 100, 700):
        for most in (1, 3, 50, 1 << 29, 1 << 60):
            ranks = draw.integers(0, most, n)
            want = sum(int((ranks[i] > ranks[i + 1:]).sum()) for i in range(n))
            assert concordance.inversions(ranks) == want
