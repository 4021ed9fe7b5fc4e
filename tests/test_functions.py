import pytest
from pyspark.sql import functions as F

from colsift.functions import tests as normal
from colsift.functions import values


def column(spark, texts, expression):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("t"))).collect()]


def test_only_plain_numbers_convert(spark):
    texts = ["12", "1e3", " 7 ", "abc", "inf", "", None, "1_0", "0x1A", "1d", "2.5f", "nan", "-.5", "+3.", "--1"]
    got = column(spark, texts, values.to_number)
    assert got == [12.0, 1000.0, 7.0, None, float("inf"), None, None, None, None, None, None, None, -0.5, 3.0, None]


def test_lenient_number_scrapes_digits(spark):
    got = column(spark, ["$1,234.50", "abc", None, "-7 kg", "3+4j", "(2.5-1j)", "5"], values.lenient_number)
    assert got == [1234.5, 0.0, 0.0, -7.0, 3.0, 2.5, 5.0]


def test_text_steps(spark):
    assert column(spark, ["  USA  "], lambda c: values.standardize(c, ["strip", "lowercase"])) == ["usa"]
    assert column(spark, [" \tCafé, 1!\n"], lambda c: values.standardize(c, ["remove_special", "strip", "lowercase"])) == ["caf 1"]
    assert column(spark, ["a", " a", "a ", None], values.is_padded) == [False, True, True, None]
    with pytest.raises(ValueError):
        values.standardize(F.col("t"), ["shout"])


def test_value_classes(spark):
    got = column(spark, ["1", "1.5", "true", "2024-01-31", "x", None, "2024-02-30"], values.value_class)
    assert got == ["int", "float", "bool", "timestamp", "text", None, "text"]


def test_date_layouts(spark):
    from pyspark.sql import types as T
    got = column(spark, ["2024-02-30", "2024/03/01", "03/02/2024", "31 Jan 2024", "soon"],
                 lambda c: values.to_time(c, T.StringType()).cast("date").cast("string"))
    assert got == [None, "2024-03-01", "2024-03-02", "2024-01-31", None]


def test_shapiro_published_examples(spark):
    from colsift.operators.distribution import shapiro
    from colsift.plans.stats import TableStats
    weights = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]
    sample = [0.11, 7.87, 4.61, 10.14, 7.95, 3.14, 0.46, 4.43, 0.21, 4.75,
              0.71, 1.52, 3.24, 0.93, 0.42, 4.97, 9.53, 4.55, 0.47, 6.66]
    for data, w, p in ((weights, 0.79, 0.0067), (sample, 0.90047, 0.04209)):
        row = shapiro(TableStats(spark.createDataFrame([(float(v),) for v in data], "x double"))).first()
        assert row["w"] == pytest.approx(w, abs=2e-3 if w == 0.79 else 1e-4)
        assert row["p_value"] == pytest.approx(p, abs=1e-4)


def test_shapiro_weights_give_one_for_their_own_scores():
    for n in (3, 4, 7, 20, 500):
        a = normal.shapiro_weights(n)
        assert sum(x * x for x in a) == pytest.approx(1, abs=1e-6)
        assert a == pytest.approx([-x for x in reversed(a)])


def test_k2_published_example(spark):
    from colsift.operators.distribution import normality_k2
    from colsift.plans.stats import TableStats
    df = spark.createDataFrame([(float(v * v),) for v in (-2, -1, 0, 1, 2, 3) * 4], "x double")
    row = normality_k2(TableStats(df)).first()
    assert row["statistic"] == pytest.approx(3.92371918, abs=1e-6)
    assert row["p_value"] == pytest.approx(0.14059673, abs=1e-6)
