import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession
    session = (SparkSession.builder.master("local[8]").appName("tests").config("spark.sql.shuffle.partitions", "2")
               .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
               .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def edge(spark):
    """The small edge tables by name."""
    make = spark.createDataFrame
    return {
        "empty": make([], "a double, b string"),
        "one_row": make([(1.5, "x")], "a double, b string"),
        "all_null": make([(None, None)] * 5, "a double, b string"),
        "constant": make([(1.0, 2.0), (1.0, 3.0), (1.0, 5.0)], "a double, b double"),
        "nan_inf": make([(float("nan"),), (float("inf"),), (float("-inf"),), (None,), (1.0,)], "a double"),
        "ties": make([(3,), (2,), (3,), (2,), (9,)], "v int"),
        "ages": make([(25, "John"), (30, "Jane"), (35, "Bob"), (100, "Alice"), (28, "Charlie")], "age int, name string"),
    }
