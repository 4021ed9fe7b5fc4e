"""Spark ML estimators by problem and name, with the defaults of the models they stand for.

An exact counterpart does not exist for kernel SVMs: the RBF kernel is approximated by random Fourier features. Boosted trees
are those of `boosting`.
"""

from __future__ import annotations

import math
import random

from pyspark.ml import Estimator
from pyspark.ml.classification import (DecisionTreeClassifier, LinearSVC, LogisticRegression, NaiveBayes,
                                       OneVsRest, RandomForestClassifier)
from pyspark.ml.clustering import KMeans
from pyspark.ml.regression import (DecisionTreeRegressor, LinearRegression, RandomForestRegressor)
from pyspark.sql import DataFrame, functions as F

from colsift.functions.values import ref
from colsift.ml.boosting import Boosting

SEED = 42
TREE_DEPTH = 10
FOURIER_FEATURES = 64


def _logistic(n_classes, n_rows, **options):
    # a penalty constant of 1 on the summed loss is 1 / n on the mean loss
    return LogisticRegression(regParam=1 / max(n_rows, 1), standardization=False, **options)


def _svm(n_classes, n_rows, **options):
    base = LinearSVC(regParam=1 / max(n_rows, 1), standardization=False, **options)
    return base if n_classes <= 2 else OneVsRest(classifier=base)


def _boosted(n_classes, n_rows, **options):
    return Boosting(classes=n_classes, **options)


MODELS = {
    "classification": {
        "logistic_regression": _logistic,
        "random_forest": lambda classes, rows, **o: RandomForestClassifier(**{"numTrees": 100, "maxDepth": TREE_DEPTH, "seed": SEED, **o}),
        "decision_tree": lambda classes, rows, **o: DecisionTreeClassifier(**{"maxDepth": TREE_DEPTH, "seed": SEED, **o}),
        "svm": _svm,
        "xgboost": _boosted,
        "naive_bayes": lambda classes, rows, **o: NaiveBayes(modelType="gaussian", **o),
    },
    "regression": {
        "linear_regression": lambda classes, rows, **o: LinearRegression(solver="normal", **o),
        "random_forest": lambda classes, rows, **o: RandomForestRegressor(**{"numTrees": 100, "maxDepth": TREE_DEPTH, "seed": SEED, **o}),
        "decision_tree": lambda classes, rows, **o: DecisionTreeRegressor(**{"maxDepth": TREE_DEPTH, "seed": SEED, **o}),
        "svr": lambda classes, rows, **o: LinearRegression(**{"loss": "huber", "solver": "l-bfgs", "regParam": 1 / max(rows, 1), **o}),
        "xgboost": _boosted,
    },
    "clustering": {
        "kmeans": lambda classes, rows, **o: KMeans(**{"k": 8, "seed": SEED, **o}),
    },
}

KERNEL_MODELS = {"svm", "svr"}

# Names of the tuning options users know and the parameters Spark has for them.
OPTION_NAMES = {"n_estimators": {"random_forest": "numTrees", "xgboost": "maxIter"},
                "max_depth": {"random_forest": "maxDepth", "decision_tree": "maxDepth", "xgboost": "maxDepth"},
                "learning_rate": {"xgboost": "stepSize"}, "n_clusters": {"kmeans": "k"},
                "random_state": {"random_forest": "seed", "decision_tree": "seed", "xgboost": "seed", "kmeans": "seed"}}


def model_name(text: str) -> str:
    return text.lower().replace(" ", "_")


def estimator(problem: str, name: str, n_classes: int = 2, n_rows: int = 1, **options) -> Estimator:
    """The estimator for a name such as 'Random Forest'; unknown names and options are refused."""
    key = model_name(name)
    if key not in MODELS.get(problem, {}):
        raise ValueError(f"unknown {problem} model: {name}")
    renamed = {}
    for option, value in options.items():
        spark_name = OPTION_NAMES.get(option, {}).get(key)
        if option in OPTION_NAMES and spark_name is None:
            raise ValueError(f"{key} has no option {option}")
        renamed[spark_name or option] = value
    return MODELS[problem][key](n_classes, n_rows, **renamed)


def fourier_features(df: DataFrame, columns: list[str], size: int = FOURIER_FEATURES, seed: int = SEED) -> DataFrame:
    """Random cosine features whose inner product approximates the RBF kernel with gamma = 1 / number of columns.

    The inputs are scaled to unit variance, for which this gamma is the usual default.
    """
    draw = random.Random(seed)
    gamma = 1 / len(columns)
    waves = []
    for i in range(size):
        phase = F.lit(draw.uniform(0, 2 * math.pi))
        for c in columns:
            phase = phase + ref(c) * F.lit(draw.gauss(0, math.sqrt(2 * gamma)))
        waves.append((F.cos(phase) * math.sqrt(2 / size)).alias(f"wave{i}"))
    rest = [ref(c) for c in df.columns if c not in columns]
    return df.select(*waves, *rest)
