"""Train, compare and apply models on one table."""

from __future__ import annotations

import json
import time
from dataclasses import dataclass, field

from pyspark.ml import Model
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, functions as F

from colsift.functions.values import ref
from colsift.ml import density, metrics, models, prepare
from colsift.plans.session import cut_lineage, discard, small_frame, spread_rows
from colsift.plans.stats import TableStats

SMALL_SAMPLE = 1000

# The models recommended per problem, below and from 1000 rows on.
RECOMMENDED = {
    ("classification", True): ["Logistic Regression", "Decision Tree", "Random Forest"],
    ("classification", False): ["Random Forest", "XGBoost", "SVM"],
    ("regression", True): ["Linear Regression", "Decision Tree", "Random Forest"],
    ("regression", False): ["Random Forest", "XGBoost", "SVR"],
    ("clustering", True): ["KMeans", "DBSCAN"],
    ("clustering", False): ["KMeans", "DBSCAN"],
}


@dataclass
class Trained:
    name: str
    model: Model | None
    predictions: DataFrame
    metrics: DataFrame
    training_seconds: float
    scaler: prepare.Scaler
    importance: DataFrame | None = None
    options: dict = field(default_factory=dict)


class ModelBench:
    """Prepares a table once and trains models on the same split.

    The prepared table is written to the shared folder; `close`, or leaving a `with` block, removes it.
    """

    def __init__(self, df: DataFrame, target: str | None, problem: str, features: list[str] | None = None,
                 split_key: str | None = None):
        self.target, self.problem, self.split_key = target, problem, split_key
        prepared = prepare.prepare(df, target, problem, features)
        # encoded once: every fit passes over the files several times
        prepared.df = cut_lineage(prepared.df, "prepared")
        self.prepared = prepared
        self._fills: dict[str, float] | None = None
        self._parts: dict[tuple, tuple] = {}

    def __enter__(self) -> "ModelBench":
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        """Remove the prepared table; results not yet computed from it are lost."""
        discard(self.prepared.df)

    @property
    def spark(self):
        return self.prepared.df.sparkSession

    def split(self, test_size: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame | None]:
        if not self.prepared.has_label:
            return self.prepared.df, None
        return prepare.split(self.prepared.df, test_size, seed, self.split_key)

    def _scaled(self, test_size: float, seed: int):
        if (test_size, seed) not in self._parts:
            train, test = self.split(test_size, seed)
            scaler = prepare.Scaler.fit(train, self.prepared.features)
            self._parts[test_size, seed] = (scaler.transform(train), None if test is None else scaler.transform(test), scaler)
        return self._parts[test_size, seed]

    def _assembled(self, df: DataFrame, name: str) -> DataFrame:
        columns = self.prepared.features
        if name in models.KERNEL_MODELS:
            df = models.fourier_features(df, columns)
            columns = [c for c in df.columns if c.startswith("wave")]
        keep = [prepare.LABEL] if prepare.LABEL in df.columns else []
        return VectorAssembler(inputCols=columns, outputCol=prepare.FEATURES).transform(df).select(
            prepare.FEATURES, *keep)

    def train(self, name: str, test_size: float = 0.2, seed: int = 42, **options) -> Trained:
        key = models.model_name(name)
        train, test, scaler = self._scaled(test_size, seed)
        started = time.time()
        if key == "dbscan":
            if self.problem != "clustering":
                raise ValueError(f"unknown {self.problem} model: {name}")
            clustered = density.dbscan(train, self.prepared.features, **options)
            seconds = time.time() - started
            scored = clustered.agg(F.lit(None).cast("double").alias("inertia"),
                                   F.count_distinct("prediction").alias("n_clusters"))
            return Trained(key, None, clustered, scored, seconds, scaler, options=options)
        has_label = self.problem != "clustering" and self.prepared.has_label
        n_rows, top = train.agg(F.count("*"), F.max(prepare.LABEL) if has_label else F.lit(None)).first()
        # fits keep the rows in their own form, wide or with a number for each tree; they are dealt out while they are narrow
        data = self._assembled(spread_rows(train, n_rows), key)
        if self.problem == "clustering":
            model = models.estimator(self.problem, name, **options).fit(data)
            seconds = time.time() - started
            predictions = model.transform(data)
            scored = metrics.clustering_metrics(predictions, prepare.FEATURES, model.clusterCenters())
            return Trained(key, model, predictions, scored, seconds, scaler, options=options)
        if not self.prepared.has_label:
            raise ValueError(f"{self.problem} needs a target column")
        n_classes = int(top) + 1 if self.problem == "classification" else 0
        model = models.estimator(self.problem, name, n_classes, n_rows, **options).fit(data)
        seconds = time.time() - started
        n_test = round(n_rows * test_size / (1 - test_size)) if test_size < 1 else n_rows
        predictions = model.transform(self._assembled(spread_rows(test, n_test), key)).select(prepare.LABEL, "prediction")
        score = metrics.classification_metrics if self.problem == "classification" else metrics.regression_metrics
        return Trained(key, model, predictions, score(predictions), seconds, scaler, self._importance(model), options)

    def _importance(self, model: Model, n: int = 10) -> DataFrame | None:
        """The features a tree model used most."""
        if not hasattr(model, "featureImportances"):
            return None
        weights = sorted(zip(model.featureImportances.toArray().tolist(), self.prepared.features), key=lambda t: (-t[0], t[1]))
        return small_frame(self.spark, [{"rank": i + 1, "feature": f, "importance": w} for i, (w, f) in enumerate(weights[:n])],
                           "rank bigint, feature string, importance double")

    def compare(self, names: list[str]) -> DataFrame:
        """One row per model, the best first: by accuracy, R2 or silhouette; models that fail come last, with their error.

        `metrics` and `options` are JSON; `reason` says of the best model what it is best by.
        """
        measure = {"classification": "accuracy", "regression": "r2", "clustering": "silhouette"}[self.problem]
        rows = []
        for name in names:
            row = {"model_type": models.model_name(name), "score": None, "metrics": None, "options": None, "error": None}
            try:
                trained = self.train(name)
                found = trained.metrics.first().asDict()
                row["score"] = self._silhouette(trained) if self.problem == "clustering" else found[measure]
                row.update(metrics=json.dumps(found), options=json.dumps(trained.options), training_seconds=trained.training_seconds)
            except Exception as error:  # a model that cannot be trained must not end the comparison
                row["error"] = f"{type(error).__name__}: {error}"[:500]
            rows.append(row)
        rows.sort(key=lambda r: (r["error"] is not None, -(r["score"] if r["score"] is not None else float("-inf"))))
        for i, r in enumerate(rows):
            best = i == 0 and r["score"] is not None
            r.update(rank=i + 1, is_best=best, reason=f"highest {measure} ({r['score']:.4f}) of {len(rows)} models" if best else None)
        return small_frame(self.spark, rows, "rank bigint, model_type string, score double, is_best boolean, training_seconds double, "
                                             "metrics string, options string, error string, reason string")

    def _silhouette(self, trained: Trained) -> float | None:
        predictions = trained.predictions
        if prepare.FEATURES not in predictions.columns:
            predictions = VectorAssembler(inputCols=self.prepared.features, outputCol=prepare.FEATURES).transform(predictions)
        if trained.metrics.first()["n_clusters"] < 2:
            return None
        return ClusteringEvaluator().evaluate(predictions.withColumn("prediction", F.col("prediction").cast("int")))

    def _medians(self) -> dict[str, float]:
        if self._fills is None:
            features = self.prepared.features
            stats = TableStats(self.prepared.df.select(*[ref(c) for c in features])).need_quantiles(0.5)
            self._fills = {c: stats.fact(c, "q0.5") for c in features}
        return self._fills

    def predict(self, trained: Trained, new: DataFrame) -> DataFrame:
        """Predictions for new rows; a label not seen in training counts as the first one, a gap as the fitted median."""
        for c, levels in self.prepared.levels.items():
            new = prepare.apply_codes(new, c, levels, unseen=0)
        types = {f.name: f.dataType for f in new.schema}
        features = self.prepared.features
        rest = [ref(c) for c in new.columns if c not in features]
        # gaps take the median of the prepared table, which is that of the training columns
        fills = self._medians()
        numeric = new.select(*[F.coalesce(prepare._number(c, types[c]), F.lit(fills[c])).alias(c) for c in features], *rest)
        scaled = trained.scaler.transform(numeric)
        if trained.name in models.KERNEL_MODELS:
            waves = models.fourier_features(scaled, features)
            columns = [c for c in waves.columns if c.startswith("wave")]
            ready = VectorAssembler(inputCols=columns, outputCol=prepare.FEATURES).transform(waves)
        else:
            ready = VectorAssembler(inputCols=features, outputCol=prepare.FEATURES).transform(scaled)
        found = trained.model.transform(ready).select(*[ref(c) for c in new.columns if c not in features], "prediction")
        return self._decoded(found, "prediction")

    def _decoded(self, df: DataFrame, column: str) -> DataFrame:
        """Class codes of a numeric target back to its values."""
        if not self.prepared.decode:
            return df
        return prepare.recode(df, column, self.prepared.target_levels, "code", "level")

    def test_data(self, test_size: float = 0.2, seed: int = 42) -> DataFrame | None:
        """The held-out rows with their target."""
        test = self.split(test_size, seed)[1]
        return test if test is None else self._decoded(test, prepare.LABEL).withColumnRenamed(prepare.LABEL, self.target)

    def class_distribution(self) -> DataFrame:
        return self.prepared.df.groupBy(prepare.LABEL).agg(F.count("*").alias("cnt"))

    def analyze(self) -> DataFrame:
        """(kind, name, value): shape, class balance or target statistics, close feature pairs, recommended models."""
        df, features = self.prepared.df, self.prepared.features
        stats = TableStats(df).need("moments")
        rows = [("shape", "rows", stats.n_rows), ("shape", "features", len(features))]
        if self.prepared.has_label and self.problem == "classification":
            classes = self.class_distribution()
            # the target has few classes; their balance needs the extremes only
            low, high = classes.agg(F.min("cnt"), F.max("cnt")).first()
            rows.append(("class_balance", "max_to_min", high / low))
            rows.append(("issue", "Severe class imbalance detected", float(high / low > 10)))
        elif self.prepared.has_label and self.problem == "regression":
            rows += [("target", m, stats.fact(prepare.LABEL, m)) for m in ("mean", "std_pop", "min", "max")]
        close = stats.pairs_of(features).filter(F.abs("r") > 0.8).orderBy("pair").limit(5).collect()
        rows += [("correlated_pair", f"{r['c1']} ~ {r['c2']}", r["r"]) for r in close]
        recommended = RECOMMENDED[self.problem, stats.n_rows < SMALL_SAMPLE]
        rows += [("recommended_model", m, i + 1) for i, m in enumerate(recommended)]
        return small_frame(self.spark, [{"kind": k, "name": n, "value": float(v)} for k, n, v in rows],
                           "kind string, name string, value double")
