"""Classifiers by name, trained and scored on plain feature columns."""

from __future__ import annotations

import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any

from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowcairn.functions.numeric import quoted
from flowcairn.operators.boosting import SoftmaxBoosting, fit_softmax_boosting
from flowcairn.operators.neighbors import knn_classify, vector_of

# Long names of the registry's short names.
ALIASES = {
    "logistic_regression": "LR",
    "logistic regression": "LR",
    "decision_tree": "DT",
    "decision tree": "DT",
    "random_forest": "RF",
    "random forest": "RF",
    "xgboost": "GBT",
    "mlp": "CNN",
}
# The parameters tried per model when tuning.
TUNING_GRIDS: dict[str, dict[str, list[Any]]] = {
    "LR": {"C": [0.1, 1.0, 10.0], "max_iter": [1000]},
    "KNN": {"n_neighbors": [3, 5, 7], "weights": ["uniform", "distance"]},
    "DT": {"max_depth": [5, 10, 20, None], "min_samples_split": [2, 5, 10]},
    "RF": {"n_estimators": [50, 100, 200], "max_depth": [10, 20, None]},
    "GBT": {"n_estimators": [50, 100], "learning_rate": [0.01, 0.1]},
    "TabNet": {"hidden": [8, 16, 32]},
    "CNN": {"lr": [0.001, 0.01], "epochs": [10, 20]},
}
PART_VALUES = 1 << 18  # feature values of a training partition; a short table in few parts spares every pass its idle tasks
SUMS_BYTES = 1 << 28  # MLlib's limit (maxMemoryInMB) of the sums that a task holds for a group of nodes
MLLIB_MAX_DEPTH = 30  # deepest tree MLlib grows; stands in for "no limit"


def canonical_name(name: str) -> str:
    """Registry key of a model name, long or short."""
    return ALIASES.get(name.lower(), name)


def _depth(p: dict) -> int:
    return min(p.get("max_depth") or MLLIB_MAX_DEPTH, MLLIB_MAX_DEPTH)


def _per_node(p: dict) -> int:
    return max(1, int(p.get("min_samples_split", 2)) // 2)


def _logistic(p, features, classes, rows, common, weight):
    # Ridge strength 1/C against the summed loss; MLlib minimises the mean loss.
    penalty = 1.0 / (float(p.get("C", 1.0)) * max(rows, 1))
    return LogisticRegression(
        maxIter=int(p.get("max_iter", 1000)), regParam=penalty, standardization=False, **common, **weight
    )


def _tree(p, features, classes, rows, common, weight):
    return DecisionTreeClassifier(
        maxDepth=_depth(p), minInstancesPerNode=_per_node(p), impurity=p.get("criterion", "gini"), seed=p["seed"], **common, **weight
    )


def _forest(p, features, classes, rows, common, weight):
    return RandomForestClassifier(
        numTrees=int(p.get("n_estimators", 100)), maxDepth=_depth(p), minInstancesPerNode=_per_node(p), seed=p["seed"], **common, **weight
    )


def _boosted(p, features, classes, rows, common, weight):
    # These two are parameters of the estimator, but not of its constructor.
    probability, raw = common["probabilityCol"], common["rawPredictionCol"]
    common = {c: n for c, n in common.items() if n not in (probability, raw)}
    return GBTClassifier(
        maxIter=int(p.get("n_estimators", 100)), maxDepth=min(p.get("max_depth") or 6, MLLIB_MAX_DEPTH),
        stepSize=float(p.get("learning_rate", 0.3)), seed=p["seed"], **common, **weight,
    ).setProbabilityCol(probability).setRawPredictionCol(raw)


def _network(p, features, classes, rows, common, weight):
    # Multilayer perceptron in the slot of the tabular networks; it takes no row weights.
    hidden = int(p.get("hidden", 32))
    # A learning rate belongs to gradient descent; without one the quasi-Newton solver is used.
    solver = {"solver": "gd", "stepSize": float(p["lr"])} if "lr" in p else {}
    return MultilayerPerceptronClassifier(
        layers=[features, 2 * hidden, hidden, classes], maxIter=5 * int(p.get("epochs", 20)), seed=p["seed"], **solver, **common,
    )


def _parts(key: str, p: dict, rows: int, features: int, classes: int, cores: int, most: int) -> int:
    """Partitions of a training table: by its feature values, and no more than ``most``.

    A level of a tree or forest sends the sums of all its nodes once per task. So a forest has two tasks a core at
    least, and where a tree's sums outweigh a part's values, as in deep trees, its tasks follow the cores.
    """
    by_values = -(-rows * features // PART_VALUES)
    if key == "RF":
        return min(most, max(2 * cores, by_values))
    if key == "DT":
        nodes = min(1 << min(_depth(p), 30), max(1, rows))
        sums = min(SUMS_BYTES, nodes * features * 32 * (classes + 1) * 8)  # of 32 bins a feature
        by_values = min(by_values, max(2 * cores, 8 * rows * features // sums))
    return min(most, max(1, by_values))


BUILDERS = {"LR": _logistic, "DT": _tree, "RF": _forest, "GBT": _boosted, "CNN": _network, "TabNet": _network}
REGISTRY = [*BUILDERS, "KNN"]


@dataclass
class Trained:
    """A fitted model with the columns it reads; ``score`` works on batch tables and streams."""

    name: str
    features: list[str]
    model: Any
    train_seconds: float
    params: dict = field(default_factory=dict)

    def score(self, df: DataFrame, row_id: str | None = None) -> DataFrame:
        """Add ``prediction`` (int) and ``score``, the probability of class 1."""
        if isinstance(self.model, KnnState):
            return self.model.score(df, row_id)
        if isinstance(self.model, SoftmaxBoosting):
            return self.model.score(df)
        out = self.model.transform(_assemble(df, self.features))
        return out.withColumns(
            {"score": vector_to_array("_probability")[1], "prediction": F.col("_prediction").cast("int")}
        ).drop("_features", "_raw", "_probability", "_prediction")


@dataclass
class KnnState:
    """The training rows of a nearest-neighbour classifier."""

    rows: DataFrame
    features: list[str]
    label: str
    row_id: str
    k: int
    weights: str

    def score(self, df: DataFrame, row_id: str | None) -> DataFrame:
        row_id = row_id or self.row_id
        voted = knn_classify(
            self.rows, df.withColumn("_vec", vector_of(self.features)), "_vec", self.label, self.row_id, row_id, self.k, self.weights
        )
        share = F.when(F.col("prediction") == 1, F.col("vote_share")).otherwise(1.0 - F.col("vote_share"))
        return df.join(voted.withColumn("score", share).drop("vote_share"), row_id)


def _assemble(df: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="_features", handleInvalid="error").transform(df)


def train_model(
    name: str,
    train: DataFrame,
    features: list[str],
    label: str = "label",
    params: dict | None = None,
    weight: str | None = None,
    row_id: str | None = None,
    classes: int = 2,
    seed: int = 42,
) -> Trained:
    """Fit a fresh model of the registry; the training rows should be cached by the caller."""
    key = canonical_name(name)
    p = {"seed": seed, **(params or {})}
    start = time.perf_counter()
    if key == "KNN":
        if row_id is None:
            raise ValueError("k-NN needs a row id")
        rows = train.select(F.col(quoted(row_id)), F.col(quoted(label)).cast("int").alias(label), vector_of(features).alias("_vec"))
        model: Any = KnnState(rows, features, label, row_id, int(p.get("n_neighbors", 5)), p.get("weights", "uniform"))
    elif key == "GBT" and classes > 2:  # MLlib's boosted trees take two classes
        model = fit_softmax_boosting(
            train, features, label, classes, int(p.get("n_estimators", 100)), p.get("max_depth") or 6, float(p.get("learning_rate", 0.3)), weight
        )
    elif key in BUILDERS:
        common = {
            "featuresCol": "_features", "labelCol": "_label", "predictionCol": "_prediction",
            "probabilityCol": "_probability", "rawPredictionCol": "_raw",
        }
        weighted = {"weightCol": weight} if weight else {}
        rows, top = train.agg(F.count(F.lit(1)), F.max(F.col(quoted(label)).cast("double"))).first()
        estimator = BUILDERS[key](p, len(features), classes, rows, common, weighted)
        # Trees look for the largest label first, which would deal the table twice; they are told of it.
        told = key in ("DT", "RF") and top is not None and 0 <= top < 100 and top == int(top)  # MLlib refuses others
        known = {"metadata": {"ml_attr": {"type": "nominal", "num_vals": int(top) + 1}}} if told else {}
        # Dealt by content at every size, so a model does not change with the layout of its table; vectors are made after that.
        content = F.xxhash64(*[F.col(quoted(c)) for c in [*features, label]])
        parts = int(train.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        parts = _parts(key, p, rows, len(features), classes, train.sparkSession.sparkContext.defaultParallelism, parts)
        plain = train.select(*[F.col(quoted(c)) for c in dict.fromkeys([*features, label, *([weight] if weight else [])])])
        data = plain.repartition(parts, content).withColumn("_label", F.col(quoted(label)).cast("double").alias("_label", **known))
        data = _assemble(data, features).select("_features", "_label", *([weight] if weight else []))
        model = estimator.fit(data)
    else:
        raise KeyError(f"unknown model {name!r}; known are {REGISTRY}")
    return Trained(key, features, model, time.perf_counter() - start, p)


def train_all(
    names: list[str], train: DataFrame, features: list[str], label: str = "label", row_id: str | None = None, parallel: int = 4,
    **options,
) -> dict[str, Trained]:
    """Train several models on one cached table, ``parallel`` of them at a time."""
    cached = train.persist()
    try:
        with ThreadPoolExecutor(max_workers=max(1, parallel)) as pool:
            fitted = pool.map(lambda n: train_model(n, cached, features, label, row_id=row_id, **options), names)
            return dict(zip(names, fitted))
    finally:
        if "KNN" not in [canonical_name(n) for n in names]:
            cached.unpersist()


def importances(trained: Trained, spark) -> DataFrame:
    """Native importances of trees, or coefficients of a linear model: (algo, feature, importance)."""
    model = trained.model
    if isinstance(model, SoftmaxBoosting):
        values = model.importances
    elif hasattr(model, "featureImportances"):
        values = model.featureImportances.toArray()
    elif hasattr(model, "coefficients"):
        values = model.coefficients.toArray()
    else:
        raise ValueError(f"{trained.name} has no native importances")
    rows = [(trained.name, f, float(v)) for f, v in zip(trained.features, values)]
    return spark.createDataFrame(rows, "algo string, feature string, importance double")


def is_native(trained: Trained) -> bool:
    """Whether a model explains itself by importances or coefficients."""
    return isinstance(trained.model, SoftmaxBoosting) or hasattr(trained.model, "featureImportances") or hasattr(trained.model, "coefficients")


