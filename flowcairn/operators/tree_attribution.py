"""Exact Shapley values of tree models, by the covers of their nodes.

What a tree would answer with only some features known: at a split on an unknown feature both sides count
by the share of training rows they hold. A leaf is reached along a path with few distinct features; each
of them lets a row pass (1) or not (0), and lets the share of rows pass if it is unknown. The Shapley value
of a feature at this leaf is a sum over the sizes of the sets of known others, and those sums are the
coefficients of a product of one linear factor per feature. So the cost grows with leaves times depth
squared, never with the number of sets. A batch of rows is worked off leaf by leaf, all rows at once.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowcairn.functions.numeric import quoted
from flowcairn.session import ensure_checkpoint_dir


@dataclass
class TreeArrays:
    """A binary tree: rows with ``feature <= threshold`` go to ``left``; leaves have ``left = -1``."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    cover: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        at, rows = np.zeros(len(x), dtype=np.int64), np.arange(len(x))
        while (inner := self.left[at] >= 0).any():
            below = x[rows, np.maximum(self.feature[at], 0)] <= self.threshold[at]
            at = np.where(inner, np.where(below, self.left[at], self.right[at]), at)
        return self.value[at]

    def expected(self) -> float:
        leaf = self.left < 0
        return float((self.value[leaf] * self.cover[leaf]).sum() / self.cover[0])

    def leaves(self):
        """(value, [(feature, low, high, share)]) of each leaf: bounds of the path per feature, low < x <= high."""
        open_ = [(0, {})]
        while open_:
            node, path = open_.pop()
            if self.left[node] < 0:
                yield self.value[node], [(f, *bounds) for f, bounds in path.items()]
                continue
            f, t = int(self.feature[node]), float(self.threshold[node])
            low, high, share = path.get(f, (-math.inf, math.inf, 1.0))
            for child, bounds in ((self.left[node], (low, min(high, t))), (self.right[node], (max(low, t), high))):
                part = self.cover[child] / self.cover[node] if self.cover[node] else 0.0
                open_.append((int(child), {**path, f: (*bounds, share * part)}))


def mllib_trees(model, score_class: int = 1) -> list[TreeArrays]:
    """Trees of a fitted MLlib tree model.

    Leaves hold the share of ``score_class`` (mean over the trees of a forest), or a boosted model's
    weighted predictions, whose sum is its margin. Covers are the training rows of a node. The node
    table is what the model writes of itself, a row per node.
    """
    spark = SparkSession.active()
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{model.uid}-nodes"
    model.write().overwrite().save(folder)
    nodes = spark.read.parquet(f"{folder}/data")
    if "nodeData" in nodes.columns:
        nodes = nodes.select("treeID", "nodeData.*")
    else:
        nodes = nodes.withColumn("treeID", F.lit(0))
    nodes = nodes.select(
        "treeID", "id", "prediction", "impurityStats", "rawCount", "leftChild", "rightChild",
        "split.featureIndex", "split.numCategories", F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"),
    ).toPandas()  # a row per node of the model
    weights = list(getattr(model, "treeWeights", [1.0]))
    boosted = type(model).__name__.startswith("GBT")
    out = []
    for tree, rows in nodes.sort_values("id").groupby("treeID"):
        if (rows["numCategories"] > 0).any():
            raise ValueError("splits on categories have no threshold")
        place = {int(i): n for n, i in enumerate(rows["id"])}
        if boosted or "Regression" in type(model).__name__:
            value = rows["prediction"].to_numpy(dtype=float) * weights[tree] / (1.0 if boosted else max(len(weights), 1))
        else:
            stats = np.stack(rows["impurityStats"].to_list())
            value = stats[:, score_class] / np.maximum(stats.sum(axis=1), 1e-300) / len(weights)
        child = lambda c: np.array([place.get(int(i), -1) for i in rows[c]])  # noqa: B023, E731
        out.append(TreeArrays(
            rows["featureIndex"].to_numpy(dtype=np.int64), rows["threshold"].to_numpy(dtype=float), child("leftChild"), child("rightChild"),
            value, rows["rawCount"].to_numpy(dtype=float),
        ))
    return out


def _attributions(leaves: list, x: np.ndarray) -> np.ndarray:
    out = np.zeros(x.shape)
    for value, path in leaves:
        d = len(path)
        if not d or value == 0.0:
            continue
        known = np.empty((d, len(x)))
        for i, (f, low, high, _) in enumerate(path):
            known[i] = (x[:, f] > low) & (x[:, f] <= high)
        share = np.array([p[3] for p in path])
        # Weight of a set of k known others among d features.
        weight = np.array([1.0 / (d * math.comb(d - 1, k)) for k in range(d)])
        # Products of the factors before and behind each feature, as coefficients by number of known features.
        before = [np.ones((1, len(x)))]
        for i in range(d - 1):
            before.append(_times(before[-1], share[i], known[i]))
        behind = np.ones((1, len(x)))
        for i in range(d - 1, -1, -1):
            rest = _product(before[i], behind)
            out[:, path[i][0]] += value * (known[i] - share[i]) * (weight[:, None] * rest).sum(axis=0)
            behind = _times(behind, share[i], known[i])
    return out


def _times(coefficients: np.ndarray, share: float, known: np.ndarray) -> np.ndarray:
    """A polynomial times (share + known t)."""
    out = np.zeros((len(coefficients) + 1, coefficients.shape[1]))
    out[:-1] += coefficients * share
    out[1:] += coefficients * known
    return out


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(a) + len(b) - 1, a.shape[1]))
    for i in range(len(a)):
        out[i : i + len(b)] += a[i] * b
    return out


def expected_score(trees: list[TreeArrays]) -> float:
    """Mean score over the training rows: what the attributions of a row start from."""
    return float(sum(t.expected() for t in trees))


def _numbers(df: DataFrame, features: list[str], row_id: str) -> DataFrame:
    return df.select(F.col(quoted(row_id)).alias(row_id), F.array(*[F.col(quoted(c)).cast("double") for c in features]).alias("_x"))


def _matrix(values: pd.Series, features: int) -> np.ndarray:
    return np.stack(values.to_list()).astype(np.float64) if len(values) else np.zeros((0, features))


def tree_scores(trees: list[TreeArrays], df: DataFrame, features: list[str], row_id: str) -> DataFrame:
    """(row_id, margin): the sum of all trees."""
    shared = df.sparkSession.sparkContext.broadcast(trees)  # the nodes of the model

    def run(batches):
        for batch in batches:
            x = _matrix(batch["_x"], len(features))
            yield pd.DataFrame({row_id: batch[row_id], "margin": sum((t.scores(x) for t in shared.value), np.zeros(len(x)))})

    kind = df.schema[row_id].dataType.simpleString()
    return _numbers(df, features, row_id).mapInPandas(run, f"{quoted(row_id)} {kind}, margin double")


def tree_shapley(trees: list[TreeArrays], df: DataFrame, features: list[str], row_id: str) -> DataFrame:
    """(row_id, feature, attribution) of every row; a row's attributions and ``expected_score`` add up to its score.

    Values must be present. Rows that share an id are explained each.
    """
    shared = df.sparkSession.sparkContext.broadcast([leaf for t in trees for leaf in t.leaves()])  # the paths of the model

    def run(batches):
        for batch in batches:
            for a in range(0, len(batch), 2048):
                some = batch.iloc[a : a + 2048]
                found = _attributions(shared.value, _matrix(some["_x"], len(features)))
                yield pd.DataFrame({
                    row_id: some[row_id].repeat(len(features)).array, "feature": features * len(some), "attribution": found.ravel(),
                })

    kind = df.schema[row_id].dataType.simpleString()
    return _numbers(df, features, row_id).mapInPandas(run, f"{quoted(row_id)} {kind}, feature string, attribution double")
