"""Softmax boosting: whole tables and single tasks give the same trees, losses fall, odd tables are defined."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowcairn.operators.boosting import _binned, fit_softmax_boosting
from flowcairn.plans.models import importances, is_native, train_model

RANDOM = random.Random(8)


@pytest.fixture(scope="module")
def rows(spark):
    data = []
    for i in range(900):
        y = i % 3
        data.append((i, y, RANDOM.gauss(2.0 * y, 1.0), RANDOM.gauss(-y, 2.0), RANDOM.random(), 1.0 + i % 2))
    return spark.createDataFrame(data, "id long, label int, a double, b double, noise double, w double").cache()


def test_distributed_equals_single_task(rows):
    one = fit_softmax_boosting(rows, ["a", "b", "noise"], "label", 3, rounds=12, depth=3, weight="w")
    many = fit_softmax_boosting(rows, ["a", "b", "noise"], "label", 3, rounds=12, depth=3, weight="w", block_rows=100, single_task_rows=0)
    assert len(one.rounds) == len(many.rounds) == 12
    for x, y in zip(one.rounds, many.rounds):
        for s, t in zip(x, y):
            assert (s.feature == t.feature).all() and (s.above == t.above).all()
            assert s.value == pytest.approx(t.value)
    losses = [h[1] for h in one.history]
    assert losses[0] == pytest.approx(math.log(3), abs=0.01) and all(a > b for a, b in zip(losses, losses[1:]))
    assert max(h[2] for h in one.history) < 1e-12


def test_first_round_is_the_plain_split(rows):
    """Root split of every class by brute force over all bins."""
    data = rows.toPandas()
    model = fit_softmax_boosting(rows, ["a", "b"], "label", 3, rounds=1, depth=1, learning_rate=1.0)
    bins = _binned(data[["a", "b"]].to_numpy(), model.edges, 63)
    share = np.bincount(data["label"]) / len(data)
    for k in range(3):
        g, h = (data["label"] == k) - share[k], np.full(len(data), share[k] * (1 - share[k]))
        best = (-1.0, None, None)
        for f in range(2):
            for cut in range(63):
                left = bins[:, f] <= cut
                if h[left].sum() >= 1 and h[~left].sum() >= 1:
                    gain = sum(g[s].sum() ** 2 / (h[s].sum() + 1) for s in (left, ~left)) - g.sum() ** 2 / (h.sum() + 1)
                    if gain > best[0] + 1e-12:
                        best = (gain, f, cut)
        tree = model.rounds[0][k]
        assert (tree.feature[0], tree.above[0]) == best[1:] and tree.gain[0] == pytest.approx(best[0])
        left = bins[:, best[1]] <= best[2]
        assert tree.value[1:3] == pytest.approx([g[left].sum() / (h[left].sum() + 1), g[~left].sum() / (h[~left].sum() + 1)])


def test_model_of_the_registry(rows):
    trained = train_model("xgboost", rows, ["a", "b", "noise"], params={"n_estimators": 15, "max_depth": 3}, classes=3)
    scored = trained.score(rows)
    assert scored.columns == [*rows.columns, "score", "prediction"]
    right = scored.agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
    assert right > 0.75 and is_native(trained)
    shares = {r["feature"]: r["importance"] for r in importances(trained, rows.sparkSession).collect()}
    assert sum(shares.values()) == pytest.approx(1.0) and shares["a"] > shares["noise"]
    stumps = train_model("GBT", rows.withColumn("label", (F.col("label") > 0).cast("int")), ["a"], params={"n_estimators": 2}, classes=2)
    assert hasattr(stumps.model, "trees")


def test_odd_tables(spark):
    schema = "label int, x double, y double"
    data = [(0, None, 1.0), (0, float("nan"), 1.0), (2, 5.0, 1.0), (2, math.inf, 1.0)] * 5
    model = fit_softmax_boosting(spark.createDataFrame(data, schema), ["x", "y"], "label", 3, rounds=3, depth=2)
    out = model.score(spark.createDataFrame([(0, None, None), (2, 5.0, 1.0)], schema)).collect()
    assert out[1]["prediction"] == 2 and all(0 <= r["score"] < 1e-3 for r in out)
    assert fit_softmax_boosting(spark.createDataFrame([], schema), ["x"], "label", 3).rounds == []
    same = fit_softmax_boosting(spark.createDataFrame([(1, 1.0, 1.0)] * 4, schema), ["x", "y"], "label", 3, rounds=2)
    assert same.score(spark.createDataFrame([(1, 9.0, None)], schema)).first()["prediction"] == 1
    for bad in (None, 7, -1):
        with pytest.raises(ValueError):
            fit_softmax_boosting(spark.createDataFrame([(bad, 1.0, 1.0)], schema), ["x"], "label", 3)


def test_trees_by_columns_reach_the_same_nodes():
    """Whole columns are compared; every row ends where it does step by step, at any depth."""
    from flowcairn.operators.boosting import Tree

    rng = np.random.default_rng(5)
    columns = rng.integers(0, 64, (5, 300)).astype(np.uint8)
    for depth in (1, 3, 9):
        tree = Tree.empty(depth)
        for node in range((1 << depth) - 1):
            if not node or (tree.feature[(node - 1) // 2] >= 0 and rng.random() < 0.8):
                tree.feature[node], tree.above[node] = rng.integers(5), rng.integers(10, 50)
        for levels in range(depth + 1):
            want = []
            for row in columns.T:
                at = 0
                for _ in range(levels):
                    if tree.feature[at] >= 0:
                        at = 2 * at + 1 + int(row[tree.feature[at]] > tree.above[at])
                want.append(at)
            assert tree.node_of(columns, levels).tolist() == want
