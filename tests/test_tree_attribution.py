"""Exact tree attributions against all subsets of features, for every kind of tree model."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from flowcairn.operators.tree_attribution import expected_score, mllib_trees, tree_scores, tree_shapley
from flowcairn.plans.models import train_model

RANDOM = random.Random(21)
FEATURES = [f"f{i}" for i in range(8)]


@pytest.fixture(scope="module")
def rows(spark):
    data = []
    for i in range(400):
        x = [RANDOM.gauss(0, 1) for _ in range(7)]
        data.append((i, *x, 3.0, int(x[0] * x[1] + x[2] - 0.5 * x[3] > RANDOM.gauss(0, 0.3))))
    schema = ", ".join(["id long", *[f"{f} double" for f in FEATURES], "label int"])
    return spark.createDataFrame(data, schema).cache()


def given(tree, x, known, node=0):
    """The tree's answer with only ``known`` features."""
    if tree.left[node] < 0:
        return tree.value[node]
    left, right = tree.left[node], tree.right[node]
    if tree.feature[node] in known:
        return given(tree, x, known, left if x[tree.feature[node]] <= tree.threshold[node] else right)
    return (tree.cover[left] * given(tree, x, known, left) + tree.cover[right] * given(tree, x, known, right)) / tree.cover[node]


def brute(trees, x):
    n = len(FEATURES)
    answer = {s: sum(given(t, x, s) for t in trees) for k in range(n + 1) for s in map(frozenset, itertools.combinations(range(n), k))}
    return [
        sum(
            math.factorial(len(s)) * math.factorial(n - len(s) - 1) / math.factorial(n) * (answer[s | {i}] - answer[s])
            for s in answer if i not in s
        )
        for i in range(n)
    ]


@pytest.mark.parametrize(("name", "params"), [("DT", {"max_depth": 6}), ("RF", {"n_estimators": 4, "max_depth": 4}), ("GBT", {"n_estimators": 5, "max_depth": 3})])
def test_equals_all_subsets(rows, name, params):
    trained = train_model(name, rows, FEATURES, params=params)
    trees = mllib_trees(trained.model)
    some = rows.where("id < 6")
    found = {(r["id"], r["feature"]): r["attribution"] for r in tree_shapley(trees, some, FEATURES, "id").collect()}
    margins = {r["id"]: r["margin"] for r in tree_scores(trees, some, FEATURES, "id").collect()}
    score = {r["id"]: r["score"] for r in trained.score(some).collect()}
    for row in some.collect():
        own = [found[row["id"], f] for f in FEATURES]
        assert own == pytest.approx(brute(trees, [row[f] for f in FEATURES]), abs=1e-12)
        assert sum(own) + expected_score(trees) == pytest.approx(margins[row["id"]])
        assert own[7] == 0.0
        shown = 1 / (1 + math.exp(-2 * margins[row["id"]])) if name == "GBT" else margins[row["id"]]
        assert shown == pytest.approx(score[row["id"]])


def test_base_is_the_mean_over_the_training_rows(rows):
    trained = train_model("DT", rows, FEATURES, params={"max_depth": 5})
    trees = mllib_trees(trained.model)
    mean = tree_scores(trees, rows, FEATURES, "id").agg(F.avg("margin")).first()[0]
    assert expected_score(trees) == pytest.approx(mean)


def test_no_rows_and_repeated_rows(rows):
    trees = mllib_trees(train_model("DT", rows, FEATURES, params={"max_depth": 3}).model)
    assert tree_shapley(trees, rows.where("id < 0"), FEATURES, "id").collect() == []
    twice = rows.where("id = 1").select("id", *FEATURES, F.lit("x").alias("feature"))
    assert tree_shapley(trees, twice.union(twice), FEATURES, "id").count() == 16
