import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowcairn.operators.ordering import bucket_edges, global_rank, running_sums, shuffled_rank, with_buckets
from flowcairn.operators.quantiles import quantiles
from flowcairn.operators.splits import (
    cap_per_source, class_weights, random_split, sample_exact, stratified_folds, stratified_split, with_class_weight,
)


@pytest.fixture(scope="module")
def skewed(spark):
    """A label and a value that hold a third of all rows, and a missing label."""
    rng = random.Random(1)
    rows = []
    for i in range(600):
        label = "hot" if i % 3 == 0 else rng.choice(["a", "b", None])
        rows.append((i, label, 5.0 if i % 3 == 1 else rng.gauss(0, 10)))
    return spark.createDataFrame(rows, "id long, label string, x double")


def as_map(df, *cols):
    return {r["id"]: tuple(r[c] for c in cols) for r in df.collect()}


def test_shuffled_rank_is_a_permutation_and_stable(skewed):
    a = as_map(shuffled_rank(skewed, ["id"], 7, ["label"]), "label", "rank", "size")
    b = as_map(shuffled_rank(skewed.repartition(13, "x").orderBy("x"), ["id"], 7, ["label"]), "label", "rank", "size")
    assert a == b and len(a) == 600
    for label in {v[0] for v in a.values()}:
        ranks = sorted(v[1] for v in a.values() if v[0] == label)
        assert ranks == list(range(1, len(ranks) + 1))
        assert {v[2] for v in a.values() if v[0] == label} == {len(ranks)}


def test_running_sums_match_a_plain_sum(skewed):
    counts = skewed.groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    bucketed = with_buckets(counts, bucket_edges(counts, ["x"], 8))
    for prefix in (True, False):
        rows = running_sums(bucketed, [], "x_bucket", "x", {"upto": "n"}, prefix).collect()
        total = 0
        for r in sorted(rows, key=lambda r: r["x"], reverse=not prefix):
            total += r["n"]
            assert r["upto"] == total


def test_global_rank_orders_ties_once(skewed):
    got = global_rank(skewed, "x", "id").collect()
    assert sorted(r["rank"] for r in got) == list(range(1, 601))
    by_rank = sorted(got, key=lambda r: r["rank"])
    assert all(a["x"] >= b["x"] for a, b in zip(by_rank, by_rank[1:]))


@pytest.mark.parametrize("limit, bracket", [(10**9, 0), (0, 200_000), (0, 20), (0, 0)])
def test_quantiles_every_way(spark, skewed, limit, bracket):
    rng = np.random.default_rng(3)
    rows = [(float(v), None if i % 5 == 0 else float(i % 7), None, float("inf") if i == 3 else float(i)) for i, v in enumerate(rng.normal(size=500))]
    df = spark.createDataFrame(rows, "a double, b double, empty double, c double")
    probs = [0.001, 0.25, 0.5, 0.75, 0.999]
    got = quantiles(df, ["a", "b", "empty", "c"], probs, single_pass_rows=limit, bracket_rows=bracket)
    for i, name in enumerate(("a", "b")):
        values = [r[i] for r in rows if r[i] is not None]
        assert got[name] == pytest.approx(list(np.quantile(values, probs)))
    assert got["empty"] == [None] * 5
    assert got["c"] == pytest.approx(list(np.quantile([r[3] for r in rows if np.isfinite(r[3])], probs)))
    hot = quantiles(skewed, ["x"], probs, single_pass_rows=limit, bracket_rows=bracket)["x"]
    assert hot == pytest.approx(list(np.quantile([r["x"] for r in skewed.collect()], probs)))
    assert quantiles(df, ["a"], [0.5], "approx")["a"][0] == pytest.approx(np.median([r[0] for r in rows]), abs=0.05)


def test_split_and_folds_keep_shares(skewed):
    parts = stratified_split(skewed, "label", ["id"]).groupBy("label", "split").count().collect()
    for label in {r["label"] for r in parts}:
        n = sum(r["count"] for r in parts if r["label"] == label)
        train = sum(r["count"] for r in parts if r["label"] == label and r["split"] == "train")
        assert abs(train - 0.7 * n) <= 1
    folds = stratified_folds(skewed, "label", ["id"], 5).groupBy("label", "fold").count().collect()
    for label in {r["label"] for r in folds}:
        sizes = [r["count"] for r in folds if r["label"] == label]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1
    assert {r["fold"] for r in stratified_folds(skewed, "label", ["id"], 4, mode="hash").collect()} == {0, 1, 2, 3}
    with pytest.raises(ValueError):
        stratified_split(skewed, "label", ["id"], (0.5, 0.2, 0.2))
    with pytest.raises(ValueError):
        random_split(skewed, ["id"], (0.5, 0.2, 0.2))


def test_samples(skewed):
    assert sample_exact(skewed, ["id"], ratio=0.1).count() == 60
    assert sample_exact(skewed, ["id"], ratio=0.0001).count() == 1
    assert sample_exact(skewed, ["id"], n=7).count() == 7
    first = as_map(sample_exact(skewed, ["id"], n=50), "x")
    assert first == as_map(sample_exact(skewed.repartition(9), ["id"], n=50), "x")
    capped = cap_per_source(skewed, "label", ["id"], 20).groupBy("label").count().collect()
    assert all(r["count"] == 20 for r in capped)
    parts = as_map(random_split(skewed, ["id"]), "split")
    assert {v[0] for v in parts.values()} == {"train", "val", "test"}
    assert parts == as_map(random_split(skewed.repartition(5), ["id"]), "split")


def test_class_weights(spark):
    df = spark.createDataFrame([(0,)] * 9 + [(1,)], "label int")
    want = {0: 10 / 18, 1: 5.0}
    assert {r["label"]: r["weight"] for r in class_weights(df, "label").collect()} == pytest.approx(want)
    assert {r["label"]: r["weight"] for r in with_class_weight(df, "label").distinct().collect()} == pytest.approx(want)


def test_rank_keeps_rows_without_a_score(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", None), ("c", 3.0), ("d", float("nan")), ("e", 3.0)], "name string, score double")
    ranks = {r["name"]: r["rank"] for r in global_rank(df, "score", "name").collect()}
    assert sorted(ranks.values()) == [1, 2, 3, 4, 5] and ranks["a"] == 3 and {ranks["c"], ranks["e"]} == {1, 2}
