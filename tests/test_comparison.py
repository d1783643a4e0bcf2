import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowcairn.operators import decide, distribution, metrics, scores
from flowcairn.operators.neighbors import knn_classify, knn_join


def brute_ks(a, b):
    a, b = np.sort(a), np.sort(b)
    every = np.concatenate([a, b])
    return np.abs(np.searchsorted(a, every, "right") / len(a) - np.searchsorted(b, every, "right") / len(b)).max()


def two_samples(spark, a, b):
    return spark.createDataFrame([(float(v), 0) for v in a] + [(float(v), 1) for v in b], "x double, side int")


def test_ks_statistic_and_p_value(spark):
    rng = np.random.default_rng(0)
    for a, b in ((rng.normal(size=300), rng.normal(0.3, 1, 200)), (np.repeat([1.0, 2.0], 60), np.repeat([1.0, 3.0], 50))):
        row = distribution.ks_two_sample(two_samples(spark, a, b), ["x"], "side").first()
        d = brute_ks(a, b)
        lam = math.sqrt(len(a) * len(b) / (len(a) + len(b))) * d
        p = 2 * sum((-1) ** (j - 1) * math.exp(-2 * j * j * lam * lam) for j in range(1, 101))
        assert row["ks_statistic"] == pytest.approx(d) and row["ks_pvalue"] == pytest.approx(min(max(p, 0), 1), abs=1e-9)
    same = distribution.ks_two_sample(two_samples(spark, [1, 2, 3], [1, 2, 3]), ["x"], "side").first()
    assert same["ks_statistic"] == 0.0 and same["ks_pvalue"] == 1.0
    assert distribution.ks_two_sample(two_samples(spark, [1, 2], []), ["x"], "side").count() == 0


def test_similarity(spark):
    near = distribution.feature_similarity(two_samples(spark, [1, 2, 3, 4, 5], [1.1, 1.9, 3.2, 3.8, 5.1]), ["x"], "side").first()
    assert near["compatible"] and near["mean_diff"] < 0.5
    rng = np.random.default_rng(1)
    apart = distribution.feature_similarity(two_samples(spark, rng.normal(-10, 1, 200), rng.normal(-5, 1, 200)), ["x"], "side").first()
    assert not apart["compatible"]  # a negative mean is not similar by itself


def test_density_matches_numpy(spark):
    rng = np.random.default_rng(2)
    values = np.abs(rng.normal(5, 2, 300))
    df = spark.createDataFrame([(float(v), i % 2) for i, v in enumerate(values)] + [(-1.0, 0), (None, 1)], "x double, label int")
    got = distribution.density_by_label(df, "x", "label", points=50).where("label = 1").orderBy("grid_no").collect()
    part = values[1::2]
    h = 1.06 * part.std(ddof=1) * len(part) ** -0.2
    grid = np.linspace(values.min(), values.max(), 50)
    want = np.exp(-0.5 * ((grid[:, None] - part) / h) ** 2).mean(axis=1) / h / math.sqrt(2 * math.pi)
    assert np.allclose([r["density"] for r in got], want)


@pytest.mark.parametrize("options", [{}, {"broadcast_bytes": 0, "pivots": 6, "slice_rows": 25}])
def test_neighbors_are_exact_with_hot_duplicates(spark, options):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(180, 4))
    x[60:120] = x[60]  # a third of the rows is one point
    df = spark.createDataFrame([(i, [float(v) for v in row], i % 3) for i, row in enumerate(x)], "id long, v array<double>, label int")
    got = knn_join(df, df, 4, "id", "id", "v", ("label",), skip_self=True, **options).collect()
    found = {}
    for r in got:
        found.setdefault(r["query_id"], {})[r["rank"]] = (r["neighbor_id"], r["distance"], r["label"])
    for i in range(180):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        d[i] = np.inf
        want = np.argsort(d, kind="stable")[:4]
        assert [found[i][r][0] for r in (1, 2, 3, 4)] == list(want)
        assert np.allclose([found[i][r][1] for r in (1, 2, 3, 4)], d[want])
        assert [found[i][r][2] for r in (1, 2, 3, 4)] == [j % 3 for j in want]


def test_knn_votes(spark):
    train = spark.createDataFrame([(0, [0.0], 0), (1, [0.1], 0), (2, [1.0], 1), (3, [1.1], 1), (4, [1.2], 1)], "id long, v array<double>, label int")
    test = spark.createDataFrame([(10, [0.0]), (11, [1.05])], "id long, v array<double>")
    for weights, want in (("uniform", {10: 0, 11: 1}), ("distance", {10: 0, 11: 1})):
        out = knn_classify(train, test, "v", "label", "id", "id", 3, weights).collect()
        assert {r["id"]: r["prediction"] for r in out} == want
    few = knn_join(test, train.limit(2), 5, "id", "id", "v")
    assert few.count() == 4  # fewer references than k


def test_metrics_and_auc(spark):
    rng = np.random.default_rng(4)
    y = rng.integers(0, 2, 300)
    s = np.round(rng.random(300) * 0.6 + y * 0.3, 1)
    df = spark.createDataFrame([(int(a), float(b), int(b > 0.5)) for a, b in zip(y, s)], "label int, score double, prediction int")
    auc = metrics.roc_auc(df).first()["auc"]
    pos, neg = s[y == 1], s[y == 0]
    want = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert auc == pytest.approx(want)
    m = metrics.metrics(df).first()
    tp, fp, fn = ((y == 1) & (s > 0.5)).sum(), ((y == 0) & (s > 0.5)).sum(), ((y == 1) & (s <= 0.5)).sum()
    assert m["f1"] == pytest.approx(2 * tp / (2 * tp + fp + fn))
    points = metrics.curve_points(df).orderBy("threshold").collect()
    assert points[0]["tpr"] == points[0]["fpr"] == 1.0 and len(points) == len(set(s))
    one_class = df.where("label = 1")
    assert metrics.roc_auc(one_class).first()["auc"] is None
    nothing = spark.createDataFrame([(0, 0), (1, 0)], "label int, prediction int")
    assert metrics.metrics(nothing).first()["precision"] == 0.0
    three = spark.createDataFrame([(0, 0), (1, 2), (2, 2), (2, 1)], "label int, prediction int")
    w = metrics.metrics(three, classes=3).first()
    assert w["accuracy"] == 0.5 and w["precision"] == pytest.approx((1 + 0 + 2 * 0.5) / 4)
    verdicts = spark.createDataFrame([(0.99,), (0.7,), (0.2,)], "f1 double").select(metrics.fit_diagnosis(F.col("f1"))).collect()
    assert [v[0] for v in verdicts] == ["overfit_suspected", "ok", "underfit_suspected"]


def test_scores(spark):
    df = spark.createDataFrame(
        [("LR", 0.9, 1.0, 10.0, 5.0, None, None), ("CNN", 0.7, 3.0, 10.0, 1.0, 0.5, 2.0)],
        "model_name string, f1_score double, train_time_sec double, peak_ram_mb double, latency_ms double, shap double, lime double",
    )
    eff = {r["model_name"]: r for r in scores.resource_efficiency(df).collect()}
    assert eff["LR"]["eff_train_time_sec"] == pytest.approx(1.0) and eff["LR"]["eff_peak_ram_mb"] == 1.0
    assert eff["LR"]["resource_score"] == pytest.approx(0.5 + 0.3 + 0.2 * (1 - 4 / (4 + 1e-6)))
    combined = df.select("model_name", scores.combined_explainability(scores.native_score(F.col("model_name")), F.col("shap"), F.col("lime")).alias("e"))
    assert {r["model_name"]: r["e"] for r in combined.collect()} == pytest.approx({"LR": 1.0, "CNN": 0.3 * 0.5 + 0.2})


def test_ahp():
    names = ["C1", "C2", "C3"]
    got = decide.ahp(names, {("C1", "C2"): 3, ("C1", "C3"): 2, ("C2", "C3"): 0.5})
    w = dict(zip(names, got.weights))
    assert sum(got.weights) == pytest.approx(1) and w["C1"] > w["C3"] > w["C2"] and got.is_consistent()
    assert decide.ahp(["one"], {}).weights == [1.0] and decide.ahp(["one"], {}).consistency_ratio == 0.0
    assert not decide.ahp(names, {("C1", "C2"): 9, ("C1", "C3"): 1 / 9, ("C2", "C3"): 9}).is_consistent()
    with pytest.raises(ValueError):
        decide.preferences({"a": 0.5, "b": 0.2})
    assert decide.preferences({"a": 1.0, "b": 3.0}, rescale=True) == {"a": 0.25, "b": 0.75}


def test_topsis(spark):
    df = spark.createDataFrame([("a", 0.9, 0.5), ("b", 0.8, 0.8), ("c", 0.5, 0.9)], "alternative string, x double, y double")
    ranked = decide.rank_alternatives(decide.topsis(df, ["x", "y"], [0.5, 0.5]), "alternative").orderBy("rank").collect()
    assert ranked[0]["alternative"] == "b" and [r["rank"] for r in ranked] == [1, 2, 3]
    assert all(0 <= r["score"] <= 1 for r in ranked)
    m = np.array([[0.9, 0.5], [0.8, 0.8], [0.5, 0.9]])
    v = m / np.sqrt((m**2).sum(axis=0)) * 0.5
    up, down = np.sqrt(((v - v.max(axis=0)) ** 2).sum(axis=1)), np.sqrt(((v - v.min(axis=0)) ** 2).sum(axis=1))
    assert {r["alternative"]: r["score"] for r in ranked} == pytest.approx(dict(zip("abc", down / (up + down + 1e-10))))
    equal = decide.topsis(df.withColumn("x", F.lit(0.0)).withColumn("y", F.lit(2.0)), ["x", "y"], [0.5, 0.5])
    assert {r["score"] for r in equal.collect()} == {0.0}


@pytest.mark.parametrize("options", [{}, {"broadcast_rows": 0, "slice_rows": 7}])
def test_pareto_front(spark, options):
    rng = np.random.default_rng(6)
    points = np.round(rng.random((120, 3)), 1)
    points[:40] = points[0]
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)] + [(999, None, 0.0, 0.0)], "id int, f double, t double, m double")
    signed = points * np.array([1, -1, -1])
    want = {
        i for i, p in enumerate(signed)
        if not any((q >= p).all() and (q > p).any() for q in signed)
    }
    got = decide.pareto_front(df.repartition(3), ["f"], ["t", "m"], **options)
    assert {r["id"] for r in got.collect()} == want
