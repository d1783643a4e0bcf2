"""Folds are written once as columns, and the points and folds of a search run side by side."""

import threading

from pyspark.sql import functions as F

from flowcairn.plans import evaluate, models, tuning
from flowcairn.session import written_parts


def flows(spark, n=120):
    return spark.createDataFrame([(i, float(i % 7), float(i % 5), int(i % 3 == 0)) for i in range(n)], "id long, a double, b double, label int")


def test_written_parts_are_the_same_rows(spark):
    df = spark.createDataFrame([(1, "x", None, 0), (2, None, 2.5, 1), (None, "z", float("nan"), 1)], "`an id` long, `a.b` string, v double, fold int")
    out = written_parts(df, "fold")
    assert out.dtypes == df.dtypes
    key = lambda r: str(r)
    assert list(map(str, sorted(out.collect(), key=key))) == list(map(str, sorted(df.collect(), key=key)))
    assert len(out.where("fold = 1").inputFiles()) == len(out.inputFiles()) and out.where("fold = 1").count() == 2


def test_points_and_folds_run_side_by_side(spark, monkeypatch):
    meet = threading.Barrier(4)

    def scored(name, train, test, *args):
        meet.wait(60)
        return 0.5, float(args[3]["max_depth"] + train.where(F.col("id") < 0).count()), None

    monkeypatch.setattr(tuning, "_score", scored)
    grid = {"max_depth": [1, 2], "min_samples_split": [2]}
    rows = tuning.random_search("DT", flows(spark), ["a", "b"], row_id="id", grid=grid, k=2, parallel=4).collect()
    assert [(r["f1"], r["accuracy"], r["auc"], r["best"]) for r in rows] == [(0.5, 1.0, None, False), (0.5, 2.0, None, True)]


def test_long_tables_have_two_folds_in_work(spark, monkeypatch):
    seen, pool = [], evaluate.ThreadPoolExecutor
    monkeypatch.setattr(evaluate, "ThreadPoolExecutor", lambda max_workers: (seen.append(max_workers), pool(max_workers))[1])
    monkeypatch.setattr(evaluate, "evaluate_model", lambda name, *_, **__: {"algo": name, "error": None})
    monkeypatch.setattr(evaluate, "SIDE_VALUES", 3 * 240)
    evaluate.cross_validate(flows(spark), ["DT"], ["a", "b"], "label", ["id"], 5)
    monkeypatch.setattr(evaluate, "SIDE_VALUES", 1)
    evaluate.cross_validate(flows(spark), ["DT"], ["a", "b"], "label", ["id"], 5)
    assert seen == [3, 2]


def test_deep_trees_have_tasks_by_the_cores():
    deep, shallow = {"max_depth": None}, {"max_depth": 3}
    assert models._parts("DT", deep, 400_000, 64, 2, 8, 200) == 16
    assert models._parts("DT", shallow, 400_000, 64, 2, 8, 200) == 98
    assert models._parts("DT", deep, 300, 2, 2, 8, 200) == 1
    assert models._parts("RF", deep, 300, 2, 2, 8, 200) == 16


def test_trees_are_told_their_classes(spark, monkeypatch):
    """Without them MLlib looks for the largest label and deals the table twice."""
    seen = []

    class Estimator:
        def fit(self, data):
            seen.append(data.schema["_label"].metadata.get("ml_attr", {}).get("num_vals"))

    df = flows(spark)
    assert models.train_model("DT", df, ["a", "b"]).model.numClasses == 2
    monkeypatch.setitem(models.BUILDERS, "DT", lambda *_: Estimator())
    for part in (df, df.where("label = 0"), df.where("id < 0")):
        models.train_model("DT", part, ["a", "b"])
    assert seen == [2, 1, None]
