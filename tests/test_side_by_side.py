"""Folds, models and grid points run side by side; a forest has tasks by the cores."""

import threading

from flowcairn.operators.preparation import PrepareConfig
from flowcairn.plans import config_search, evaluate, models


def flows(spark, n=120):
    return spark.createDataFrame([(i, float(i % 7), float(i % 5), int(i % 3 == 0)) for i in range(n)], "id long, a double, b double, label int")


def test_folds_run_side_by_side(spark, monkeypatch):
    meet = threading.Barrier(5)

    def evaluated(name, *_, **__):
        meet.wait(60)
        return {"algo": name, "error": None}

    monkeypatch.setattr(evaluate, "evaluate_model", evaluated)
    rows = evaluate.cross_validate(flows(spark), ["DT"], ["a", "b"], "label", ["id"], 5).collect()
    assert [r["error"] for r in rows] == [None] * 5


def test_models_train_side_by_side(spark, monkeypatch):
    meet = threading.Barrier(3)
    monkeypatch.setattr(models, "train_model", lambda name, *_, **__: (meet.wait(60), name)[1])
    assert models.train_all(["LR", "DT", "RF"], flows(spark), ["a", "b"]) == {"LR": "LR", "DT": "DT", "RF": "RF"}


def test_grid_points_take_every_core(spark, monkeypatch):
    seen, pool = [], config_search.ThreadPoolExecutor
    monkeypatch.setattr(config_search, "ThreadPoolExecutor", lambda max_workers: (seen.append(max_workers), pool(max_workers))[1])
    monkeypatch.setattr(type(spark.sparkContext), "defaultParallelism", 6)
    grid = [PrepareConfig(True, False, False, None, False, None, False, None)]
    assert config_search.search(flows(spark), ["a", "b"], "label", ["id"], grid, max_iter=2).count() == 1
    assert seen == [6]


def test_a_forest_has_tasks_by_the_cores(spark, monkeypatch):
    seen = []

    class Estimator:
        def fit(self, data):
            seen.append(data.rdd.getNumPartitions())

    monkeypatch.setitem(models.BUILDERS, "RF", lambda *_: Estimator())
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        models.train_model("RF", flows(spark), ["a", "b"])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen == [2 * spark.sparkContext.defaultParallelism]
