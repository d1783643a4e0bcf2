"""Training tables lie in as many partitions as their size asks for, and sums travel once per task that runs."""

import numpy as np

from flowcairn.operators import boosting
from flowcairn.plans import models


def test_short_tables_have_few_partitions(spark, monkeypatch):
    df = spark.createDataFrame([(float(i % 7), float(i % 5), i % 2) for i in range(300)], "a double, b double, label int")
    seen = {}

    class Estimator:
        def fit(self, data):
            seen["parts"], seen["rows"] = data.rdd.getNumPartitions(), data.count()

    monkeypatch.setitem(models.BUILDERS, "DT", lambda *_: Estimator())
    models.train_model("DT", df, ["a", "b"])
    assert seen == {"parts": 1, "rows": 300}
    monkeypatch.setattr(models, "PART_VALUES", 1)
    models.train_model("DT", df, ["a", "b"])
    assert seen == {"parts": int(spark.conf.get("spark.sql.shuffle.partitions")), "rows": 300}


def test_boosting_has_no_more_tasks_than_run_at_once(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(*map(float, v), int(v[0] > 0) + int(v[1] > 0.5)) for v in rng.normal(size=(600, 2))]
    df = spark.createDataFrame(rows, "a double, b double, label int")
    seen = []
    splits = boosting._OnSpark.splits
    monkeypatch.setattr(boosting._OnSpark, "splits", lambda self, *a: (seen.append(self.blocks.rdd.getNumPartitions()), splits(self, *a))[1])
    options = dict(classes=3, rounds=2, depth=2, block_rows=20)
    model = boosting.fit_softmax_boosting(df, ["a", "b"], "label", single_task_rows=0, **options)
    assert set(seen) == {spark.sparkContext.defaultParallelism}
    plain = boosting.fit_softmax_boosting(df, ["a", "b"], "label", **options)
    assert np.allclose([h[1] for h in model.history], [h[1] for h in plain.history])
