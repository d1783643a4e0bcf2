"""Tables written on the way are deleted when the step that needed them ends, and row keys are made in one shuffle."""

from pathlib import Path
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from flowcairn.operators import balancing, neighbors
from flowcairn.operators.balancing import resample
from flowcairn.plans import evaluate, models, phases
from flowcairn.session import cut_lineage, ensure_checkpoint_dir, scratch


def files(spark):
    at = Path(urlparse(ensure_checkpoint_dir(spark)).path)
    return {p for p in at.rglob("*") if p.is_dir() and p.name.startswith(("rdd-", "parts-"))}


def flows(spark, n=400):
    return spark.createDataFrame([(str(i), float(i % 13), float(i % 7), int(i % 4 == 0)) for i in range(n)], "id string, a double, b double, label int")


def test_only_kept_tables_outlive_a_block(spark):
    df, before = flows(spark), files(spark)
    with scratch(spark):
        with scratch(spark) as keep:
            cut_lineage(df)
            kept = keep(df)
            with scratch(spark):
                inner = keep(df)
            assert len(files(spark) - before) == 3
        assert len(files(spark) - before) == 2 and kept.count() == inner.count() == 400
    assert files(spark) == before


@pytest.mark.parametrize("method", ["SMOTE", "ADASYN"])
def test_balancing_leaves_its_new_rows_only_and_passes_change_none(spark, monkeypatch, method):
    df = flows(spark)
    take = lambda: sorted(map(str, resample(df, ["a", "b"], "label", ["id"], method, broadcast_bytes=0, pivots=8).collect()))
    before = files(spark)
    plain = take()
    assert len(files(spark) - before) == 1
    monkeypatch.setattr(balancing, "PASS_ROWS", 30)
    before = files(spark)
    assert take() == plain and len(files(spark) - before) == 4


def test_folds_leave_no_files(spark):
    before = files(spark)
    found = evaluate.cross_validate(flows(spark), ["LR", "DT", "KNN"], ["a", "b"], "label", ["id"], 2).collect()
    assert len(found) == 6 and all(r["error"] is None for r in found)
    assert files(spark) == before


def test_a_spent_table_goes_when_its_folds_are_written(spark, monkeypatch):
    seen, before = [], files(spark)

    def rows(*args):
        seen.append({p.name[:4] for p in files(spark) - before})
        return []

    monkeypatch.setattr(evaluate, "_fold_rows", rows)
    evaluate.cross_validate(cut_lineage(flows(spark)), ["DT"], ["a", "b"], "label", ["id"], 2, spent=True)
    assert seen == [{"part"}] and files(spark) == before


def test_training_shuffles_plain_columns(spark, monkeypatch):
    plans = []

    class Estimator:
        def fit(self, data):
            plans.append(data._jdf.queryExecution().optimizedPlan().toString())

    monkeypatch.setitem(models.BUILDERS, "DT", lambda *_: Estimator())
    models.train_model("DT", flows(spark), ["a", "b"])
    below = plans[0].split("RepartitionByExpression")[1]
    assert "VectorAssembler" not in below and "_features" not in below and "_features" in plans[0]


def test_grid_points_leave_no_files(spark):
    from flowcairn.operators.preparation import PrepareConfig
    from flowcairn.plans import config_search

    before = files(spark)
    grid = [PrepareConfig(apply_resampling=True, resampling_method=m) for m in ("SMOTE", "ADASYN")]
    found = config_search.search(flows(spark), ["a", "b"], "label", ["id"], grid, max_iter=5).collect()
    assert all(r["error"] is None and r["score"] > 0 for r in found) and len(files(spark) - before) <= 1  # the split


def test_frequent_rows_and_equal_texts_have_keys_of_their_own(spark, monkeypatch):
    rows = [("x", 1.0)] * 90 + [("", 2.0), (None, 2.0), ("", 2.0)] + [(str(i), None) for i in range(20)]
    df = spark.createDataFrame(rows, "a string, b double").repartition(4)
    keys = lambda: sorted(r["row_key"] for r in phases.with_key(df).collect())
    plain = keys()
    assert len(set(plain)) == len(rows)
    monkeypatch.setattr(phases, "FREQUENT_ROWS", 10)
    before = files(spark)
    assert keys() == plain and len(files(spark) - before) == 1
    counts = phases.with_key(df).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).collect()
    assert {(r["a"], r["b"]): r["n"] for r in counts}["x", 1.0] == 90


def test_permutation_importance_shuffles_a_repeat_at_a_time(spark):
    from flowcairn.operators.explain import permutation_importance

    seen, before = [], files(spark)

    def scorer(df, row_id):
        seen.append(df.count())
        return df.withColumn("prediction", (F.col("a") > 6).cast("int"))

    df = flows(spark, 130).withColumn("label", (F.col("a") > 6).cast("int"))
    found = {r["feature"]: r for r in permutation_importance(scorer, df, ["a", "b"], "label", "id", 3).collect()}
    assert seen == [130, 260, 260, 260] and files(spark) == before
    assert found["b"]["importance_mean"] == 0.0 and 0.3 < found["a"]["importance_mean"] < 0.7


def test_foreign_neighbours_are_looked_for_once(spark, monkeypatch):
    looked, matches = spark.sparkContext.accumulator(0), neighbors._matches

    def counted(query_ids, *args):
        looked.add(len(query_ids))
        return matches(query_ids, *args)

    monkeypatch.setattr(neighbors, "_matches", counted)
    resample(flows(spark), ["a", "b"], "label", ["id"], "ADASYN").count()
    assert looked.value <= 200  # 100 members among all rows, and the bases among the members
