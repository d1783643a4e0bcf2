"""Queries train with full settings, score rows the models have not seen, and return all they name."""

from pyspark.sql import functions as F

from flowcairn.catalog import learning
from flowcairn.operators.matching import column_profile
from flowcairn.plans.evaluate import RESULT_SCHEMA
from flowcairn.plans.models import REGISTRY


def test_all_models_score_held_out_rows(spark, sf_dir):
    rows = learning.trained_models(spark, sf_dir).collect()
    events, _ = learning.event_features(spark, sf_dir)
    sizes = [events.where(F.col("label") == y).count() for y in (0, 1)]
    assert sorted(r["algo"] for r in rows) == sorted(REGISTRY)
    for r in rows:
        for n, got in zip(sizes, (r["tn"] + r["fp"], r["tp"] + r["fn"])):
            assert abs(got - 0.2 * n) <= 1, r["algo"]


def test_full_settings(spark, sf_dir, monkeypatch):
    seen = {}

    class Stop(Exception):
        pass

    def stop(name):
        def call(*args, **options):
            seen[name] = (args, options)
            raise Stop

        return call

    monkeypatch.setattr(learning, "_cv", stop("cv"))
    monkeypatch.setattr(learning, "train_model", stop("model"))
    monkeypatch.setattr(learning.config_search, "search", stop("search"))
    for run in (learning.gbt_cv, learning.shapley, learning.preparation_search):
        try:
            run(spark, sf_dir)
        except Stop:
            pass
    assert seen["cv"][0][3]["GBT"]["n_estimators"] == 100 and seen["model"][1]["params"]["n_estimators"] == 100
    assert seen["search"][1].get("max_iter", 100) == 100


def test_profile_examples(spark):
    rows = [(i % 7, None if i % 2 else f"v{i % 9}", None) for i in range(100)]
    df = spark.createDataFrame(rows, "a int, c string, d string").withColumnRenamed("a", "a.b")
    got = {r["name"]: r["examples"] for r in column_profile(df).collect()}
    assert got == {"a.b": ["0", "1", "2", "3", "4"], "c": ["v0", "v1", "v2", "v3", "v4"], "d": []}
    assert {r["name"]: r["examples"] for r in column_profile(df, 2).collect()}["c"] == ["v0", "v1"]
    assert {len(r["examples"]) for r in column_profile(df, 0).collect()} == {0}
    assert [r["examples"] for r in column_profile(df.limit(0)).collect()] == [[], [], []]


def test_metrics_of_several_classes_are_checked(spark, sf_dir, monkeypatch):
    cells = [[3, 1, 0], [1, 4, 1], [0, 0, 0]]
    precision, recall, f1 = (4 * 3 / 4 + 6 * 4 / 5) / 10, 0.7, (4 * 6 / 8 + 6 * 8 / 11) / 10
    row = lambda fold, p: ("DT", fold, f1, 0.7, p, recall, None, cells, *[None] * 8)
    results = spark.createDataFrame([row(0, precision), row(1, precision + 0.1)], RESULT_SCHEMA)
    assert {r["fold"]: (r["n"], r["consistent"]) for r in learning._checked(results).collect()} == {0: (10, True), 1: (10, False)}
    monkeypatch.setattr(learning, "CROSS_VALIDATIONS", {"a": lambda *_: results, "b": lambda *_: results})
    kept = learning.cv_metrics(spark, sf_dir).collect()
    assert len(kept) == 4 and {(r["query"], r["fold"], r["precision"]) for r in kept} == {(q, i, p) for q in "ab" for i, p in ((0, precision), (1, precision + 0.1))}
