import numpy as np
import pytest
from pyspark.sql import functions as F

from flowcairn.operators import explain
from flowcairn.operators.neighbors import knn_join
from flowcairn.operators.flows import assemble_flows, epoch_time, sessions, with_direction
from flowcairn.operators.preparation import PrepareConfig, Preparation
from flowcairn.plans import config_search, evaluate, phases, tuning
from flowcairn.plans.models import canonical_name, importances, is_native, train_all, train_model
from flowcairn.sources.synthetic import synthetic_flows
from flowcairn.streaming import jobs

FEATURES = [f"feature_{i}" for i in range(5)]


@pytest.fixture(scope="module")
def flows(spark):
    return synthetic_flows(spark, 300, 5, 2, 0).persist()


@pytest.fixture(scope="module")
def linear(flows):
    return train_model("Logistic Regression", flows, FEATURES)


def test_models_learn(flows):
    params = {"n_estimators": 5, "max_depth": 4, "epochs": 10}
    trained = train_all(["LR", "DT", "RF", "XGBoost", "CNN", "KNN"], flows, FEATURES, row_id="id", params=params)
    for name, model in trained.items():
        out = model.score(flows, "id")
        row = out.agg(F.avg((F.col("prediction") == F.col("label")).cast("double")), F.min("score"), F.max("score"), F.count(F.lit(1))).first()
        assert row[0] > 0.8 and 0 <= row[1] <= row[2] <= 1 and row[3] == 300, name
        assert model.train_seconds >= 0
    assert is_native(trained["DT"]) and not is_native(trained["CNN"])
    assert canonical_name("Random_Forest") == "RF"
    with pytest.raises(KeyError):
        train_model("nope", flows, FEATURES)


def test_importances(spark, flows, linear):
    got = {r["feature"]: abs(r["importance"]) for r in importances(linear, spark).collect()}
    assert min(got["feature_0"], got["feature_1"]) > max(got[f] for f in FEATURES[2:])


def test_shapley_is_efficient(flows, linear):
    rows = explain.shapley(linear.score, flows, FEATURES, "id", rows=8, background=5, permutations=6)
    sums = rows.groupBy("row_id").agg(F.sum("attribution").alias("s"), F.first("base").alias("b"), F.first("prediction").alias("p"))
    got = sums.collect()
    assert len(got) == 8 and all(abs(r["s"] - (r["p"] - r["b"])) < 1e-9 for r in got)
    means = {r["feature"]: r["importance"] for r in explain.mean_attribution(rows).collect()}
    assert means["feature_0"] > means["feature_3"]
    assert explain.shap_score(linear.score, flows, FEATURES, "id", top_k=2, rows=8, background=5, permutations=6) > 0
    quality = explain.explanation_quality(rows, flows, FEATURES, "id").first()
    assert quality["fidelity"] > 0.99 and 0 <= quality["stability"] <= 1 and 0 <= quality["complexity"] <= 1


def test_lime_and_permutation(flows, linear):
    local = explain.lime(linear.score, flows, FEATURES, "id", rows=3, perturbations=200)
    means = {r["feature"]: r["m"] for r in local.groupBy("feature").agg(F.avg("attribution").alias("m")).collect()}
    assert local.count() == 15 and means["feature_0"] > abs(means["feature_3"])
    drops = {r["feature"]: r for r in explain.permutation_importance(linear.score, flows, FEATURES, "label", "id", 3).collect()}
    assert drops["feature_0"]["importance_mean"] > 0.05 > abs(drops["feature_3"]["importance_mean"])


def test_cross_validation_records_failures(flows):
    profiles = {"DT": PrepareConfig(apply_scaling=False), "bad": PrepareConfig()}
    out = evaluate.cross_validate(flows, ["DT", "bad"], FEATURES, "label", ["id"], 3, {"DT": {"max_depth": 4}}, profiles)
    rows = out.collect()
    good = [r for r in rows if r["algo"] == "DT"]
    assert len(rows) == 6 and all(r["error"] is None and r["f1"] > 0.7 for r in good)
    assert sum(sum(map(sum, r["confusion_matrix"])) for r in good) == 300
    assert all(r["memory_used_mb"] >= 0 and r["inference_latency_ms"] > 0 for r in good)
    assert all(r["f1"] is None and "KeyError" in r["error"] for r in rows if r["algo"] == "bad")
    summary = {r["algo"]: r for r in evaluate.summarize(out).collect()}
    assert summary["DT"]["folds"] == 3 and summary["bad"]["failed_folds"] == 3
    assert summary["DT"]["explainability_score"] == 1.0


def test_grid_and_search(spark, flows):
    grid = config_search.preparation_grid()
    assert len(grid) == 108 and len(set(grid)) == 108
    assert sum(not g.apply_cleaning for g in grid) == 36
    assert config_search.grid_table(spark, grid).count() == 108
    few = [grid[0], grid[2], grid[-1]]
    results = config_search.search(flows, FEATURES, "label", ["id"], few, max_iter=20)
    rows = results.collect()
    assert len(rows) == 3 and all(r["score"] > 0.8 for r in rows)
    best = config_search.best(results).first()
    assert best["score"] == max(r["score"] for r in rows)
    assert best["config_id"] == min(r["config_id"] for r in rows if r["score"] == best["score"])


def test_tuning(flows):
    out = tuning.random_search("DT", flows, FEATURES, row_id="id", n_iter=2, k=2)
    assert out.count() == 2 and out.where("best").count() == 1
    assert set(tuning.best_params(out)) == {"max_depth", "min_samples_split"}
    sweep = tuning.sweep("LR", flows.where("id < 200"), flows.where("id >= 200"), FEATURES, points=[{"C": 0.1}, {"C": 10.0}])
    assert sweep.count() == 2 and sweep.where("auc > 0.8").count() == 2


def packets(spark):
    rows = [("f1", "a", 10.0), ("f1", "b", 12.5), ("f1", "a", 11.0), ("f2", "c", 5.0), ("f1", "a", 5000.0)]
    return spark.createDataFrame(rows, "flow string, src_ip string, ts double").withColumn("flow_source", F.when(F.col("flow") == "f1", "a").otherwise("x"))


def test_flow_assembly(spark):
    df = epoch_time(packets(spark), "ts")
    flows = {r["flow"]: r for r in assemble_flows(df, ["flow"], "ts", F.col("src_ip") == F.col("flow_source")).collect()}
    assert flows["f1"]["duration"] == 4990.0 and (flows["f1"]["forward_packets"], flows["f1"]["backward_packets"]) == (3, 1)
    assert flows["f2"]["duration"] == 0.0 and flows["f2"]["backward_packets"] == 1
    assert [r["direction"] for r in with_direction(df, "src_ip", "flow_source").collect()] == ["FORWARD", "BACKWARD", "FORWARD", "BACKWARD", "FORWARD"]
    bursts = sessions(df, ["flow"], "ts", "10 minutes", F.col("src_ip") == F.col("flow_source")).collect()
    assert sorted((r["flow"], r["packets"]) for r in bursts) == [("f1", 1), ("f1", 3), ("f2", 1)]


def test_stream_ingestion_and_flows(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    first = epoch_time(packets(spark), "ts")
    first.coalesce(1).write.parquet(src)
    stream = jobs.file_stream(spark, src, first.schema, "parquet")
    jobs.ingest_new_files(stream, out, ck).awaitTermination()
    assert spark.read.parquet(out).count() == 5
    first.coalesce(1).write.mode("append").parquet(src)
    jobs.ingest_new_files(jobs.file_stream(spark, src, first.schema, "parquet"), out, ck).awaitTermination()
    assert spark.read.parquet(out).count() == 10  # the first file is not read again

    forward = F.col("src_ip") == F.col("flow_source")
    flows = jobs.stream_flows(
        jobs.file_stream(spark, src, first.schema, "parquet"), ["flow"], "ts", "10 minutes", "1 minute", forward
    )
    jobs.write_stream(flows, str(tmp_path / "flows"), str(tmp_path / "ck2")).awaitTermination()
    batch = sessions(spark.read.parquet(src), ["flow"], "ts", "10 minutes", forward)
    closed = batch.where("end_time < timestamp'1970-01-01 01:00:00'")  # the newest flow is still open
    got = spark.read.parquet(str(tmp_path / "flows"))
    assert sorted(map(str, got.collect())) == sorted(map(str, closed.select(*got.columns).collect()))


def test_stream_scoring_equals_batch(spark, flows, tmp_path):
    prepared = Preparation(PrepareConfig()).fit(flows, FEATURES)
    model = train_model("LR", prepared.transform(flows), prepared.features)
    src = str(tmp_path / "in")
    flows.write.parquet(src)
    scored = jobs.score_stream(jobs.file_stream(spark, src, flows.schema, "parquet"), prepared, model).select("id", "prediction")
    jobs.write_stream(scored, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    batch = model.score(prepared.transform(flows)).select("id", "prediction")
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(tuple, batch.collect()))


def test_phases_end_to_end(spark, tmp_path):
    rng = np.random.default_rng(1)
    multi = spark.createDataFrame(
        [(float(50 + 400 * (i % 2) + rng.normal(0, 20)), float(40 + rng.normal(0, 5)), float(5 + 10 * (i % 2)), 3.0 + float(i % 5), 2.0 + float(i % 3), "BENIGN" if i % 2 == 0 else "DrDoS_UDP") for i in range(120)],
        ["Total Length of Fwd Packets", "Total Length of Bwd Packets", "Total Fwd Packets", "Total Backward Packets", "Flow Duration", "Label"],
    )
    single = spark.createDataFrame(
        [(float(60 + 300 * (i % 2)), float(45 + i % 7), float(6 + 8 * (i % 2)), 4.0 + i % 2, 1.0 + float(i % 4), i % 2, ["normal", "ddos"][i % 2]) for i in range(80)],
        ["src_bytes", "dst_bytes", "src_pkts", "dst_pkts", "duration", "label", "type"],
    )
    config = phases.PhaseConfig(
        str(tmp_path / "out"), models=("LR", "DT"), folds=2,
        grid=(PrepareConfig(apply_encoding=False), PrepareConfig(apply_encoding=False, apply_scaling=False, scaling_method=None)),
        model_params={"DT": {"max_depth": 4}},
    )
    ranking = phases.run(multi, single, config).orderBy("rank").collect()
    assert [r["rank"] for r in ranking] == [1, 2] and {r["alternative"] for r in ranking} == {"LR", "DT"}
    assert spark.read.parquet(config.folder("phase1_best")).first()["score"] > 0.8
    stored = spark.read.option("header", "true").option("inferSchema", "true").csv(config.folder("metrics_aggregated"))
    assert stored.agg(F.min("f1_mean")).first()[0] > 0.8
    again = phases.run(multi, single, config, phases=(5,)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, [r for r in ranking])) or len(again) == 2
    data = phases.read_stage(spark, config.folder("phase2"))
    tables = phases.ratio_report(data, config)
    assert {"ratio_validation", "mutual_information", "permutation_importance"} <= set(tables)
    with pytest.raises(ValueError):
        phases.PhaseConfig("x", sample_ratio=0.0)


def test_repeated_rows_have_keys_of_their_own(spark):
    rows = [(1.0, 2.0, 0)] * 40 + [(float(i), None, i % 2) for i in range(20)]
    table = spark.createDataFrame(rows, "a double, b double, label int")
    first, second = (phases.with_key(table.repartition(n)).select("row_key").collect() for n in (1, 7))
    assert len({r[0] for r in first}) == 60 and {r[0] for r in first} == {r[0] for r in second}


def test_models_learn_from_repeated_rows(spark):
    rows = [(float(i % 6), float(i % 4), int(i % 6 > 3)) for i in range(300)]
    table = phases.with_key(spark.createDataFrame(rows, "a double, b double, label int"))
    found = evaluate.cross_validate(table, ["LR", "KNN"], ["a", "b"], "label", ["row_key"], k=3).collect()
    assert len(found) == 6 and all(r["error"] is None for r in found), [r["error"] for r in found]
    repeated = table.select(F.lit("x").alias("id"), F.array("a", "b").alias("v"))
    with pytest.raises(ValueError, match="not unique"):
        knn_join(repeated, repeated, 2, "id", "id", "v")
