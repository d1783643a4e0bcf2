import os

import pytest
from pyspark.sql import functions as F

from flowcairn.functions.ratios import SINGLE_FILE, with_flow_ratios
from flowcairn.operators.categories import categorize, category_scores
from flowcairn.operators.harmonize import concat, feature_ranges, fuse, harmonize
from flowcairn.operators.matching import (
    MAPPING_SCHEMA, check_requirements, describe_columns, mapping_report, match_by_groups, match_columns, required_features,
)
from flowcairn.sources import feeds, listing, stage
from flowcairn.sources.synthetic import synthetic_flows


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = str(tmp_path_factory.mktemp("feed"))
    single = "ts,duration,src_pkts,dst_pkts,src_bytes,dst_bytes,label,type\n"
    write(f"{root}-single/net.csv", single + "1.5,1,1,1,10,20,0,normal\n2.5,0,3,1,30,10,1,ddos\n3,1,1,1,1,1,1,scanning\n")
    write(f"{root}/01/DrDoS_DNS.csv", "﻿Flow ID, Flow Duration, Total Fwd Packets,Flow Bytes/s, Label\nx,10,1,Infinity,DrDoS_DNS\ny,20,2,3.5,BENIGN\n")
    write(f"{root}/02/deep/Syn.csv", "Label,Flow Duration,Total Fwd Packets\nSyn,30,bad\nSyn,40,4\nSyn,50,5\n")
    write(f"{root}/02/DrDoS_DNS.csv", "Flow ID,Flow Duration\nduplicate,1\n")
    write(f"{root}/02/example_structure.csv", "Flow ID\nnot data\n")
    write(f"{root}/.hidden/Portmap.csv", "Flow ID\nhidden\n")
    return root


def test_listing(spark, folder):
    files = listing.list_files(spark, f"{folder}/01").unionByName(listing.list_files(spark, f"{folder}/02"))
    assert {r["name"] for r in files.collect()} == {"DrDoS_DNS.csv", "Syn.csv", "example_structure.csv"}
    kept = listing.without_duplicates(listing.without_documentation(files)).collect()
    assert sorted(r["name"] for r in kept) == ["DrDoS_DNS.csv", "Syn.csv"]
    assert next(r["path"] for r in kept if r["name"].startswith("Dr")).endswith("01/DrDoS_DNS.csv")
    assert listing.list_files(spark, folder).where("path LIKE '%hidden%'").count() == 0
    assert listing.choose_files(files, 2).count() == 2


def test_inventory(spark):
    names = ["DrDoS_UDP.csv", "UDP.csv", "UDPLag.csv", "DrDoS_LDAP.csv", "syn.csv", "new thing_x.csv"]
    files = spark.createDataFrame([(f"/d/{n}", n, 1) for n in names], "path string, name string, bytes long")
    got = {r["attack"]: r for r in listing.inventory(files).collect()}
    assert got["UDP"]["files"] == 2 and got["UDP"]["both_variants"] and not got["UDP"]["missing"]
    assert got["UDP-Lag"]["has_direct"] and got["LDAP"]["has_reflected"] and not got["LDAP"]["has_direct"]
    assert got["SYN"]["training_day"] and got["SYN"]["test_day"]
    assert got["New-thing-x"]["unexpected"] and got["WebDDoS"]["missing"] and got["WebDDoS"]["files"] == 0


def test_multi_file_feed(spark, folder, tmp_path):
    root = f"{folder}/01"
    df = feeds.read_multi_file_feed(spark, folder)
    dur = {r["Flow Duration"] for r in df.where("Label IS NOT NULL").collect()}
    assert {10.0, 20.0, 30.0, 40.0, 50.0} <= dur
    rows = {r["Flow Duration"]: r for r in df.collect() if r["Flow Duration"] is not None}
    assert rows[10.0]["Flow Bytes/s"] == float("inf") and rows[10.0]["Flow ID"] == "x"
    assert rows[30.0]["Total Fwd Packets"] is None and rows[30.0]["Label"] == "Syn"
    capped = feeds.read_multi_file_feed(spark, f"{folder}/02/deep", max_rows_per_file=2)
    assert capped.count() == 2
    manifest = str(tmp_path / "manifest")
    target = str(tmp_path / "loaded")
    assert feeds.read_multi_file_feed(spark, root, manifest).count() == 2  # reading alone records nothing
    assert feeds.load_new_files(spark, root, manifest, target) > 0
    assert feeds.read_multi_file_feed(spark, root, manifest) is None
    assert feeds.load_new_files(spark, root, manifest, target) == 0
    write(f"{root}/late.csv", "Flow ID,Flow Duration\nz,5\n")
    again = feeds.read_multi_file_feed(spark, root, manifest)
    assert [r["Flow ID"] for r in again.collect()] == ["z"]
    assert feeds.load_new_files(spark, root, manifest, target) == 1
    assert spark.read.option("mergeSchema", "true").parquet(target).count() == 3


def test_single_file_and_both(spark, folder):
    single = feeds.read_single_file_feed(spark, [f"{folder}/missing.csv", f"{folder}-single/net.csv"])
    assert single.count() == 3 and dict(single.dtypes)["ts"] == "double"
    with pytest.raises(FileNotFoundError):
        feeds.read_single_file_feed(spark, [f"{folder}/missing.csv"])
    both = feeds.load_both(spark, [f"{folder}-single/net.csv"], f"{folder}/02/deep")
    assert set(both.columns) == {"is_ddos", "type", "dataset"}
    assert {(r["dataset"], r["is_ddos"]): r["count"] for r in both.groupBy("dataset", "is_ddos").count().collect()} == {
        ("single_file", 0): 1, ("single_file", 1): 1, ("multi_file", 1): 3,
    }
    assert feeds.count_rows(spark, f"{folder}-single/net.csv") == 3
    assert feeds.head_sample(spark, f"{folder}-single/net.csv", 2).count() == 2
    assert feeds.preview(single, ["ts"]).count() == 2
    assert feeds.sample_feed(single, 1.0).count() == 3
    assert feeds.sample_feed(spark.range(5000), 0.5, ["id"], exact=True).count() == 2500
    assert 20 <= feeds.sample_feed(spark.range(10000), 0.005, ["id"]).count() <= 90
    with pytest.raises(FileNotFoundError):
        feeds.load_both(spark, [f"{folder}/missing.csv"], f"{folder}/02/deep")
    one = feeds.load_both(spark, [f"{folder}/missing.csv"], f"{folder}/02/deep", tags=("a", "b"), allow_missing=True)
    assert {r["dataset"] for r in one.collect()} == {"b"}
    found = feeds.discover_features(spark, f"{folder}-single/net.csv", f"{folder}/02/deep")
    assert ("duration", "Flow Duration") in {(r["single_name"], r["multi_name"]) for r in found.collect()}


def test_column_matching(spark):
    single = spark.createDataFrame([], "duration double, src_bytes double, proto string, label int, same double")
    multi = spark.createDataFrame([], "`Flow Duration` double, `Total Length of Fwd Packets` double, Protocol string, Label string, same double")
    got = match_columns(single, multi)
    assert [f.name for f in got.schema] == [p.split(" ")[0] for p in MAPPING_SCHEMA.split(", ")]
    pairs = {(r["single_name"], r["multi_name"]): r for r in got.collect()}
    assert pairs[("same", "same")]["type"] == "exact_match"
    semantic = pairs[("duration", "Flow Duration")]
    assert semantic["similarity_score"] == pytest.approx(0.4 * 0.5 + 0.3 + 0.3) and semantic["confidence"] == "medium"
    known = pairs[("src_bytes", "Total Length of Fwd Packets")]
    assert known["unified_name"] in ("fwd_bytes", "src_bytes")
    assert not any("proto" in p for p in pairs)
    strict = match_columns(single, multi, strict=True).groupBy("multi_name").count().where("count > 1")
    assert strict.count() == 0
    assert {r["type"] for r in mapping_report(got).collect()} >= {"exact_match"}
    assert required_features(got).where("unified_name = 'label'").count() == 0
    assert check_requirements(["a"])["all_requirements_met"] and not check_requirements([])["all_requirements_met"]
    simple = {r["unified_name"]: (r["multi_name"], r["single_name"]) for r in match_by_groups(multi, single).collect()}
    assert simple["same"] == ("same", "same") and simple["proto"] == ("Protocol", "proto")
    assert simple["duration"] == ("Flow Duration", "duration")
    kinds = {r["name"]: (r["unit"], r["category"]) for r in describe_columns(spark, ["Flow Duration", "SYN Flag Count"]).collect()}
    assert kinds["Flow Duration"] == ("seconds", "temporal") and kinds["SYN Flag Count"][1] == "flag"


def test_harmonize_and_fuse(spark):
    multi = spark.createDataFrame([(1.0, "7", "Benign"), (None, "x", "DDoS"), (3.0, "9", None), (4.0, "1", "a"), (5.0, "2", "b"), (6.0, "3", "c")], "F1 double, odd string, Label string")
    single = spark.createDataFrame([(3.0, 1, "normal"), (4.0, 2, "ddos"), (9.0, 3, "scanning")], "f1 double, odd int, type string")
    mapping = spark.createDataFrame(
        [("f1", "f1", "F1"), ("odd", "odd", "odd"), ("gone", "nope", "F1")], "unified_name string, single_name string, multi_name string"
    )
    a, b, names = harmonize(multi, single, "Label", "type", mapping)
    assert names == ["f1", "odd"] and a.columns == ["f1", "odd", "label"]
    assert [r["f1"] for r in a.collect()] == [1.0, 4.0, 3.0, 4.0, 5.0, 6.0] and [r["label"] for r in a.collect()] == [0, 1, 1, 1, 1, 1]
    assert [r["label"] for r in b.collect()] == [0, 1]
    text = multi.withColumn("odd", F.lit("x"))
    assert harmonize(text, single, "Label", "type", mapping)[2] == ["f1"]
    fused = fuse(a, b)
    assert fused.columns == ["f1", "label", "odd", "dataset_source"]
    assert [r["dataset_source"] for r in fused.collect()] == [0] * 6 + [1] * 2
    assert feature_ranges(a, b, names).count() == 4
    assert concat([a, b.drop("odd")]).where("odd IS NULL").count() == 2


def test_categories(spark):
    names = spark.createDataFrame([("Flow Duration",), ("Source IP",), ("SYN Flag Count",), ("Unknown",)], "name string")
    got = categorize(names)
    assert {r["name"]: r["feature_category"] for r in got.collect()} == {
        "Flow Duration": "Flow_Basic_Stats", "Source IP": "Flow_Identifiers", "SYN Flag Count": "Flag_Counts", "Unknown": "Other",
    }
    assert tuple(category_scores(got).first()) == ((5 + 2 + 4 + 1) / 4, (9 + 10 + 10 + 3) / 4, (2 + 1 + 1 + 1) / 4)
    assert tuple(category_scores(got.where("false")).first()) == (0.0, 0.0, 0.0)


def test_stage_and_sinks(spark, tmp_path):
    out = str(tmp_path / "stage")
    df = spark.createDataFrame([(1.0, 0, 1), (2.0, 1, 0)], "a double, label int, dataset_source int")
    stage.write_stage(df, out, ["a"])
    assert stage.read_stage(spark, out).count() == 2 and stage.read_features(spark, out) == ["a"]
    assert stage.read_stage(spark, str(tmp_path / "none"), lambda: df).count() == 2
    for fmt in ("csv", "json", "parquet"):
        stage.write_metrics(df.withColumn("m", F.array(F.lit(1))), f"{out}_{fmt}", "r1", fmt)
        assert spark.read.format(fmt).load(f"{out}_{fmt}").where("run = 'r1'").count() >= 2


def test_synthetic(spark):
    a = synthetic_flows(spark, 400, 8, 3, 2)
    assert a.columns == ["id", *[f"feature_{i}" for i in range(8)], "label"]
    gap = a.groupBy("label").agg(F.avg("feature_0").alias("m"), F.avg("feature_4").alias("z")).orderBy("label").collect()
    assert gap[1]["m"] - gap[0]["m"] > 1.5 and abs(gap[1]["z"] - gap[0]["z"]) < 0.5
    assert sorted(map(str, a.collect())) == sorted(map(str, synthetic_flows(spark, 400, 8, 3, 2).repartition(9).collect()))


def test_ratio_conventions_come_from_the_schema(spark):
    df = spark.createDataFrame([(1.0, 2.0, 1.0, 1.0, 1.0)], "src_bytes double, dst_bytes double, src_pkts double, dst_pkts double, duration double")
    assert with_flow_ratios(df, SINGLE_FILE).first()["Traffic_Direction_Ratio"] == pytest.approx(2.0)
