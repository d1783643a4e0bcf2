import math

import pytest
from pyspark.sql import functions as F

from flowcairn.functions.labels import attack_label, ddos_label, keep_binary_types, label_column
from flowcairn.functions.names import rename_label, safe_name, trim_names, with_algo
from flowcairn.functions.numeric import as_number, clip, coerce_all, is_finite, is_valid_ratio, numeric_only
from flowcairn.functions.ratios import MULTI_FILE, SINGLE_FILE, with_flow_ratios

INF, NAN = float("inf"), float("nan")


def test_text_coercion(spark):
    rows = [("1.5",), (" 2 ",), ("abc",), ("1.5d",), ("nan",), ("inf",), (None,), ("",)]
    df = spark.createDataFrame(rows, "x string").select(as_number("x").alias("a"), as_number(F.col("x")).alias("b"))
    got = df.collect()
    assert [r["a"] for r in got] == [1.5, 2.0, None, None, None, INF, None, None]
    assert [r["b"] for r in got] == [r["a"] for r in got]


def test_finite_and_valid(spark):
    df = spark.createDataFrame([(1.0,), (0.0,), (-1.0,), (INF,), (-INF,), (NAN,), (None,)], "x double")
    got = df.select(is_finite("x").alias("f"), is_finite(F.col("x")).alias("g"), is_valid_ratio("x").alias("v")).collect()
    assert [r["f"] for r in got] == [True, True, True, False, False, False, False]
    assert [r["g"] for r in got] == [r["f"] for r in got]
    assert [r["v"] for r in got] == [True] + [False] * 6


def test_clip_keeps_missing(spark):
    df = spark.createDataFrame([(-5.0,), (5.0,), (1.0,), (NAN,), (None,)], "x double").select(clip("x", 0.0, 2.0).alias("x"))
    got = [r["x"] for r in df.collect()]
    assert got[:3] == [0.0, 2.0, 1.0] and math.isnan(got[3]) and got[4] is None


def test_coerce_and_numeric_only(spark):
    df = spark.createDataFrame([("7", 1, "k"), ("x", None, "l")], "`a.b` string, n int, id string")
    assert [tuple(r) for r in coerce_all(df, ("id",)).collect()] == [(7.0, 1.0, "k"), (None, None, "l")]
    assert [tuple(r) for r in numeric_only(df).collect()] == [(1,), (0,)]


def test_names(spark):
    df = spark.createDataFrame([(1, 2)], ["﻿ a", " b "])
    assert trim_names(df).columns == ["a", "b"]
    with pytest.raises(ValueError):
        trim_names(spark.createDataFrame([(1, 2)], ["a", " a"]))
    assert spark.createDataFrame([(" CNN/Tab Net\\x ",)], "a string").select(safe_name("a")).first()[0] == "CNN_Tab_Net_x"
    assert with_algo(spark.createDataFrame([("LR",)], "model_name string")).columns == ["algo"]
    with pytest.raises(ValueError):
        with_algo(df)
    assert rename_label(spark.createDataFrame([(1, 2)], ["x", "Attack"]), ("x",)).columns == ["label"]


def test_labels(spark):
    text = spark.createDataFrame([("BENIGN",), ("Benign",), ("DrDoS_DNS",), (None,)], "Label string")
    assert [r[0] for r in text.select(attack_label(text)).collect()] == [0, 0, 1, 1]
    number = spark.createDataFrame([(0.0,), (1.0,), (None,), (NAN,)], "label double")
    assert [r[0] for r in number.select(attack_label(number)).collect()] == [0, 1, 0, 0]
    single = spark.createDataFrame([("normal", 1), ("DDoS", 0), ("scanning", 1)], "type string, label int")
    assert [r[0] for r in single.select(ddos_label(single)).collect()] == [0, 1, 0]
    assert keep_binary_types(single).count() == 1
    with pytest.raises(ValueError):
        keep_binary_types(single.where("type = 'scanning'"), require_rows=True)
    assert label_column(single) == "label"


def test_flow_ratios(spark):
    multi = spark.createDataFrame(
        [(100.0, 50.0, 10.0, 5.0, 2.0), (200.0, 100.0, 20.0, 10.0, 4.0), (1.0, 0.0, 1.0, 0.0, 0.0), (None, 1.0, 1.0, 1.0, None)],
        ["Total Fwd Bytes", " Total Bwd Bytes", "Total Fwd Packets", "Total Bwd Packets", "Flow Duration"],
    )
    got = with_flow_ratios(multi, MULTI_FILE).collect()
    assert [r["Flow_Bytes_s"] for r in got] == [75.0, 75.0, 1e8, None]
    assert [r["Flow_Packets_s"] for r in got][:2] == [7.5, 7.5]
    assert [r["Avg_Packet_Size"] for r in got][:2] == [10.0, 10.0]
    assert got[0]["Traffic_Direction_Ratio"] == pytest.approx(2.0)
    assert {r["dataset_source"] for r in got} == {0}
    for names in (["bytes_in", "bytes_out", "pkts_in", "pkts_out"], ["src_bytes", "dst_bytes", "src_pkts", "dst_pkts"]):
        single = spark.createDataFrame([(300.0, 150.0, 30.0, 15.0, 3.0)], [*names, "duration"])
        row = with_flow_ratios(single, SINGLE_FILE).first()
        assert (row["Flow_Bytes_s"], row["Flow_Packets_s"], row["Avg_Packet_Size"]) == (150.0, 15.0, 10.0)
        assert row["Traffic_Direction_Ratio"] == pytest.approx(0.5) and row["dataset_source"] == 1
    assert with_flow_ratios(spark.createDataFrame([(1,)], ["x"]), MULTI_FILE).columns == ["x", "dataset_source"]
