"""Sessions stitched from pieces equal the session windows, for hot keys, null keys and borders."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from flowcairn.operators import flows

RANDOM = random.Random(6)
START = dt.datetime(2024, 1, 1)


def packets(spark):
    rows = []
    for key in ["hot"] * 40 + ["cold", None, "x"]:
        t = RANDOM.random() * 1000
        for _ in range(20):
            t += RANDOM.choice([0.0, 0.3, 5.0, 9.999999, 10.0, 10.000001, 60.0, 700.0])
            rows.append((key, RANDOM.choice([1, None, 2]), START + dt.timedelta(seconds=t), RANDOM.choice(["a", "b", None]), 5))
    rows += [("hot", 1, None, "a", 5)] + [("before", 1, dt.datetime(1969, 12, 31, 23, 59, s), "a", 5) for s in (1, 5, 30)]
    return spark.createDataFrame(rows, "flow string, port int, ts timestamp, src string, _piece int")


def as_set(df):
    out = [tuple(r) for r in df.collect()]
    assert len(out) == len(set(out))
    return set(out)


@pytest.mark.parametrize("stretch", [1, 3, 4096])
@pytest.mark.parametrize("keys", [["flow"], ["flow", "port"]])
def test_equal_to_session_windows(spark, monkeypatch, stretch, keys):
    monkeypatch.setattr(flows, "STRETCH", stretch)
    df, forward = packets(spark), F.col("src") == "a"
    columns = [*keys, "start_time", "end_time", "duration", "packets", "forward_packets", "backward_packets"]
    want = flows.sessions(df, keys, "ts", "10 seconds", forward).select(columns)
    assert as_set(flows.split_sessions(df, keys, "ts", 10.0, forward).select(columns)) == as_set(want)


def test_no_packets_and_no_gap(spark):
    df = packets(spark)
    assert flows.split_sessions(df.where("ts IS NULL"), ["flow"], "ts", 10.0, F.lit(True)).count() == 0
    with pytest.raises(ValueError):
        flows.split_sessions(df, ["flow"], "ts", 0, F.lit(True))
