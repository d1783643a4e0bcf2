"""Exact quantiles by a sketch and one picking aggregate, against numpy; few jobs."""

import math
import random

import numpy as np
import pytest

from flowcairn.operators import quantiles as module
from flowcairn.operators.quantiles import quantiles

RANDOM = random.Random(4)
PROBS = [0.0, 0.001, 0.25, 0.5, 0.75, 0.999, 1.0]


@pytest.fixture(scope="module")
def rows(spark):
    data = []
    for i in range(30_000):
        data.append((
            RANDOM.gauss(0, 1), 0.0 if RANDOM.random() < 0.6 else RANDOM.random(), float(RANDOM.randrange(3)), None if i % 4 else RANDOM.expovariate(1),
            math.inf if i % 1000 == 0 else -float(i), None, 7.0,
        ))
    return spark.createDataFrame(data, "smooth double, zeros double, grid double, gaps double, ends double, none double, same double").cache()


@pytest.mark.parametrize(("single", "bracket", "picked"), [(50_000, 200_000, 2_000_000), (0, 200_000, 2_000_000), (0, 50, 2_000_000), (0, 200_000, 10)])
def test_equal_to_numpy(rows, monkeypatch, single, bracket, picked):
    monkeypatch.setattr(module, "PICKED_VALUES", picked)
    got = quantiles(rows, rows.columns, PROBS, single_pass_rows=single, bracket_rows=bracket)
    data = rows.toPandas()
    for c in rows.columns:
        values = data[c].to_numpy(dtype=float)
        values = values[np.isfinite(values)]
        if len(values):
            assert got[c] == pytest.approx(np.quantile(values, PROBS).tolist(), rel=1e-12), c
        else:
            assert got[c] == [None] * len(PROBS)


def test_two_jobs(spark, rows):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("quantiles", "two aggregates")
    try:
        quantiles(rows, ["smooth", "zeros", "grid"], [0.25, 0.5, 0.75], single_pass_rows=0)
        stages = {s for j in tracker.getJobIdsForGroup("quantiles") for s in tracker.getJobInfo(j).stageIds}
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(tracker.getJobIdsForGroup("quantiles")) <= 4 and len(stages) <= 6  # a map and a result stage for each aggregate


def test_no_rows(spark):
    empty = spark.createDataFrame([], "x double")
    assert quantiles(empty, ["x"], [0.5]) == {"x": [None]} and quantiles(empty, ["x"], [0.5], single_pass_rows=-1) == {"x": [None]}
    assert quantiles(empty, [], [0.5]) == {}


def test_brackets_are_counted_in_groups(rows):
    """Every bracket is counted by tasks in numpy and meets in a group of its own, never in one row of all."""
    found = []
    plan = module.DataFrame.mapInArrow

    class Frame:
        def __init__(self, df):
            self.df = df

        def select(self, *columns):
            return Frame(self.df.select(*columns))

        def mapInArrow(self, f, schema):
            found.append(schema)
            return plan(self.df, f, schema)

    brackets = {("grid", 0.5): module._Bracket("grid", 14_999, 15_000, 0.0, 2.0, 0, 30_000), ("same", 0.5): module._Bracket("same", 0, 0, 7.0, 7.0, 0, 30_000)}
    assert module._picked(Frame(rows), brackets) == {("grid", 0.5): (1.0, 1.0), ("same", 0.5): (7.0, 7.0)} and len(found) == 1
