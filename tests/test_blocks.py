"""Blocked correlation, binned density and the cells of a Pareto front against plain versions."""

import random

import numpy as np
import pytest

from flowcairn.operators import decide, distribution, stats

RANDOM = random.Random(9)


def test_correlation_of_gaps_and_far_means(spark):
    rows = []
    for i in range(3000):
        a = RANDOM.gauss(0, 1)
        rows.append((1e9 + a, a + RANDOM.gauss(0, 1) if i % 3 else None, float("nan") if i % 5 == 0 else -a, 4.0, None, float(i == 7)))
    names = ["far", "gaps", "nan", "same", "none", "once"]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)).repartition(7)
    got = {(r["x"], r["y"]): r["corr"] for r in stats.gram_correlation(df, names).collect()}
    data = np.array([[np.nan if v is None else v for v in r] for r in rows])
    assert len(got) == 15
    for i, x in enumerate(names):
        for j, y in list(enumerate(names))[i + 1 :]:
            both = np.isfinite(data[:, i]) & np.isfinite(data[:, j])
            a, b = data[both, i], data[both, j]
            if len(a) < 2 or a.std() == 0 or b.std() == 0:
                assert got[x, y] is None, (x, y)
            else:
                assert got[x, y] == pytest.approx(np.corrcoef(a - a.mean(), b - b.mean())[0, 1], abs=1e-7), (x, y)
    plain = {(r["x"], r["y"]): r["corr"] for r in stats.correlation(df.where("gaps IS NOT NULL AND NOT isnan(nan)"), ["gaps", "nan"]).collect()}
    assert got["gaps", "nan"] == pytest.approx(plain["gaps", "nan"])


def test_correlation_of_no_rows(spark):
    df = spark.createDataFrame([], "a double, b double")
    assert [r["corr"] for r in stats.gram_correlation(df, ["a", "b"]).collect()] in ([], [None])


def test_binned_density_is_near_the_exact_one(spark):
    rows = [(RANDOM.choice(["a", "b", None]), RANDOM.gauss(5, 1) if RANDOM.random() < 0.9 else RANDOM.uniform(0.1, 80), "x") for _ in range(4000)] + [("one", 3.0, "x")]
    df = spark.createDataFrame(rows, "y string, v double, label string")
    exact = {(r["label"], r["grid_no"]): r["density"] for r in distribution.density_by_label(df, "v", "y").collect()}
    near = {(r["label"], r["grid_no"]): r["density"] for r in distribution.binned_density_by_label(df, "v", "y").collect()}
    assert exact.keys() == near.keys() and ("one", 0) not in near
    assert max(abs(exact[k] - near[k]) for k in exact) < 1e-3
    same = spark.createDataFrame([("a", 2.0)] * 5, "y string, v double")
    assert distribution.binned_density_by_label(same, "v", "y").count() == 200
    assert distribution.binned_density_by_label(same.where("v < 0"), "v", "y").count() == 0


@pytest.mark.parametrize("kind", ["apart", "together", "ties"])
def test_front_by_cells(spark, kind):
    rows = []
    for i in range(1500):
        a = RANDOM.random()
        b = {"apart": 1 - a + RANDOM.random() * 0.02, "together": a + RANDOM.random() * 0.1, "ties": float(RANDOM.randrange(3))}[kind]
        rows.append((i, round(a, 1) if kind == "ties" else a, b, None if i % 100 == 0 else float(i % 10)))
    df = spark.createDataFrame(rows, "id long, f double, g double, t double").repartition(4)
    full = [r for r in rows if r[3] is not None]
    beats = lambda p, q: p[1] >= q[1] and p[2] >= q[2] and p[3] <= q[3] and (p[1] > q[1] or p[2] > q[2] or p[3] < q[3])
    want = {q[0] for q in full if not any(beats(p, q) for p in full)}
    got = [r["id"] for r in decide.pareto_front(df, ["f", "g"], ["t"], broadcast_rows=0, slice_rows=40).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_cells_meet_far_less_than_all_pairs():
    rng = np.random.default_rng(1)
    x = rng.random((4000, 1))
    points = np.hstack([x, 1 - x + rng.random((4000, 1)) * 0.01])
    edges = [np.quantile(points[:, i], np.linspace(0, 1, 33)[1:-1]) for i in range(2)]
    place = np.stack([np.searchsorted(e, points[:, i], "right") for i, e in enumerate(edges)], axis=1)
    cells, at = np.unique(place, axis=0, return_inverse=True)
    alive, pairs = decide.open_cells(cells)
    sizes = np.bincount(at.ravel())
    assert sum(sizes[i] * sizes[j] for i, j in pairs) < 0.1 * len(points) ** 2
    assert all(alive[i] and alive[j] for i, j in pairs)


def test_statistic_from_few_buckets(spark):
    """D equals the plain one; most rows lie in buckets whose bounds rule them out."""
    rows = [(RANDOM.gauss(0, 1) if i % 2 else RANDOM.gauss(0.8, 1), RANDOM.choice([0.0, 0.0, 1.0, 2.5]), i % 2) for i in range(4000)] + [(None, 1.0, None)]
    df = spark.createDataFrame(rows, "a double, b double, side int")
    got = {r["feature"]: r for r in distribution.ks_two_sample(df, ["a", "b"], "side").collect()}
    for k, name in enumerate("ab"):
        x, y = (np.sort([r[k] for r in rows if r[k] is not None and (r[2] == 1) == second]) for second in (False, True))
        every = np.concatenate([x, y])
        d = np.abs(np.searchsorted(x, every, "right") / len(x) - np.searchsorted(y, every, "right") / len(y)).max()
        assert got[name]["ks_statistic"] == pytest.approx(d, abs=1e-12) and (got[name]["n"], got[name]["m"]) == (len(x), len(y))
    values = distribution._side_values(df, ["a"], "side")
    counts = values.selectExpr("feature", "bucket", "IF(_second, 0, 1) AS n0", "IF(_second, 1, 0) AS n1").groupBy("feature", "bucket").sum("n0", "n1").toDF("feature", "bucket", "n0", "n1")
    bounds = distribution.ks_bounds(counts).toPandas()
    held = bounds["n0"] + bounds["n1"]
    assert held[bounds["most"] > bounds["end_gap"].max()].sum() < 0.5 * held.sum()
