"""Neighbour-based mutual information against brute force, with slices of few rows and odd columns."""

import math
import random

import numpy as np
import pytest

from flowcairn.operators.information import select_top_k
from flowcairn.operators.neighbor_information import NOISE, digamma, neighbor_information

RANDOM = random.Random(3)


def brute(xs, labels, k=3):
    x, y = np.array(xs), np.array(labels)
    keep = np.array([(y == c).sum() > 1 for c in y], dtype=bool)
    x, y = x[keep], y[keep]
    if not len(x):
        return 0.0
    psi = lambda n: -np.euler_gamma + sum(1 / i for i in range(1, n))
    total = 0.0
    for i in range(len(x)):
        same = np.sort(np.abs(x[(y == y[i]) & (np.arange(len(x)) != i)] - x[i]))
        kk = min(k, len(same))
        r = same[kk - 1]
        inside = np.abs(x - x[i]) < r if r > 0 else x == x[i]
        total += psi(kk if r > 0 else int((inside & (y == y[i])).sum())) - psi(len(same) + 1) - psi(int(inside.sum()))
    return max(0.0, psi(len(x)) + total / len(x))


def noisy(rows, column, seed=42):
    import hashlib

    values = [r[column] for r in rows]
    fine = np.array([v for v in values if v is not None and math.isfinite(v)], dtype=float)
    size = max(fine.std(), np.abs(fine).mean()) if len(fine) else 0.0
    step = NOISE * 2.0 ** math.floor(math.log2(size)) if size else NOISE
    out = []
    for r in rows:
        u = int(hashlib.md5(f"{r['id']}|{seed}".encode()).hexdigest()[:12], 16) / float(1 << 47) - 1.0
        v = r[column]
        out.append((v + u * step, r["y"]) if v is not None and math.isfinite(v) and r["y"] is not None else None)
    return [x for x in out if x is not None]


def table(n):
    rows = []
    for i in range(n):
        y = RANDOM.choice(["a", "a", "a", "b", "b", "c"]) if i % 97 else None
        rows.append({
            "id": i, "y": "lonely" if i == 5 else y, "near": RANDOM.gauss({"a": 0, "b": 2, "c": 4}.get(y, 1), 1.0),
            "noise": RANDOM.random(), "zeros": 0.0 if RANDOM.random() < 0.8 else RANDOM.random() * 1e6,
            "grid": float(RANDOM.randrange(4)), "gaps": None if i % 3 == 0 else (math.inf if i % 7 == 0 else float(ord((y or "z")[0]))),
            "same": 7.0, "none": None,
        })
    return rows


COLUMNS = ["near", "noise", "zeros", "grid", "gaps", "same", "none"]


@pytest.mark.parametrize("slice_rows", [25, 100_000])
def test_equal_to_brute_force(spark, slice_rows):
    rows = table(420)
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "id long, y string, near double, noise double, zeros double, grid double, gaps double, same double, none double")
    got = {r["feature"]: r["mutual_information"] for r in neighbor_information(df, COLUMNS, "y", ["id"], slice_rows=slice_rows).collect()}
    for c in COLUMNS:
        pairs = noisy(rows, c)
        want = brute(*zip(*pairs)) if pairs else 0.0
        assert got[c] == pytest.approx(want, abs=1e-9), c
    assert got["near"] > got["noise"]
    assert select_top_k(df, ["noise", "near"], "y", 1, keys=["id"]) == ["near"]


def test_nothing_to_tell(spark):
    empty = spark.createDataFrame([], "id long, y string, x double")
    assert [tuple(r) for r in neighbor_information(empty, ["x"], "y", ["id"]).collect()] == [("x", 0.0)]
    one = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "id long, y string, x double")
    assert [tuple(r) for r in neighbor_information(one, ["x"], "y", ["id"]).collect()] == [("x", 0.0)]


def test_digamma():
    assert digamma(np.array([1, 2, 3])) == pytest.approx([-np.euler_gamma, 1 - np.euler_gamma, 1.5 - np.euler_gamma])
    harmonic = np.concatenate([[0], np.cumsum(1 / np.arange(1, 2000))]) - np.euler_gamma
    assert digamma(np.arange(1, 2001)) == pytest.approx(harmonic, abs=1e-13)
