"""Neighbours of short vectors: the sweep inside a cell, boxes of cells, and the limit of pairs that are broadcast."""

import numpy as np
import pandas as pd
import pytest

from flowcairn.operators import neighbors
from flowcairn.operators.balancing import resample


def table(n, seed):
    rng = np.random.default_rng(seed)
    return np.column_stack([rng.integers(0, 50, n) / 25, rng.integers(0, 9, n) / 4, rng.normal(size=n)])


@pytest.mark.parametrize("k", [1, 5, 400])
def test_sweep_equals_all_pairs(k):
    r = np.vstack([table(300, 1), np.tile(table(1, 2), (20, 1))])  # equal rows decide by their number
    for q, same in ((r, np.arange(len(r))), (table(150, 3), None), (table(150, 3) * 100, None)):
        rows, dist = neighbors._nearest(q, r, same, k)
        swept, gaps = neighbors._swept(q, r, same, k, None)
        assert (rows == swept).all() and (dist == gaps).all()
        bound = np.full(len(q), 0.2)
        bound[0] = np.nan  # unknown
        swept, gaps = neighbors._swept(q, r, same, k, bound)
        inside = (dist <= 0.2) | (np.arange(len(q)) == 0)[:, None]
        assert (np.where(inside, rows, -1) == np.where((gaps <= 0.2) | (np.arange(len(q)) == 0)[:, None], swept, -1)).all()


def test_boxes_leave_out_more_than_balls_and_miss_none():
    points = table(4000, 4)
    tree = neighbors.PivotTree(np.unique(points[:60], axis=0))
    cell, gaps = tree.descend(points)
    tree.measure({int(c): int(n) for c, n in zip(*np.unique(cell, return_counts=True))},
                 {int(c): np.max([g for g, x in zip(gaps, cell) if x == c], axis=0).tolist() for c in np.unique(cell)}, 5)
    bound = np.full(len(points), 0.1)
    by_balls = len(tree.visit(points, bound)[0])
    by_cell = pd.DataFrame(points).groupby(cell)
    low, high = by_cell.min(), by_cell.max()
    tree.bound({c: (low.loc[c].tolist(), high.loc[c].tolist()) for c in low.index})
    rows, cells = tree.visit(points, bound)
    assert len(rows) < 0.7 * by_balls
    met = set(zip(rows.tolist(), cells.tolist()))
    for i in range(0, 4000, 40):
        near = np.flatnonzero(np.sqrt(((points - points[i]) ** 2).sum(axis=1)) <= 0.1)
        assert all((i, c) in met for c in cell[near].tolist())


def test_many_pairs_go_by_cells(spark, monkeypatch):
    points = table(600, 5)
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id long, v array<double>")
    seen, cells = [], neighbors._by_cells
    monkeypatch.setattr(neighbors, "_by_cells", lambda *a: (seen.append(1), cells(*a))[1])
    take = lambda: sorted(map(tuple, neighbors.knn_join(df, df, 4, "id", "id", "v", skip_self=True).collect()))
    plain = take()
    assert not seen
    monkeypatch.setattr(neighbors, "SLICE_ROWS", 100)
    monkeypatch.setattr(neighbors, "BROADCAST_PAIRS", 1000)
    assert take() == plain and seen


def test_smote_reads_its_bases_once(spark, monkeypatch):
    from flowcairn.operators import balancing

    df = spark.createDataFrame([(str(i), float(i % 13), float(i % 7), int(i % 4 == 0)) for i in range(400)], "id string, a double, b double, label int")
    seen, cut = [], balancing.cut_lineage
    monkeypatch.setattr(balancing, "cut_lineage", lambda d: (seen.append(1), cut(d))[1])
    out = resample(df, ["a", "b"], "label", ["id"])
    assert {r["label"]: r["count"] for r in out.groupBy("label").count().collect()} == {0: 300, 1: 300} and len(seen) == 1


@pytest.mark.parametrize("kind", ["plain", "offset", "copies", "outlier", "nan", "huge"])
def test_single_precision_leaves_the_same_neighbours(kind, monkeypatch):
    rng = np.random.default_rng(4)
    r = rng.normal(size=(3000, neighbors.SWEEP_DIMENSIONS + 4))
    if kind == "offset":
        r += 1e6
    elif kind == "copies":
        r = 1.0 + np.repeat(r[:300], 10, axis=0) * 1e-7
    elif kind == "outlier":
        r[5] = 1e12
    elif kind == "nan":
        r[rng.random(r.shape) < 0.0005] = np.nan
    elif kind == "huge":
        r *= 1e200
    q, same = r[::7], np.arange(0, len(r), 7)
    with np.errstate(all="ignore"):
        squares = (q * q).sum(axis=1)
        found = neighbors._single(q, r, squares)
        assert (found is None) == (kind in ("nan", "huge"))
        if found is not None:
            left, right, error = found
            assert left.dtype == right.dtype == np.float32
            a, b = q - r.mean(axis=0), r - r.mean(axis=0)
            exact = (b * b).sum(axis=1) - 2.0 * a @ b.T
            assert (np.abs(left @ right - exact) <= error[:, None]).all()
        got = neighbors._nearest(q, r, same, 5)
        monkeypatch.setattr(neighbors, "_single", lambda *_: None)
        plain = neighbors._nearest(q, r, same, 5)
    assert (got[0] == plain[0]).all() and np.array_equal(got[1], plain[1])
