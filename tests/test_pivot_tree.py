"""Balls of a pivot tree hold their rows, leave out most cells, and the search by them is exact."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowcairn.operators import neighbors
from flowcairn.operators.neighbors import PivotTree, knn_join


def clustered(n, seed):
    rng = np.random.default_rng(seed)
    return rng.uniform(-50, 50, (40, 3))[rng.integers(0, 40, n)] + rng.normal(0, 1, (n, 3))


def test_visits_few_cells_and_misses_none():
    x = clustered(6000, 1)
    tree = PivotTree(np.unique(x[:400], axis=0))
    cell, gaps = tree.descend(x)
    assert max(map(len, gaps)) >= 2 and len(set(cell.tolist())) > 200
    far = {int(c): [max(g[i] for g, own in zip(gaps, cell) if own == c) for i in range(len(tree.leaves[c]))] for c in set(cell.tolist())}
    tree.measure({int(c): int((cell == c).sum()) for c in far}, far, 1)
    q = clustered(50, 2)
    d = np.sqrt(((q[:, None] - x[None]) ** 2).sum(axis=2))
    bound = np.sort(d, axis=1)[:, 4]
    row, leaf = tree.visit(q, bound)
    seen = set(zip(row.tolist(), leaf.tolist()))
    for i in range(50):
        for j in np.flatnonzero(d[i] <= bound[i]):
            assert (i, int(cell[j])) in seen
    assert len(seen) < 0.2 * 50 * len(far)
    assert len(tree.visit(q, np.full(50, np.inf))[0]) == 50 * len(far)


@pytest.mark.parametrize("pivots", [None, 3, 200])
def test_join_is_exact(spark, pivots):
    x = np.vstack([clustered(900, 3), np.zeros((60, 3))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>").repartition(3)
    out = knn_join(df, df, 4, "id", "id", "vec", skip_self=True, broadcast_bytes=0, slice_rows=50, pivots=pivots).collect()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    want = {(i, int(j), r + 1) for i in range(len(x)) for r, j in enumerate(np.argsort(d[i], kind="stable")[:4])}
    assert {(r["query_id"], r["neighbor_id"], r["rank"]) for r in out} == want


def test_one_point_and_equal_points(spark):
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], "id long, vec array<double>")
    out = knn_join(same, same, 2, "id", "id", "vec", skip_self=True, broadcast_bytes=0)
    assert out.count() == 10 and out.agg(F.max("distance")).first()[0] == 0.0


def test_vectors_without_clusters_meet_in_blocks(spark, monkeypatch):
    """A tree prunes nothing here: blocks are dealt, not a copy of every query per cell."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(2500, 32))
    x[100:130] = x[7]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>").repartition(3)
    monkeypatch.setattr(neighbors, "_slice_join", None)
    out = knn_join(df, df, 4, "id", "id", "vec", ("vec",), skip_self=True, broadcast_bytes=0, pivots=120).collect()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    want = {(i, int(j), r + 1) for i in range(len(x)) for r, j in enumerate(np.argsort(d[i], kind="stable")[:4])}
    assert {(r["query_id"], r["neighbor_id"], r["rank"]) for r in out} == want
    assert all(r["vec"] == x[r["neighbor_id"]].tolist() for r in out)


def test_nearest_of_odd_vectors():
    """Missing, infinite and huge numbers, self to skip and fewer rows than asked for."""
    r = np.array([[0.0, 0.0], [np.nan, 1.0], [np.inf, 0.0], [1e200, 0.0], [3.0, 4.0], [0.0, 0.0], [1e200, 3.0]])
    rows, dist = neighbors._nearest(r, r, np.arange(7), 3)
    assert rows[0].tolist() == [5, 4, -1] and dist[0, :2].tolist() == [0.0, 5.0]
    assert rows[3].tolist() == [6, -1, -1] and dist[3, 0] == 3.0
    assert (rows[1] == -1).all() and (rows[2] == -1).all()
    assert neighbors._nearest(r[:1], r[:2], np.array([0]), 3)[0].tolist() == [[-1, -1]]
    same = np.zeros((700, 3))
    assert neighbors._nearest(same[:2], same, np.array([0, -1]), 2)[0].tolist() == [[1, 2], [0, 1]]
