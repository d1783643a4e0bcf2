"""Gradient boosting for any number of classes: softmax loss, one regression tree per class and round.

Rows are binned once and packed into blocks of bytes. All trees of a round grow together, level by level:
every task adds up gradients and curvatures of its blocks per class, node, feature and bin, the sums of a
(class, feature) meet in one group that returns the best split of each node, and only those reach the
driver. Scores of the rows are recomputed from the trees since the blocks were written last, so a lost
executor costs its blocks and nothing else.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from flowcairn.functions.numeric import quoted
from flowcairn.operators.ordering import bucket_edges
from flowcairn.session import cut_lineage, let_go

BINS = 64
BLOCK_ROWS = 8192
SINGLE_TASK_ROWS = 32_768
ROUNDS_A_WRITE = 10  # rounds after which blocks are written with their scores
LAMBDA = 1.0  # added to the curvature of a node
LEAST_CURVATURE = 1.0  # of a child


@dataclass
class Tree:
    """A tree over bins, by node number; node ``i`` goes on at ``2 i + 1`` and, above the bin, ``2 i + 2``."""

    feature: np.ndarray
    above: np.ndarray
    value: np.ndarray  # what a row that ends here adds; nodes that split hold 0
    gain: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        n = (2 << depth) - 1
        return cls(np.full(n, -1, np.int32), np.zeros(n, np.int32), np.zeros(n), np.zeros(n))

    def node_of(self, columns: np.ndarray, levels: int) -> np.ndarray:
        """The node each row has reached after so many levels; ``columns`` has a line of bins per feature.

        Every node that is met compares a whole column; small numbers of all rows are added up, none is looked up.
        """
        kind = np.uint8 if len(self.feature) <= 256 else np.int32
        at = np.zeros(columns.shape[1], dtype=kind)

        def walk(node: int, here: np.ndarray | None, left: int) -> None:
            if left and self.feature[node] >= 0:
                right = columns[self.feature[node]] > self.above[node]
                walk(2 * node + 1, ~right if here is None else here & ~right, left - 1)
                walk(2 * node + 2, right if here is None else here & right, left - 1)
            elif node:
                np.add(at, here.view(np.uint8) * kind(node), out=at)

        walk(0, None, levels)
        return at


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _add_trees(scores: np.ndarray, columns: np.ndarray, rounds: list[list[Tree]], depth: int) -> np.ndarray:
    scores = scores.copy()
    for trees in rounds:
        for k, tree in enumerate(trees):
            scores[:, k] += tree.value[tree.node_of(columns, depth)]
    return scores


def _blocks(features: int, classes: int, prior: np.ndarray):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("order", kind="stable")
        bins = np.stack(rows["bins"].to_list()).astype(np.uint8) if features else np.zeros((len(rows), 0), np.uint8)
        scores = np.tile(prior, (len(rows), 1))
        return pd.DataFrame({"n": [len(rows)], "bins": [bins.T.tobytes()], "label": [rows["label"].to_numpy("<i4").tobytes()],
                             "weight": [rows["weight"].to_numpy("<f8").tobytes()], "scores": [scores.astype("<f8").tobytes()]})

    return run


BLOCK = "n long, bins binary, label binary, weight binary, scores binary"


def _opened(row, features: int, classes: int):
    columns = np.frombuffer(row.bins, dtype=np.uint8).reshape(features, row.n)
    label, weight = np.frombuffer(row.label, dtype="<i4"), np.frombuffer(row.weight, dtype="<f8")
    return columns, label, weight, np.frombuffer(row.scores, dtype="<f8").reshape(row.n, classes)


def _histograms(rounds, growing, level, shape, together):
    """Per task: sums of gradient and curvature by class, feature, node of this level and bin.

    A row holds ``together`` features of a class.
    """
    features, classes, bins_n, depth = shape

    def run(batches):
        first, width = (1 << level) - 1, 1 << level
        cells = width * bins_n
        sums = np.zeros((classes, 2, features * cells))
        loss = rows = drift = 0.0
        for batch in batches:
            for row in batch.itertuples(index=False):
                columns, label, weight, scores = _opened(row, features, classes)
                p = softmax(_add_trees(scores, columns, rounds, depth))
                at = np.arange(len(label))
                loss -= float((weight * np.log(np.maximum(p[at, label], 1e-300))).sum())
                rows += float(weight.sum())
                g = -p
                g[at, label] += 1.0
                drift = max(drift, float(np.abs(g.sum(axis=1)).max(initial=0.0)))
                h = p * (1.0 - p)
                places = columns.astype(np.intp)
                for k in range(classes):
                    at, node, parts = places, None, [(x[:, k] * weight) for x in (g, h)]
                    if level:
                        node = growing[k].node_of(columns, level).astype(np.intp) - first
                        here = node >= 0  # a row that ended earlier is above this level
                        if not here.all():
                            at, node, parts = places[:, here], node[here], [x[here] for x in parts]
                        node *= bins_n
                    for f in range(features):
                        cell, spot = at[f] if node is None else at[f] + node, slice(f * cells, (f + 1) * cells)
                        for i, part in enumerate(parts):
                            sums[k, i, spot] += np.bincount(cell, part, cells)
        if rows:
            parts = sums.reshape(classes, 2, features, cells)
            out = [
                (k, f // together, np.moveaxis(parts[k, :, f : f + together], 0, 2).tobytes(), loss, rows, drift)
                for k in range(classes) for f in range(0, features, together)
            ]
            yield pd.DataFrame(out, columns=["k", "part", "sums", "loss", "rows", "drift"])

    return run


def _best_splits(level: int, bins_n: int, together: int):
    """The best split of each node by one feature, with the sums left of it and of the whole node."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        nodes = 1 << level
        sums = np.sum([np.frombuffer(x, dtype="<f8") for x in rows["sums"]], axis=0).reshape(-1, nodes, bins_n, 2)
        left = np.cumsum(sums, axis=2)
        total = left[:, :, -1:, :]
        right = total - left
        value = lambda s: s[..., 0] ** 2 / (s[..., 1] + LAMBDA)
        gain = value(left) + value(right) - value(total)
        gain[(left[..., 1] < LEAST_CURVATURE) | (right[..., 1] < LEAST_CURVATURE)] = -1.0
        best = gain[:, :, :-1].argmax(axis=2)
        f, node = (x.ravel() for x in np.indices(best.shape))
        at = f, node, best.ravel()
        return pd.DataFrame({
            "k": int(key[0]), "feature": int(key[1]) * together + f, "node": node, "gain": gain[at], "above": best.ravel(),
            "left_g": left[at][:, 0], "left_h": left[at][:, 1], "g": total[f, node, 0, 0], "h": total[f, node, 0, 1],
            "loss": rows["loss"].sum(), "rows": rows["rows"].sum(), "drift": rows["drift"].max(),
        })

    return run


_SUMS = "k int, part int, sums binary, loss double, rows double, drift double"
_SPLITS = "k int, feature int, node int, gain double, above int, left_g double, left_h double, g double, h double, loss double, rows double, drift double"


def _rewritten(rounds, shape):
    features, classes, _, depth = shape

    def run(batches):
        for batch in batches:
            scores = []
            for row in batch.itertuples(index=False):
                columns, _, _, held = _opened(row, features, classes)
                scores.append(_add_trees(held, columns, rounds, depth).astype("<f8").tobytes())
            yield batch.assign(scores=scores)

    return run


@dataclass
class SoftmaxBoosting:
    """A fitted model. ``history`` has a row per round: log loss before it, and the largest sum of a row's gradients."""

    features: list[str]
    classes: int
    edges: list[np.ndarray]
    prior: np.ndarray
    rounds: list[list[Tree]] = field(default_factory=list)
    history: list[tuple[int, float, float]] = field(default_factory=list)
    depth: int = 0
    bins: int = BINS

    @property
    def importances(self) -> np.ndarray:
        """Share of the gain that splits on each feature brought; 0 everywhere without a split."""
        out = np.zeros(len(self.features))
        for trees in self.rounds:
            for tree in trees:
                np.add.at(out, tree.feature[tree.feature >= 0], tree.gain[tree.feature >= 0])
        return out / out.sum() if out.sum() else out

    def probabilities(self) -> Column:
        """An array of class probabilities from the feature columns."""
        edges, rounds, depth, prior, missing = self.edges, self.rounds, self.depth, self.prior, self.bins - 1

        @pandas_udf("array<double>")
        def of(values: pd.Series) -> pd.Series:
            x = np.stack(values.to_list()).astype(np.float64) if len(values) else np.zeros((0, len(edges)))
            return pd.Series(list(softmax(_add_trees(np.tile(prior, (len(x), 1)), _binned(x, edges, missing).T.copy(), rounds, depth))))

        return of(F.array(*[F.coalesce(F.col(quoted(c)).cast("double"), F.lit(float("nan"))) for c in self.features]))

    def score(self, df: DataFrame) -> DataFrame:
        """Add ``prediction`` (the likeliest class, the lowest of equal ones) and ``score``, the probability of class 1."""
        p = F.col("_p")
        out = df.withColumn("_p", self.probabilities())
        return out.withColumns({"score": p[1], "prediction": (F.array_position(p, F.array_max(p)) - 1).cast("int")}).drop("_p")


def _binned(x: np.ndarray, edges: list[np.ndarray], missing: int) -> np.ndarray:
    """Bin of each value: a value equal to an edge opens the next bin; missing values have a bin of their own, the last."""
    if not edges:
        return np.zeros((len(x), 0), np.uint8)
    found = np.stack([np.searchsorted(e, x[:, f], "right") for f, e in enumerate(edges)], axis=1)
    return np.where(np.isnan(x), missing, found).astype(np.uint8)


def fit_softmax_boosting(
    train: DataFrame, features: list[str], label: str, classes: int, rounds: int = 100, depth: int = 6,
    learning_rate: float = 0.3, weight: str | None = None, bins: int = BINS, block_rows: int = BLOCK_ROWS,
    single_task_rows: int = SINGLE_TASK_ROWS,
) -> SoftmaxBoosting:
    """Fit on whole-number labels from 0 to ``classes - 1``.

    Scores start at the log of the class shares (a class without rows starts far below). A leaf adds
    ``learning_rate * G / (H + 1)``; a node splits while a split gains and both sides keep enough
    curvature. Without features there is nothing to grow and the class shares stay. A table of at most
    ``single_task_rows`` rows is fitted inside one task by the same steps.
    """
    typed = train.select(
        F.col(quoted(label)).cast("int").alias("label"), (F.col(quoted(weight)).cast("double") if weight else F.lit(1.0)).alias("weight"),
        *[F.col(quoted(c)).cast("double").alias(f"x{i}") for i, c in enumerate(features)],
    )
    shares = typed.groupBy("label").agg(F.sum("weight").alias("w"), F.count(F.lit(1)).alias("n")).limit(classes + 1).collect()
    if any(r["label"] is None or not 0 <= r["label"] < classes for r in shares):
        raise ValueError(f"labels must be whole numbers from 0 to {classes - 1}")
    held = np.zeros(classes)
    for r in shares:
        held[r["label"]] = r["w"]
    rows = sum(r["n"] for r in shares)
    prior = np.log(np.maximum(held / max(held.sum(), 1e-300), 1e-9)) if rows else np.zeros(classes)
    names = [f"x{i}" for i in range(len(features))]
    cuts = bucket_edges(typed, names, bins - 1) if rows and names else {x: [] for x in names}
    edges = [np.array(cuts[x]) for x in names]
    model = SoftmaxBoosting(features, classes, edges, prior, depth=depth, bins=bins)
    if not rows or not features:
        return model

    @pandas_udf("array<int>")
    def binned(values: pd.Series) -> pd.Series:
        return pd.Series(list(_binned(np.stack(values.to_list()).astype(np.float64), edges, bins - 1).astype(np.int32)))

    values = F.array(*[F.coalesce(F.col(x), F.lit(float("nan"))) for x in names])
    order = F.xxhash64("label", "weight", *names)
    dealt = typed.select("label", "weight", binned(values).alias("bins"), order.alias("order"))
    blocks_n = -(-rows // block_rows)
    dealt = dealt.withColumn("block", F.pmod(F.monotonically_increasing_id(), F.lit(blocks_n)))
    shape = (len(features), classes, bins, depth)
    blocks = dealt.groupBy("block").applyInPandas(_blocks(len(features), classes, prior), BLOCK)
    if rows <= single_task_rows:
        fitted = blocks.groupBy().applyInPandas(_boosted_in_task(model, shape, rounds, learning_rate), "model binary")
        grown, model.history = pickle.loads(fitted.first()["model"])
        model.rounds = [[Tree(*arrays) for arrays in trees] for trees in grown]
        return model
    # Each task sends sums of a fixed size per level, so there are as many tasks as run at once, not as many as blocks.
    tasks = min(blocks_n, train.sparkSession.sparkContext.defaultParallelism)
    return _boost(model, _OnSpark(cut_lineage(blocks.repartition(tasks)), shape, tasks), rounds, learning_rate, depth)


class _OnSpark:
    """Blocks of a table: sums meet in groups of a bounded size, the best splits come to the driver."""

    def __init__(self, blocks: DataFrame, shape, tasks: int):
        self.blocks, self.shape, self.tasks = blocks, shape, tasks

    def splits(self, pending, growing, level: int) -> pd.DataFrame:
        bins = self.shape[2]
        together = max(1, min(16, (1 << 26) // ((16 * bins << level) * self.tasks)))
        sums = self.blocks.mapInPandas(_histograms(pending, growing, level, self.shape, together), _SUMS)
        return sums.groupBy("k", "part").applyInPandas(_best_splits(level, bins, together), _SPLITS).toPandas()  # classes x features x nodes

    def rewrite(self, pending) -> None:
        old, self.blocks = self.blocks, cut_lineage(self.blocks.mapInPandas(_rewritten(pending, self.shape), BLOCK))
        let_go(old)


class _InTask:
    """The same on the few blocks of a short table, inside one task."""

    def __init__(self, blocks: pd.DataFrame, shape):
        self.blocks, self.shape = blocks, shape

    def splits(self, pending, growing, level: int) -> pd.DataFrame:
        together = self.shape[0]
        sums = pd.concat(_histograms(pending, growing, level, self.shape, together)(iter([self.blocks])))
        best = _best_splits(level, self.shape[2], together)
        return pd.concat([best((k, 0), some) for k, some in sums.groupby("k")])

    def rewrite(self, pending) -> None:
        self.blocks = pd.concat(_rewritten(pending, self.shape)(iter([self.blocks])))


def _boosted_in_task(model: SoftmaxBoosting, shape, rounds: int, learning_rate: float):
    def run(blocks: pd.DataFrame) -> pd.DataFrame:
        grown = _boost(model, _InTask(blocks, shape), rounds, learning_rate, shape[3])
        trees = [[(t.feature, t.above, t.value, t.gain) for t in some] for some in grown.rounds]
        return pd.DataFrame({"model": [pickle.dumps((trees, grown.history))]})

    return run


def _boost(model: SoftmaxBoosting, data, rounds: int, learning_rate: float, depth: int) -> SoftmaxBoosting:
    """Grow the trees of every round level by level from the best splits of all nodes."""
    pending: list[list[Tree]] = []
    for number in range(rounds + 1):
        growing = [Tree.empty(depth) for _ in range(model.classes)]
        for level in range(depth):
            found = data.splits(pending, growing, level)
            if level == 0:
                model.history.append((number, float(found["loss"].iloc[0] / found["rows"].iloc[0]), float(found["drift"].iloc[0])))
                if number == rounds:
                    return model
            best = found.sort_values(["k", "node", "gain", "feature"], ascending=[True, True, False, True]).drop_duplicates(["k", "node"])
            split = False
            for r in best.itertuples(index=False):
                tree, at = growing[r.k], (1 << level) - 1 + r.node
                if level and tree.feature[(at - 1) // 2] < 0:
                    continue
                if level == 0:
                    tree.value[0] = learning_rate * r.g / (r.h + LAMBDA)
                if r.gain > 1e-12:
                    split = True
                    tree.feature[at], tree.above[at], tree.value[at], tree.gain[at] = r.feature, r.above, 0.0, r.gain
                    tree.value[2 * at + 1] = learning_rate * r.left_g / (r.left_h + LAMBDA)
                    tree.value[2 * at + 2] = learning_rate * (r.g - r.left_g) / (r.h - r.left_h + LAMBDA)
            if not split:
                break
        model.rounds.append(growing)
        pending.append(growing)
        if len(pending) == ROUNDS_A_WRITE:
            data.rewrite(pending)
            pending = []
    return model
