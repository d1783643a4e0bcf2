"""Parameter search: randomized with cross-validation, and one-by-one sweeps on a validation set."""

from __future__ import annotations

import itertools
import json
import random
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowcairn.operators.metrics import classification_by_group, roc_auc
from flowcairn.operators.splits import fold_pair, stratified_folds
from flowcairn.plans.models import TUNING_GRIDS, canonical_name, train_model
from flowcairn.session import cut_lineage, written_parts


def grid_points(grid: dict[str, list]) -> list[dict]:
    """Every combination of a parameter grid, in grid order."""
    names = list(grid)
    return [dict(zip(names, values)) for values in itertools.product(*grid.values())]


def _score(name, train, test, features, label, row_id, params, seed):
    trained = train_model(name, train, features, label, params, row_id=row_id, seed=seed)
    scored = cut_lineage(trained.score(test, row_id).select(label, "score", "prediction"))
    m = classification_by_group(scored, [], label).first()
    return m["f1"], m["accuracy"], roc_auc(scored, "score", label).first()["auc"]


SWEEP_SCHEMA = "algo string, no int, params string, f1 double, accuracy double, auc double, best boolean"


def _table(spark, rows, by):
    best = max(range(len(rows)), key=lambda i: (rows[i][by] is not None, rows[i][by] or 0.0, -i))
    return spark.createDataFrame([(*r, i == best) for i, r in enumerate(rows)], SWEEP_SCHEMA)


def sweep(
    name: str, train: DataFrame, validation: DataFrame, features: list[str], label: str = "label",
    row_id: str | None = None, points: list[dict] | None = None, seed: int = 42,
) -> DataFrame:
    """F1, accuracy and AUC per parameter point, fitted on train and scored on validation; best by F1."""
    points = points or grid_points(TUNING_GRIDS[canonical_name(name)])
    train, validation = cut_lineage(train), cut_lineage(validation)
    rows = []
    for i, p in enumerate(points):
        f1, accuracy, auc = _score(name, train, validation, features, label, row_id, p, seed)
        rows.append((name, i, json.dumps(p, sort_keys=True), f1, accuracy, auc))
    return _table(train.sparkSession, rows, 3)


def random_search(
    name: str, df: DataFrame, features: list[str], label: str = "label", row_id: str = "id",
    grid: dict[str, list] | None = None, n_iter: int = 5, k: int = 3, parallel: int = 5, seed: int = 42,
) -> DataFrame:
    """Mean cross-validated scores of ``n_iter`` seeded grid points; best by accuracy.

    The folded table is written once; points × folds run side by side, ``parallel`` at a time.
    """
    points = grid_points(grid or TUNING_GRIDS[canonical_name(name)])
    if len(points) > n_iter:
        points = random.Random(seed).sample(points, n_iter)
    folded = written_parts(stratified_folds(df.select(row_id, *features, label), label, [row_id], k, seed), "fold")

    def one(task: tuple[dict, int]) -> tuple:
        train, test = fold_pair(folded, task[1])
        return _score(name, train.drop("fold"), test.drop("fold"), features, label, row_id, task[0], seed)

    with ThreadPoolExecutor(max_workers=max(1, parallel)) as pool:
        found = list(pool.map(one, [(p, fold) for p in points for fold in range(k)]))
    rows = []
    for i, p in enumerate(points):
        scores = found[i * k : (i + 1) * k]
        present = [[s[j] for s in scores if s[j] is not None] for j in range(3)]  # a fold of one class has no AUC
        means = [sum(v) / len(v) if v else None for v in present]
        rows.append((name, i, json.dumps(p, sort_keys=True), *means))
    return _table(df.sparkSession, rows, 4)


def best_params(table: DataFrame) -> dict:
    """Parameters of the best row."""
    return json.loads(table.where(F.col("best")).first()["params"])
