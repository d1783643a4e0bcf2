"""Ranking alternatives: AHP weights, TOPSIS closeness and the Pareto front."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowcairn.functions.numeric import quoted
from flowcairn.operators.ordering import bucket_edges, global_rank, with_buckets
from flowcairn.operators.scores import with_extremes
from flowcairn.session import cut_lineage

# Random consistency index by number of criteria.
RANDOM_INDEX = {1: 0.0, 2: 0.0, 3: 0.58, 4: 0.90, 5: 1.12, 6: 1.24, 7: 1.32, 8: 1.41, 9: 1.45, 10: 1.49}
# Default comparisons and preferences of the three evaluation dimensions.
DEFAULT_COMPARISONS = {
    ("Detection Performance", "Resource Efficiency"): 3.0,
    ("Detection Performance", "Explainability"): 2.0,
    ("Resource Efficiency", "Explainability"): 0.5,
}
DEFAULT_PREFERENCES = {
    "dimension1_performance": 0.5,
    "dimension2_resources": 0.3,
    "dimension3_explainability": 0.2,
}


@dataclass(frozen=True)
class AhpResult:
    """Criteria weights and the consistency of the comparisons they come from."""

    criteria: list[str]
    weights: list[float]
    consistency_ratio: float

    def is_consistent(self, threshold: float = 0.1) -> bool:
        return self.consistency_ratio <= threshold

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(zip(self.criteria, self.weights)), "criterion string, weight double")


def ahp(criteria: list[str], comparisons: dict[tuple[str, str], float]) -> AhpResult:
    """Principal eigenvector of the pairwise matrix; a handful of criteria, so plain numpy."""
    n = len(criteria)
    at = {c: i for i, c in enumerate(criteria)}
    matrix = np.ones((n, n))
    for (a, b), value in comparisons.items():
        if value <= 0:
            raise ValueError("comparisons must be positive")
        matrix[at[a], at[b]], matrix[at[b], at[a]] = value, 1.0 / value
    values, vectors = np.linalg.eig(matrix)
    top = int(np.argmax(values.real))
    weights = vectors[:, top].real
    weights = weights / weights.sum()
    index = RANDOM_INDEX.get(n, RANDOM_INDEX[10])
    ratio = (values[top].real - n) / (n - 1) / index if n > 1 and index > 0 else 0.0
    return AhpResult(list(criteria), [float(w) for w in weights], float(ratio))


def preferences(given: dict[str, float] | None = None, rescale: bool = False) -> dict[str, float]:
    """Validated dimension weights; ``rescale`` divides user-given ones by their sum."""
    weights = dict(given or DEFAULT_PREFERENCES)
    total = sum(weights.values())
    if rescale and total > 0:
        weights = {k: v / total for k, v in weights.items()}
    elif abs(total - 1.0) > 1e-6:
        raise ValueError(f"preferences must sum to 1, got {total}")
    return weights


def topsis(
    df: DataFrame, criteria: list[str], weights: list[float], kinds: list[str] | None = None, score: str = "score"
) -> DataFrame:
    """Add distances to the ideal and anti-ideal alternative and the closeness ``score``.

    One aggregate gives norms and extremes of all criteria; the rest is arithmetic per row.
    """
    kinds = kinds or ["max"] * len(criteria)
    if not len(kinds) == len(weights) == len(criteria):
        raise ValueError("criteria, weights and kinds must have the same length")
    total = sum(weights)
    fields = []
    for i, c in enumerate(criteria):
        v = F.col(quoted(c)).cast("double")
        fields += [F.sqrt(F.sum(v * v)).alias(f"n{i}"), F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}")]
    out = df.withColumn("_t", df.agg(F.struct(*fields)).scalar())
    to_best: Column = F.lit(0.0)
    to_worst: Column = F.lit(0.0)
    for i, (c, w, kind) in enumerate(zip(criteria, weights, kinds)):
        scale = F.coalesce(F.try_divide(F.lit(w / total), F.col(f"_t.n{i}")), F.lit(0.0))
        best, worst = (f"_t.hi{i}", f"_t.lo{i}") if kind == "max" else (f"_t.lo{i}", f"_t.hi{i}")
        v = F.col(quoted(c)).cast("double")
        to_best = to_best + F.pow((v - F.col(best)) * scale, 2)
        to_worst = to_worst + F.pow((v - F.col(worst)) * scale, 2)
    return (
        out.withColumns({"distance_best": F.sqrt(to_best), "distance_worst": F.sqrt(to_worst)})
        .withColumn(score, F.col("distance_worst") / (F.col("distance_best") + F.col("distance_worst") + F.lit(1e-10)))
        .drop("_t")
    )


def rank_alternatives(scored: DataFrame, name: str, score: str = "score", digits: int = 9) -> DataFrame:
    """Rank 1 = best score; scores equal to ``digits`` digits are ordered by seeded name.

    Ranking reads the scores four times, so they are materialised once (an action).
    """
    ready = cut_lineage(scored.withColumn("_ranked", F.round(score, digits)))
    return global_rank(ready, "_ranked", name).drop("_ranked")


def decision_matrix(
    results: DataFrame,
    model: str = "model_name",
    f1: str = "f1_score",
    time: str = "training_time_seconds",
    explainability: str = "explainability_score",
) -> DataFrame:
    """Three criteria per model in [0, 1]; a criterion equal for all models keeps its value."""
    tmax = results.agg(F.max(quoted(time))).scalar()
    raw = results.select(
        F.col(quoted(model)).alias("alternative"),
        F.col(quoted(f1)).alias("performance"),
        (F.lit(1.0) / (F.lit(1.0) + F.coalesce(F.try_divide(F.col(quoted(time)), tmax), F.lit(0.0)))).alias("resources"),
        F.col(quoted(explainability)).alias("explainability"),
    )
    names = ["performance", "resources", "explainability"]
    spread = with_extremes(raw, names)
    return spread.select(
        "alternative",
        *[
            F.when(
                F.col(f"_x.hi{i}") > F.col(f"_x.lo{i}"),
                (F.col(c) - F.col(f"_x.lo{i}")) / (F.col(f"_x.hi{i}") - F.col(f"_x.lo{i}")),
            )
            .otherwise(F.col(c))
            .alias(c)
            for i, c in enumerate(names)
        ],
    )


def rank_models(
    results: DataFrame,
    comparisons: dict[tuple[str, str], float] | None = None,
    weights: list[float] | None = None,
    **columns,
) -> DataFrame:
    """Decision matrix, AHP weights, TOPSIS score and rank of evaluated models.

    ``weights`` (performance, resources, explainability) replace the AHP comparisons.
    """
    criteria = ["Detection Performance", "Resource Efficiency", "Explainability"]
    weights = weights or ahp(criteria, comparisons or DEFAULT_COMPARISONS).weights
    matrix = cut_lineage(decision_matrix(results, **columns))
    scored = topsis(matrix, ["performance", "resources", "explainability"], weights)
    return rank_alternatives(scored, "alternative").select("alternative", "score", "rank")


def _front(points: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """Rows of ``points`` and ``kept`` that nothing in either dominates; larger is better."""
    both = np.unique(np.vstack([kept, points]), axis=0)
    order = np.argsort(-both.sum(axis=1), kind="stable")  # a dominating row has the larger sum
    front = np.empty_like(both)
    size = 0
    for i in order:
        row = both[i]
        if size and ((front[:size] >= row).all(axis=1)).any():
            continue
        front[size] = row
        size += 1
    return front[:size]


def _dominated(points: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Which rows of ``points`` some row of ``others`` dominates."""
    out = np.zeros(len(points), dtype=bool)
    for i, row in enumerate(points):
        better = (others >= row).all(axis=1)
        out[i] = better.any() and (others[better] > row).any()
    return out


def _window(points: np.ndarray, kept: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Points that nothing seen so far dominates, and the strongest ``most`` rows to compare the next ones with."""
    front = _front(points, np.empty((0, points.shape[1])))
    if len(kept):
        front = front[~_dominated(front, kept)]
    both = np.unique(np.vstack([kept, front]), axis=0)
    return front, both[np.argsort(-both.sum(axis=1), kind="stable")[:most]]


def open_cells(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells of a grid that no other one rules out, and the (cell, other) pairs whose rows must be compared.

    A cell whose corner lies above another one's on every side beats all of its rows, so that cell is
    discarded. Rows of the others can be beaten only from cells that are nowhere below.
    """
    alive = np.array([not (cells > c).all(axis=1).any() for c in cells], dtype=bool)
    pairs = [(i, j) for i in np.flatnonzero(alive) for j in np.flatnonzero((cells >= cells[i]).all(axis=1) & alive)]
    return alive, np.array(pairs, dtype=np.int64).reshape(-1, 2)


MOST_CELLS = 4096


def pareto_front(
    df: DataFrame, maximize: list[str], minimize: list[str], broadcast_rows: int = 50_000, slice_rows: int = 5_000
) -> DataFrame:
    """Rows that no other row beats on every criterion; rows with a missing criterion are left out.

    Distinct criteria are first compared with the strongest rows of their task, a bounded number, and only
    what is left goes on. It is broadcast while its count is under ``broadcast_rows``. More rows are dealt
    to the cells of a grid along the quantiles of each criterion: cells that another cell beats as a whole
    are discarded, and rows meet only rows of cells that can beat theirs, in slices of bounded row count.
    Counting what is left is an action.
    """
    names = [*maximize, *minimize]
    signs = [1.0] * len(maximize) + [-1.0] * len(minimize)
    cols = [f"_p{i}" for i in range(len(names))]
    valued = df.withColumns(
        {p: F.col(quoted(c)).cast("double") * F.lit(s) for p, c, s in zip(cols, names, signs)}
    ).where(" AND ".join(f"{p} IS NOT NULL AND NOT isnan({p})" for p in cols))
    schema = T.StructType([T.StructField(p, T.DoubleType()) for p in cols])

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = np.empty((0, len(cols)))
        for batch in batches:
            front, kept = _window(batch.to_numpy(dtype=float), kept, slice_rows)
            yield pd.DataFrame(front, columns=cols)

    survivors = cut_lineage(valued.select(*cols).mapInPandas(local, schema).distinct())
    count = survivors.count()
    if count <= broadcast_rows:
        rows = np.array([tuple(r) for r in survivors.collect()], dtype=float).reshape(-1, len(cols))
        shared = df.sparkSession.sparkContext.broadcast(rows)

        def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield batch[~_dominated(batch.to_numpy(dtype=float), shared.value)]

        front = survivors.repartition(*cols).mapInPandas(check, schema)
    else:
        front = _front_by_cells(survivors, cols, schema, count, slice_rows)
    return valued.join(front, cols, "left_semi").select(*[quoted(c) for c in df.columns])


def _front_by_cells(survivors: DataFrame, cols: list[str], schema, count: int, slice_rows: int) -> DataFrame:
    side = max(2, min(int(MOST_CELLS ** (1 / len(cols))), 2 * math.ceil(count / slice_rows)))
    edges = {c: e for c, e in bucket_edges(survivors, cols, side).items() if e}  # few numbers per criterion
    placed = with_buckets(survivors, edges, "_cell") if edges else survivors
    cell = F.array(*[F.col(c + "_cell") if c in edges else F.lit(0) for c in cols])
    placed = placed.select(*cols, cell.alias("_cell"))
    sizes = placed.groupBy("_cell").count().collect()  # at most MOST_CELLS or 2 ** criteria cells
    cells = np.array([r["_cell"] for r in sizes]).reshape(-1, len(cols))
    alive, pairs = open_cells(cells)
    slices = [math.ceil(r["count"] / slice_rows) for r in sizes]
    spark = survivors.sparkSession
    named = spark.createDataFrame(
        [(list(map(int, c)), i, n) for i, (c, n) in enumerate(zip(cells, slices)) if alive[i]], "_cell array<int>, _no int, _slices int"
    )
    rows = placed.join(F.broadcast(named), "_cell").withColumn("_slice", F.pmod(F.xxhash64(*cols), F.col("_slices")).cast("int"))
    rows = rows.select(*cols, "_no", "_slice")
    # A row of a cell goes to every slice of the cells that can beat it.
    met = spark.createDataFrame([(int(i), int(j), slices[j], slices[i]) for i, j in pairs], "_no int, _other int, _theirs int, _ours int")
    met = F.broadcast(met)  # pairs of cells
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    key = ["_i", "_a", "_j", "_b"]
    left = rows.join(met, "_no").select(*cols, F.col("_no").alias("_i"), F.col("_slice").alias("_a"), F.col("_other").alias("_j"), every("_theirs").alias("_b"))
    right = rows.toDF(*cols, "_other", "_slice").join(met, "_other").select(
        *cols, F.col("_no").alias("_i"), every("_ours").alias("_a"), F.col("_other").alias("_j"), F.col("_slice").alias("_b")
    )

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return a[cols].iloc[:0]
        return a[cols][_dominated(a[cols].to_numpy(dtype=float), b[cols].to_numpy(dtype=float))]

    beaten = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(meet, schema)
    return rows.select(*cols).join(beaten.distinct(), cols, "left_anti")
