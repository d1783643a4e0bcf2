"""Explanations of any scoring function: Shapley sampling, local surrogates and permutation importance.

``scorer`` takes a table with the feature columns and returns it with a ``score`` column. Every job
builds one exploded table and scores it once; permutation importance has a job per repeat. How many rows are explained is a parameter of these
operators; the table they explain is sampled exactly by row key.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowcairn.functions.numeric import quoted
from flowcairn.operators.neighbors import knn_join, vector_of
from flowcairn.operators.ordering import shuffled_rank
from flowcairn.operators.splits import sample_exact
from flowcairn.session import cut_lineage, scratch

Scorer = Callable[..., DataFrame]


def _spread(df: DataFrame, vector: Column, features: list[str]) -> DataFrame:
    """Feature columns out of one array column."""
    return df.withColumn("_v", vector).select("*", *[F.col("_v")[i].alias(c) for i, c in enumerate(features)]).drop("_v")


def _unit(*parts: Column) -> Column:
    bits = F.shiftrightunsigned(F.xxhash64(*parts), 11)
    return (bits.cast("double") + 0.5) / F.lit(float(1 << 53))


def shapley(
    scorer: Scorer,
    df: DataFrame,
    features: list[str],
    row_id: str,
    rows: int = 100,
    background: int = 20,
    permutations: int = 10,
    seed: int = 42,
) -> DataFrame:
    """(row_id, feature, attribution, base, prediction) by sampling feature orders.

    For every explained row and order, features move one by one from a background row to the explained
    row; a feature gets the mean change of the score when it moves. The attributions of a row sum to
    its score minus the mean score of its background rows.
    """
    d = len(features)
    chosen = sample_exact(df, [row_id], n=rows, seed=seed).select(
        F.col(quoted(row_id)).alias("_row"), vector_of(features).alias("_x")
    )
    base = shuffled_rank(df, [row_id], seed + 1, None, "_no", None).where(F.col("_no") <= background)
    base = base.select((F.col("_no") - 1).cast("int").alias("_no"), vector_of(features).alias("_b"))
    size = base.agg(F.count(F.lit(1))).scalar()
    runs = chosen.withColumn("_perm", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1)))).withColumn(
        "_no", F.pmod(F.xxhash64("_row", "_perm", F.lit(seed + 2)), size).cast("int")
    )
    order = F.transform(
        F.array_sort(
            F.array(*[F.struct(F.xxhash64("_row", "_perm", F.lit(seed + 3), F.lit(j)).alias("h"), F.lit(j).alias("j")) for j in range(d)])
        ),
        lambda s: s["j"],
    )
    steps = (
        runs.join(base, "_no")
        .withColumn("_order", order)
        .withColumn("_step", F.explode(F.sequence(F.lit(0), F.lit(d))))
        .withColumn("_moved", F.slice("_order", F.lit(1), F.col("_step")))
    )
    mixed = F.array(*[F.when(F.array_contains("_moved", j), F.col("_x")[j]).otherwise(F.col("_b")[j]) for j in range(d)])
    ready = _spread(steps, mixed, features).withColumn("_key", F.concat_ws("|", "_row", "_perm", "_step"))
    scored = scorer(ready.select("_key", "_row", "_perm", "_step", "_order", *[quoted(c) for c in features]), "_key")
    walk = W.partitionBy("_row", "_perm").orderBy("_step")  # d + 1 rows each
    moves = (
        scored.select("_row", "_perm", "_step", "_order", "score")
        .withColumns(
            {
                "_gain": F.col("score") - F.lag("score").over(walk),
                "_first": F.first("score").over(walk),
                "_last": F.last("score").over(walk.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)),
            }
        )
        .where("_step > 0")
        .withColumn("_j", F.get("_order", F.col("_step") - 1))
    )
    return (
        moves.groupBy("_row", "_j")
        .agg(F.avg("_gain").alias("attribution"), F.avg("_first").alias("base"), F.avg("_last").alias("prediction"))
        .select(
            F.col("_row").alias("row_id"),
            F.get(F.array(*[F.lit(c) for c in features]), F.col("_j")).alias("feature"),
            "attribution",
            "base",
            "prediction",
        )
    )


def mean_attribution(attributions: DataFrame) -> DataFrame:
    """Mean absolute attribution per feature."""
    return attributions.groupBy("feature").agg(F.avg(F.abs("attribution")).alias("importance"))


def _top_mean(table: DataFrame, column: str, k: int) -> float | None:
    return table.orderBy(F.desc(column), "feature").limit(k).agg(F.avg(column)).first()[0]


def shap_score(scorer: Scorer, df: DataFrame, features: list[str], row_id: str, top_k: int = 10, **options) -> float | None:
    """Mean of the ``top_k`` largest mean absolute attributions (an action)."""
    return _top_mean(mean_attribution(shapley(scorer, df, features, row_id, **options)), "importance", top_k)


def lime(
    scorer: Scorer,
    df: DataFrame,
    features: list[str],
    row_id: str,
    rows: int = 10,
    perturbations: int = 500,
    ridge: float = 1.0,
    seed: int = 42,
) -> DataFrame:
    """(row_id, feature, attribution, base, prediction): weights of a local linear surrogate per row.

    Normal perturbations in units of the column deviation, weighted by distance with a kernel of width
    0.75·√features, then one weighted ridge solve per explained row.
    """
    d = len(features)
    deviations = df.agg(F.array(*[F.coalesce(F.stddev_pop(quoted(c)), F.lit(0.0)) for c in features])).scalar()
    chosen = sample_exact(df, [row_id], n=rows, seed=seed).select(
        F.col(quoted(row_id)).cast("string").alias("_row"), vector_of(features).alias("_x")
    )
    exploded = chosen.withColumn("_sd", deviations).withColumn(
        "_no", F.explode(F.sequence(F.lit(0), F.lit(perturbations)))
    )

    def normal(j: int) -> Column:  # number 0 is the explained row itself
        u = _unit(F.col("_row"), F.col("_no"), F.lit(j), F.lit(seed))
        v = _unit(F.col("_row"), F.col("_no"), F.lit(j), F.lit(seed + 1))
        return F.when(F.col("_no") == 0, 0.0).otherwise(F.sqrt(F.lit(-2.0) * F.log(u)) * F.cos(F.lit(2 * math.pi) * v))

    moved = exploded.withColumn("_z", F.array(*[normal(j) for j in range(d)]))
    mixed = F.array(*[F.col("_x")[j] + F.col("_z")[j] * F.col("_sd")[j] for j in range(d)])
    ready = _spread(moved, mixed, features).withColumn("_key", F.concat_ws("|", "_row", "_no"))
    scored = scorer(ready.select("_key", "_row", "_no", "_z", *[quoted(c) for c in features]), "_key")
    width = 0.75 * math.sqrt(d)
    names = list(features)

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_no")
        z = np.stack(part["_z"].to_numpy())
        y = part["score"].to_numpy()
        w = np.sqrt(np.exp(-(z * z).sum(axis=1) / width**2))
        zc, yc = z - np.average(z, axis=0, weights=w), y - np.average(y, weights=w)
        beta = np.linalg.solve((zc * w[:, None]).T @ zc + ridge * np.eye(d), (zc * w[:, None]).T @ yc)
        base = float(np.average(y, weights=w) - np.average(z, axis=0, weights=w) @ beta)
        return pd.DataFrame(
            {"row_id": part["_row"].iloc[0], "feature": names, "attribution": beta, "base": base, "prediction": float(y[0])}
        )

    schema = "row_id string, feature string, attribution double, base double, prediction double"
    return scored.select("_row", "_no", "_z", "score").groupBy("_row").applyInPandas(solve, schema)


def lime_score(scorer: Scorer, df: DataFrame, features: list[str], row_id: str, top_k: int = 10, **options) -> float | None:
    """Mean absolute weight of the ``top_k`` features of every explained row (an action)."""
    local = lime(scorer, df, features, row_id, **options)
    place = F.row_number().over(W.partitionBy("row_id").orderBy(F.desc(F.abs("attribution")), "feature"))
    return local.withColumn("_k", place).where(F.col("_k") <= top_k).agg(F.avg(F.abs("attribution"))).first()[0]


def permutation_importance(
    scorer: Scorer, df: DataFrame, features: list[str], label: str, row_id: str, repeats: int = 10, seed: int = 42
) -> DataFrame:
    """(feature, importance_mean, importance_std): drop of accuracy when one column is shuffled.

    A repeat pairs every row with a donor row by two seeded numberings and scores rows × features; only its hit
    counts are collected. Repeats follow each other, so what is shuffled at a time does not grow with their number.
    """
    spark, d = df.sparkSession, len(features)
    found = []
    with scratch(spark):
        rows = df.select(F.col(quoted(row_id)).cast("string").alias("_row"), F.col(quoted(label)).cast("int").alias("_y"), vector_of(features).alias("_x"))
        spots = cut_lineage(shuffled_rank(rows, ["_row"], seed, None, "_no", None))

        def accuracy(table: DataFrame, vector: Column) -> list:
            keyed = _spread(table, vector, features).select("_row", "_y", "_repeat", "_j", *[quoted(c) for c in features])
            keyed = keyed.withColumn("_key", F.concat_ws("|", "_row", "_repeat", "_j"))
            hits = F.avg((F.col("prediction") == F.col("_y")).cast("double")).alias("_acc")
            return scorer(keyed, "_key").groupBy("_repeat", "_j").agg(hits).collect()  # a row per feature

        def shuffled(repeat: int) -> list:
            donors = spots.select("_row", F.col("_x").alias("_d"), F.lit(repeat).alias("_repeat"))
            donors = shuffled_rank(donors, ["_row", "_repeat"], seed + 1, None, "_no", None).drop("_row")
            paired = spots.join(donors, "_no").withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(d - 1))))
            mixed = F.array(*[F.when(F.col("_j") == j, F.col("_d")[j]).otherwise(F.col("_x")[j]) for j in range(d)])
            return accuracy(paired, mixed)

        found += accuracy(spots.withColumns({"_repeat": F.lit(0), "_j": F.lit(-1)}), F.col("_x"))
        for repeat in range(1, repeats + 1):
            with scratch(spark):
                found += shuffled(repeat)
    measured = spark.createDataFrame([tuple(r) for r in found], "_repeat int, _j int, _acc double")
    # One row per repeat and feature from here on.
    reference = F.max(F.when(F.col("_j") == -1, F.col("_acc"))).over(W.partitionBy(F.lit(0)))
    drops = measured.withColumn("_drop", reference - F.col("_acc")).where("_j >= 0")
    return drops.groupBy(F.get(F.array(*[F.lit(c) for c in features]), F.col("_j")).alias("feature")).agg(
        F.avg("_drop").alias("importance_mean"), F.stddev_pop("_drop").alias("importance_std")
    )


def explanation_quality(attributions: DataFrame, df: DataFrame, features: list[str], row_id: str, small: float = 0.01) -> DataFrame:
    """One row: fidelity, stability, complexity and their mean.

    Fidelity correlates summed attributions with the change of the score; stability compares the
    attributions of every explained row with those of its nearest explained row; complexity is the
    share of features with next to no weight.
    """
    per_row = attributions.groupBy("row_id").agg(
        F.sum("attribution").alias("_sum"),
        F.first("prediction").alias("_p"),
        F.first("base").alias("_base"),
        F.max(F.abs("attribution")).alias("_top"),
    )
    fidelity = F.coalesce(F.corr("_sum", F.col("_p") - F.col("_base")), F.lit(0.0))
    sparse = attributions.join(per_row.select("row_id", "_top"), "row_id").agg(
        F.avg((F.abs("attribution") <= F.lit(small) * F.col("_top")).cast("double")).alias("complexity")
    )
    explained = df.withColumn("row_id", F.col(quoted(row_id)).cast("string")).join(
        attributions.select(F.col("row_id").cast("string").alias("row_id")).distinct(), "row_id", "left_semi"
    ).select("row_id", vector_of(features).alias("_vec"))
    near = knn_join(explained, explained, 1, "row_id", "row_id", "_vec", skip_self=True).select("query_id", "neighbor_id")
    a = attributions.select(F.col("row_id").cast("string").alias("query_id"), "feature", F.col("attribution").alias("_a"))
    b = attributions.select(F.col("row_id").cast("string").alias("neighbor_id"), "feature", F.col("attribution").alias("_b"))
    gaps = (
        a.join(near, "query_id")
        .join(b, ["neighbor_id", "feature"])
        .groupBy("query_id")
        .agg(
            F.try_divide(
                F.sqrt(F.sum(F.pow(F.col("_a") - F.col("_b"), 2))),
                F.sqrt(F.sum(F.pow("_a", 2))) + F.sqrt(F.sum(F.pow("_b", 2))),
            ).alias("_gap")
        )
    )
    stable = gaps.agg((F.lit(1.0) - F.avg(F.coalesce("_gap", F.lit(0.0)))).alias("stability"))
    return (
        per_row.agg(fidelity.alias("fidelity"))
        .withColumn("stability", stable.scalar())
        .withColumn("complexity", sparse.scalar())
        .withColumn("quality", (F.col("fidelity") + F.col("stability") + F.col("complexity")) / 3)
    )
