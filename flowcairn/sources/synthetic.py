"""A seeded labelled table for trying jobs out."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def synthetic_flows(
    spark: SparkSession, rows: int, features: int = 20, informative: int = 10, redundant: int = 5, shift: float = 1.0, seed: int = 42
) -> DataFrame:
    """(id, feature_0…, label): informative columns move with the label, redundant ones combine them.

    Values depend on the row number only, so the table is the same under any partitioning.
    """

    def normal(j: int) -> str:
        u = f"(shiftrightunsigned(xxhash64(id, {j}, {seed}), 11) + 0.5D) / {float(1 << 53)!r}D"
        v = f"(shiftrightunsigned(xxhash64(id, {j}, {seed + 1}), 11) + 0.5D) / {float(1 << 53)!r}D"
        return f"sqrt(-2D * ln({u})) * cos({2 * math.pi!r}D * {v})"

    base = spark.range(rows).withColumn("label", F.expr(f"CAST(pmod(xxhash64(id, {seed + 2}), 2) AS INT)"))
    plain = features - redundant
    moved = base.select(
        "id",
        *[
            F.expr(f"{normal(j)}" + (f" + {shift!r}D * (label * 2 - 1)" if j < informative else "")).alias(f"feature_{j}")
            for j in range(plain)
        ],
        "label",
    )
    mixed = {
        f"feature_{plain + j}": F.expr(f"0.5D * feature_{j % informative} + 0.5D * feature_{(j + 1) % informative}")
        for j in range(redundant)
    }
    return moved.withColumns(mixed).select("id", *[f"feature_{j}" for j in range(features)], "label")
