"""Mutual information of numeric features with a label, and top-k selection on it.

Two estimators. ``bins``: features are binned at their own quantiles (ties share a bin), then only the
contingency table ``features × bins × labels`` is shuffled. ``neighbors``: the mixed estimator on the
distance to the k-th neighbour of the same class, see ``operators.neighbor_information``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowcairn.functions.numeric import as_number, quoted
from flowcairn.operators.neighbor_information import neighbor_information
from flowcairn.operators.ordering import with_buckets
from flowcairn.operators.quantiles import quantiles


def mutual_information(
    df: DataFrame, columns: list[str], label: str, bins: int = 10, mode: str = "exact"
) -> DataFrame:
    """(feature, mutual_information) in nats; fitting the bin edges is one action."""
    values = df.select(F.col(quoted(label)).alias("_label"), *[as_number(c, text=False).alias(c) for c in columns])
    inner = quantiles(values, columns, [i / bins for i in range(1, bins)], mode)
    edges = {c: sorted({e for e in inner[c] if e is not None}) for c in columns}
    binned = with_buckets(values, edges)
    cells = ", ".join(
        f"named_struct('feature', {i}, 'bin', {quoted(c + '_bucket')}, 'v', {quoted(c)})" for i, c in enumerate(columns)
    )
    table = (
        binned.selectExpr("_label", f"explode(array({cells})) AS e")
        .where("e.v IS NOT NULL AND _label IS NOT NULL")
        .groupBy("e.feature", "e.bin", "_label")
        .count()
    )
    # Windows over the contingency table: a few hundred rows per feature.
    n = F.sum("count").over(W.partitionBy("feature"))
    by_bin = F.sum("count").over(W.partitionBy("feature", "bin"))
    by_label = F.sum("count").over(W.partitionBy("feature", "_label"))
    term = F.col("count") / F.col("n") * F.log(F.col("count") * F.col("n") / (F.col("by_bin") * F.col("by_label")))
    return (
        table.withColumns({"n": n, "by_bin": by_bin, "by_label": by_label})
        .groupBy("feature")
        .agg(F.greatest(F.sum(term), F.lit(0.0)).alias("mutual_information"))
        .withColumn("feature", F.get(F.array(*[F.lit(c) for c in columns]), F.col("feature")))
    )


def dynamic_k(features: int) -> int:
    """Number of features kept by the linear profile: 30 %, at least 10, at most 60."""
    return min(60, max(10, int(0.3 * features)))


def rank_features(
    df: DataFrame, columns: list[str], label: str, bins: int = 10, mode: str = "exact", keys: list[str] | None = None
) -> list[str]:
    """Features by falling information about the label, ties in input order (an action).

    With ``keys``, which identify a row, the estimate is the one by neighbours.
    """
    found = neighbor_information(df, columns, label, keys) if keys else mutual_information(df, columns, label, bins, mode)
    scores = {r["feature"]: r["mutual_information"] for r in found.collect()}
    return sorted(columns, key=lambda c: (-scores.get(c, 0.0), columns.index(c)))


def select_top_k(
    df: DataFrame, columns: list[str], label: str, k: int, bins: int = 10, mode: str = "exact", keys: list[str] | None = None
) -> list[str]:
    """The k features with most information about the label, in input order (an action)."""
    if k >= len(columns):
        return list(columns)
    kept = set(rank_features(df, columns, label, bins, mode, keys)[:k])
    return [c for c in columns if c in kept]
