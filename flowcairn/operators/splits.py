"""Splits, folds, class weights and samples; all keyed by a row key, so they survive repartitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowcairn.functions.numeric import quoted
from flowcairn.operators.ordering import row_token, shuffled_rank


def stratified_split(
    df: DataFrame,
    label: str,
    keys: list[str],
    ratios: tuple[float, ...] = (0.70, 0.15, 0.15),
    names: tuple[str, ...] = ("train", "val", "test"),
    seed: int = 42,
) -> DataFrame:
    """Add ``split``; every label is divided in the given ratios, exact to the row."""
    if abs(sum(ratios) - 1.0) > 1e-6:
        raise ValueError(f"ratios must sum to 1, got {sum(ratios)}")
    ranked = shuffled_rank(df, keys, seed, [label], "_rank", "_n")
    part: Column | None = None
    upto = 0.0
    for name, ratio in list(zip(names, ratios))[:-1]:
        upto = round(upto + ratio, 10)
        here = F.col("_rank") <= F.floor(F.col("_n") * F.lit(upto) + 0.5)
        part = F.when(here, name) if part is None else part.when(here, name)
    last = F.lit(names[len(ratios) - 1])
    return ranked.withColumn("split", last if part is None else part.otherwise(last)).drop("_rank", "_n")


def stratified_folds(df: DataFrame, label: str, keys: list[str], k: int = 5, seed: int = 42, mode: str = "exact") -> DataFrame:
    """Add ``fold`` in 0..k−1. ``exact`` balances every label to one row; ``hash`` needs no shuffle."""
    if k < 2:
        raise ValueError("k must be at least 2")
    if mode == "hash":
        return df.withColumn("fold", F.pmod(F.xxhash64(*[quoted(c) for c in keys], F.lit(seed)), F.lit(k)).cast("int"))
    ranked = shuffled_rank(df, keys, seed, [label], "_rank", None)
    return ranked.withColumn("fold", ((F.col("_rank") - 1) % k).cast("int")).drop("_rank")


def fold_pair(folded: DataFrame, fold: int) -> tuple[DataFrame, DataFrame]:
    """Train and test rows of one fold."""
    return folded.where(F.col("fold") != fold), folded.where(F.col("fold") == fold)


def random_split(
    df: DataFrame,
    keys: list[str],
    ratios: tuple[float, ...] = (0.8, 0.1, 0.1),
    names: tuple[str, ...] = ("train", "val", "test"),
    seed: int = 42,
) -> DataFrame:
    """Add ``split`` by md5 of the row key: a projection, no shuffle, the same in every engine."""
    if abs(sum(ratios) - 1.0) > 1e-6:
        raise ValueError(f"ratios must sum to 1, got {sum(ratios)}")
    point = F.conv(F.substring(row_token(keys, seed), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
    part = F.lit(names[len(ratios) - 1])
    upto = 1.0
    for name, ratio in reversed(list(zip(names, ratios))[:-1]):
        upto = sum(r for n, r in zip(names, ratios) if names.index(n) <= names.index(name))
        part = F.when(point < F.lit(upto), name).otherwise(part)
    return df.withColumn("split", part)


def uniform(keys: list[str], seed: int, *more: Column) -> Column:
    """Seeded uniform number in [0, 1) from the row key."""
    bits = F.shiftrightunsigned(F.xxhash64(*[F.col(quoted(c)) for c in keys], *more, F.lit(seed)), 11)
    return bits.cast("double") / F.lit(float(1 << 53))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, n, weight) with weight = rows / (classes · class rows)."""
    counts = df.groupBy(quoted(label)).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1))).scalar()
    classes = df.agg(F.count_distinct(quoted(label))).scalar()
    return counts.withColumn("weight", total / (classes * F.col("n")))


def with_class_weight(df: DataFrame, label: str, weight: str = "weight") -> DataFrame:
    """Add the balanced class weight to every row; counting the classes is one action."""
    counts = {r[label]: r["n"] for r in df.groupBy(quoted(label)).agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    value = F.lit(1.0)
    for name, n in counts.items():
        value = F.when(F.col(quoted(label)).eqNullSafe(F.lit(name)), total / (len(counts) * n)).otherwise(value)
    return df.withColumn(weight, value)


def sample_exact(df: DataFrame, keys: list[str], ratio: float | None = None, n: int | None = None, seed: int = 42) -> DataFrame:
    """Exactly ``n`` (or ``max(1, int(rows · ratio))``) rows in seeded order, without replacement.

    A small ``n`` is a top-n by token, which every task cuts to n rows before anything moves.
    """
    if n is not None and n <= 10_000:
        return df.orderBy(row_token(keys, seed), *[F.col(quoted(c)) for c in keys]).limit(n)
    ranked = shuffled_rank(df, keys, seed, None, "_rank", "_n")
    wanted = F.lit(n) if n is not None else F.greatest(F.lit(1), F.floor(F.col("_n") * F.lit(ratio)))
    return ranked.where(F.col("_rank") <= wanted).drop("_rank", "_n")


def sample_fraction(df: DataFrame, fraction: float, keys: list[str] | None = None, seed: int = 42) -> DataFrame:
    """Bernoulli sample; with keys it does not depend on the partitioning."""
    if keys is None:
        return df.sample(False, fraction, seed)
    return df.where(uniform(keys, seed) < fraction)


def decimate(df: DataFrame, keys: list[str], ratio: float, seed: int = 42, most: int | None = None) -> DataFrame:
    """Small-ratio sample: one row in ``int(1/ratio)`` by hash; ``most`` is the caller's own bound, if any."""
    step = max(1, int(1 / ratio))
    token = F.xxhash64(*[F.col(quoted(c)) for c in keys], F.lit(seed))
    thinned = df.where(F.pmod(token, F.lit(step)) == 0)
    return thinned if most is None else sample_exact(thinned, keys, n=most, seed=seed)


def cap_per_source(df: DataFrame, source: str, keys: list[str], rows: int, seed: int = 42) -> DataFrame:
    """At most ``rows`` rows per source file, in seeded order; one huge file is ranked by many tasks."""
    return shuffled_rank(df, keys, seed, [source], "_rank", None).where(F.col("_rank") <= rows).drop("_rank")
