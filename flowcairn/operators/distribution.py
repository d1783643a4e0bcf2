"""Distribution comparison: two-sample Kolmogorov–Smirnov, feature similarity and Gaussian densities."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowcairn.functions.numeric import as_number, is_finite, quoted
from flowcairn.operators.ordering import bucket_count, bucket_edges, with_buckets
from flowcairn.session import cut_lineage

# A feature is compatible above this p-value, or below this relative mean difference.
KS_P_VALUE = 0.05
MEAN_DIFFERENCE = 0.1
KS_SERIES_TERMS = 100


def ks_p_value(d: Column, n: Column, m: Column) -> Column:
    """Asymptotic two-sided p-value of the two-sample statistic."""
    n, m = n.cast("double"), m.cast("double")
    lam = F.sqrt(n * m / (n + m)) * d
    terms = F.transform(
        F.sequence(F.lit(1), F.lit(KS_SERIES_TERMS)),
        lambda j: F.when(j % 2 == 1, 1.0).otherwise(-1.0) * F.exp(F.lit(-2.0) * j * j * lam * lam),
    )
    series = F.lit(2.0) * F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + t)
    # The alternating series needs ever more terms as lam → 0, where the p-value is 1 to 15 digits.
    return F.when(lam < 0.2, F.lit(1.0)).otherwise(F.least(F.greatest(series, F.lit(0.0)), F.lit(1.0)))


def _side_values(df: DataFrame, columns: list[str], side: str) -> DataFrame:
    """(feature, bucket, value, second): a row per present value, buckets in the order of values."""
    second = F.col(quoted(side)).cast("int") == 1
    values = df.select(F.coalesce(second, F.lit(False)).alias("_second"), *[as_number(c, text=False).alias(c) for c in columns])
    bucketed = with_buckets(values, bucket_edges(values, columns, bucket_count(df)))
    entry = F.array(
        *[
            F.struct(
                F.lit(c).alias("feature"),
                F.col(quoted(c + "_bucket")).alias("bucket"),
                F.col(quoted(c)).alias("value"),
            )
            for c in columns
        ]
    )
    return bucketed.select("_second", F.explode(entry).alias("e")).select("_second", "e.*").where(F.col("value").isNotNull())


def ks_bounds(counts: DataFrame) -> DataFrame:
    """Per bucket the counts of both sides before it, the gap at its end, and the largest gap it can hold inside.

    ``counts`` has feature, bucket, n0 and n1: few rows per feature. Inside a bucket both shares lie
    between what they are before and behind it.
    """
    upto = W.partitionBy("feature").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy("feature")
    placed = counts.select(
        "feature", "bucket", F.sum("n0").over(whole).alias("n"), F.sum("n1").over(whole).alias("m"),
        (F.sum("n0").over(upto) - F.col("n0")).alias("before0"), (F.sum("n1").over(upto) - F.col("n1")).alias("before1"), "n0", "n1",
    ).where("n > 0 AND m > 0")
    low0, low1 = F.col("before0") / F.col("n"), F.col("before1") / F.col("m")
    high0, high1 = (F.col("before0") + F.col("n0")) / F.col("n"), (F.col("before1") + F.col("n1")) / F.col("m")
    return placed.withColumns({"end_gap": F.abs(high0 - high1), "most": F.greatest(F.abs(high0 - low1), F.abs(low0 - high1))})


def ks_two_sample(df: DataFrame, columns: list[str], side: str) -> DataFrame:
    """Per feature: sample sizes, statistic D and p-value between the rows with side 0 and side 1.

    Counts of buckets bound D from both sides; only buckets that can hold a larger gap than the largest at
    a bucket's end are counted value by value. Bucket edges and bucket counts are two jobs, the rest is lazy.
    """
    rows = _side_values(df, columns, side)
    sides = [F.count_if(~F.col("_second")).alias("n0"), F.count_if("_second").alias("n1")]
    bounds = ks_bounds(cut_lineage(rows.groupBy("feature", "bucket").agg(*sides)))
    found = bounds.withColumn("known", F.max("end_gap").over(W.partitionBy("feature")))
    open_ = found.where("most > known").select("feature", "bucket", "n", "m", "before0", "before1")
    per_value = rows.join(F.broadcast(open_), ["feature", "bucket"]).groupBy("feature", "bucket", "value", "n", "m", "before0", "before1").agg(*sides)
    inside = W.partitionBy("feature", "bucket").orderBy("value").rowsBetween(W.unboundedPreceding, 0)
    gap = F.abs(
        (F.col("before0") + F.sum("n0").over(inside)) / F.col("n") - (F.col("before1") + F.sum("n1").over(inside)) / F.col("m")
    )
    refined = per_value.select("feature", gap.alias("gap")).groupBy("feature").agg(F.max("gap").alias("inner"))
    known = found.groupBy("feature").agg(F.first("n").alias("n"), F.first("m").alias("m"), F.first("known").alias("known"))
    return (
        known.join(refined, "feature", "left")
        .select("feature", "n", "m", F.greatest("known", F.coalesce("inner", F.lit(0.0))).alias("ks_statistic"))
        .withColumn("ks_pvalue", ks_p_value(F.col("ks_statistic"), F.col("n"), F.col("m")))
    )


def feature_similarity(df: DataFrame, columns: list[str], side: str) -> DataFrame:
    """KS result, means, mean and deviation difference, and the compatibility verdict per feature."""
    second = F.col(quoted(side)).cast("int") == 1
    aggregates = []
    for i, c in enumerate(columns):
        v = as_number(c, text=False)
        for s, here in ((0, ~second), (1, second)):
            aggregates += [
                F.avg(F.when(here, v)).alias(f"m{s}_{i}"),
                F.stddev_samp(F.when(here, v)).alias(f"s{s}_{i}"),
            ]
    entry = F.array(
        *[
            F.struct(
                F.lit(c).alias("feature"),
                F.col(f"m0_{i}").alias("mean1"),
                F.col(f"m1_{i}").alias("mean2"),
                F.abs(F.col(f"m0_{i}") - F.col(f"m1_{i}")).alias("mean_diff"),
                F.abs(F.col(f"s0_{i}") - F.col(f"s1_{i}")).alias("std_diff"),
            )
            for i, c in enumerate(columns)
        ]
    )
    moments = df.agg(*aggregates).select(F.explode(entry).alias("e")).select("e.*")
    middle = F.abs(F.col("mean1") + F.col("mean2")) / 2
    close = F.when(middle != 0, F.col("mean_diff") / middle < MEAN_DIFFERENCE).otherwise(F.col("mean_diff") == 0)
    return (
        ks_two_sample(df, columns, side)
        .join(moments, "feature")
        .withColumn("compatible", (F.col("ks_pvalue") > KS_P_VALUE) | close)
    )


def fusion_validation(fused: DataFrame, columns: list[str], side: str = "dataset_source") -> DataFrame:
    """KS check of every fused feature; compatible when the p-value is above the threshold."""
    return feature_similarity(fused, columns, side).select(
        "feature", "ks_statistic", "ks_pvalue", "mean1", "mean2",
        (F.col("ks_pvalue") > KS_P_VALUE).alias("compatible"),
    )


def harmonization_report(validation: DataFrame) -> DataFrame:
    """One row: features, compatible features, and the first five p-values by name."""
    first_five = F.slice(
        F.array_sort(F.collect_list(F.struct("feature", "ks_pvalue", "compatible"))), 1, 5
    )  # one entry per feature
    return validation.agg(
        F.count(F.lit(1)).alias("features"),
        F.count_if("compatible").alias("compatible_features"),
        first_five.alias("first_p_values"),
    )


def density_by_label(
    df: DataFrame, column: str, label: str, points: int = 200, positive_only: bool = True
) -> DataFrame:
    """Gaussian kernel density of ``column`` per label on an even grid over the joint range.

    One small aggregate per label fixes bandwidth and grid. Each task then sums its kernels for all
    grid points with numpy, so ``labels × points`` numbers per batch travel, never the rows.
    """
    value = F.col(quoted(column)).cast("double")
    usable = is_finite(value) & (value > 0) if positive_only else is_finite(value)
    rows = df.where(usable).select(F.col(quoted(label)).alias("label"), value.alias("value"))
    label_type = dict(rows.dtypes)["label"]
    fits = rows.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"),
        F.stddev_samp("value").alias("sd"),
        F.min("value").alias("lo"),
        F.max("value").alias("hi"),
    ).collect()  # one row per label
    schema = f"label {label_type}, grid_no int, grid_x double, density double"
    if not fits:
        return df.sparkSession.createDataFrame([], schema)
    grid = np.linspace(min(r["lo"] for r in fits), max(r["hi"] for r in fits), points)
    width, count = {}, {}
    for r in fits:
        if r["n"] < 2:
            continue
        sd = r["sd"] or 1.0
        width[r["label"]] = max(1.06 * sd * r["n"] ** (-1 / 5), float(np.finfo(float).eps))
        count[r["label"]] = r["n"]

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, part in batch.groupby("label", dropna=False):
                key = None if pd.isna(key) else key
                if key not in width:
                    continue
                total = np.zeros(points)
                x = part["value"].to_numpy()
                for start in range(0, len(x), 4096):
                    z = (grid[:, None] - x[None, start : start + 4096]) / width[key]
                    total += np.exp(-0.5 * z * z).sum(axis=1)
                scale = math.sqrt(2 * math.pi) * count[key] * width[key]
                yield pd.DataFrame(
                    {"label": key, "grid_no": np.arange(points), "grid_x": grid, "density": total / scale}
                )

    return (
        rows.mapInPandas(partial, schema)
        .groupBy("label", "grid_no", "grid_x")
        .agg(F.sum("density").alias("density"))
    )


CELLS_PER_BANDWIDTH = 10


def binned_density_by_label(
    df: DataFrame, column: str, label: str, points: int = 200, positive_only: bool = True, cells: int = CELLS_PER_BANDWIDTH
) -> DataFrame:
    """``density_by_label`` from counts instead of rows, off by at most about (1 / cells)² / 8 of the peak.

    Every value is shared between the two nearest nodes of a fine grid, ``cells`` to the smallest
    bandwidth, in one native aggregate; the kernel then meets nodes only. Labels of one row are left out.
    """
    value = F.col(quoted(column)).cast("double")
    usable = is_finite(value) & (value > 0) if positive_only else is_finite(value)
    rows = df.where(usable).select(F.col(quoted(label)).alias("label"), value.alias("value"))
    fits = rows.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.stddev_samp("value").alias("sd"), F.min("value").alias("lo"), F.max("value").alias("hi")
    )
    spread = F.when(F.coalesce("sd", F.lit(0.0)) > 0, F.col("sd")).otherwise(F.lit(1.0))
    eps = float(np.finfo(float).eps)
    fits = cut_lineage(fits.withColumn("h", F.greatest(1.06 * spread * F.pow(F.col("n"), F.lit(-0.2)), F.lit(eps))))
    whole = fits.agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min(F.when(F.col("n") > 1, F.col("h"))).alias("h")).first()
    schema = f"label {dict(rows.dtypes)['label']}, grid_no int, grid_x double, density double"
    if whole["h"] is None:
        return df.sparkSession.createDataFrame([], schema)
    low, step = whole["lo"], whole["h"] / cells
    place = (F.col("value") - F.lit(low)) / F.lit(step)
    node, part = F.floor(place), place - F.floor(place)
    # Two sums per cell, then both ends of a cell become nodes: rows are aggregated before they are doubled.
    sums = rows.select("label", node.alias("node"), part.alias("part")).groupBy("label", "node").agg(F.count(F.lit(1)).alias("n"), F.sum("part").alias("w"))
    shares = F.explode(F.array(F.struct(F.col("node").alias("at"), (F.col("n") - F.col("w")).alias("w")), F.struct((F.col("node") + 1).alias("at"), F.col("w").alias("w"))))
    nodes = sums.select("label", shares.alias("x")).groupBy("label", F.col("x.at").alias("at")).agg(F.sum("x.w").alias("w"))
    named = nodes.withColumnRenamed("label", "node_label").join(
        fits.where("n > 1").select("label", "n", "h"), F.col("node_label").eqNullSafe(F.col("label"))
    ).select("label", "at", "w", "n", "h")
    grid = np.linspace(low, whole["hi"], points)

    def kernels(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, some in batch.groupby("label", dropna=False):
                n, h, total = some["n"].iloc[0], some["h"].iloc[0], np.zeros(points)
                at, w = low + some["at"].to_numpy() * step, some["w"].to_numpy()
                for start in range(0, len(at), 4096):
                    z = (grid[:, None] - at[None, start : start + 4096]) / h
                    total += (np.exp(-0.5 * z * z) * w[None, start : start + 4096]).sum(axis=1)
                yield pd.DataFrame({
                    "label": None if pd.isna(key) else key, "grid_no": np.arange(points), "grid_x": grid,
                    "density": total / (math.sqrt(2 * math.pi) * n * h),
                })

    return named.mapInPandas(kernels, schema).groupBy("label", "grid_no", "grid_x").agg(F.sum("density").alias("density"))


def range_check(df: DataFrame, columns: list[str], side: str) -> DataFrame:
    """Statistics per feature and feed, and whether both feeds lie in the unit or the robust range."""
    entry = F.array(*[F.struct(F.lit(c).alias("feature"), as_number(c, text=False).alias("value")) for c in columns])
    stats = (
        df.select(F.col(quoted(side)).alias(side), F.explode(entry).alias("e"))
        .where(F.col("e.value").isNotNull())
        .groupBy("e.feature", side)
        .agg(
            F.min("e.value").alias("min"),
            F.max("e.value").alias("max"),
            F.avg("e.value").alias("mean"),
            F.stddev_samp("e.value").alias("std"),
        )
        .withColumn("range", F.col("max") - F.col("min"))
    )
    verdict = stats.groupBy("feature").agg(
        F.bool_and((F.col("min") >= -0.1) & (F.col("max") <= 1.1)).alias("in_unit_range"),
        F.bool_and((F.col("min") >= -5.0) & (F.col("max") <= 5.0)).alias("in_robust_range"),
    )
    return stats.join(verdict, "feature")


