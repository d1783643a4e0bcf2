"""Counts and column statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowcairn.functions.labels import label_column
from flowcairn.functions.numeric import is_finite, numeric_columns, quoted


def class_counts(df: DataFrame, by: list[str], ndigits: int | None = None) -> DataFrame:
    """Row count and percentage per value combination."""
    total = df.agg(F.count(F.lit(1)).alias("total")).scalar()
    share = F.col("n") * 100.0 / total
    return (
        df.groupBy(*[quoted(c) for c in by])
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("pct", F.round(share, ndigits) if ndigits is not None else share)
    )


def attack_types(df: DataFrame, label: str | None = None) -> DataFrame:
    """Distinct label values as text, sorted."""
    label = label or label_column(df)
    if label is None:
        raise ValueError("no label column found")
    value = F.col(quoted(label)).cast("string")
    return df.select(value.alias("attack_type")).where(value.isNotNull()).distinct().orderBy("attack_type")


def null_counts(df: DataFrame) -> DataFrame:
    """One row per column: type, position, rows, missing values; a single aggregate over the table."""
    types = dict(df.dtypes)
    row = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[
            F.count_if(F.col(quoted(c)).isNull() | (F.isnan(quoted(c)) if types[c] in ("double", "float") else F.lit(False))).alias(f"n{i}")
            for i, c in enumerate(df.columns)
        ],
    )
    entry = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.lit(i).alias("position"),
            F.lit(types[c]).alias("data_type"),
            F.col("rows"),
            F.col(f"n{i}").alias("missing"),
        )
        for i, c in enumerate(df.columns)
    ]
    return row.select(F.explode(F.array(*entry)).alias("e")).select("e.*")


def table_info(df: DataFrame, expected: int = 80, tolerance: int = 10) -> dict:
    """Shape, schema, missing values, label counts and the feature-count check (starts jobs)."""
    label = label_column(df)
    missing = null_counts(df).collect()  # one row per column
    features = len(df.columns) - (label is not None)
    return {
        "rows": missing[0]["rows"] if missing else 0,
        "columns": list(df.columns),
        "types": dict(df.dtypes),
        "missing": {r["column_name"]: r["missing"] for r in missing},
        "label": label,
        "label_counts": class_counts(df, [label]) if label else None,
        "feature_count": features,
        "feature_count_ok": abs(features - expected) <= tolerance,
    }


def column_stats(df: DataFrame, columns: list[str] | None = None, sample: bool = True) -> DataFrame:
    """min, max, mean, std and range per numeric column (long form); ``sample`` picks n−1 or n."""
    columns = columns or numeric_columns(df)
    deviation = F.stddev_samp if sample else F.stddev_pop
    aggregates = []
    for i, c in enumerate(columns):
        v = F.col(quoted(c)).cast("double")
        v = F.when(~F.isnan(v), v)
        aggregates += [
            F.count(v).alias(f"n{i}"),
            F.min(v).alias(f"lo{i}"),
            F.max(v).alias(f"hi{i}"),
            F.avg(v).alias(f"mean{i}"),
            deviation(v).alias(f"std{i}"),
        ]
    entry = [
        F.struct(
            F.lit(c).alias("feature"),
            F.col(f"n{i}").alias("n"),
            F.col(f"lo{i}").alias("min"),
            F.col(f"hi{i}").alias("max"),
            F.col(f"mean{i}").alias("mean"),
            F.col(f"std{i}").alias("std"),
            (F.col(f"hi{i}") - F.col(f"lo{i}")).alias("range"),
        )
        for i, c in enumerate(columns)
    ]
    return df.agg(*aggregates).select(F.explode(F.array(*entry)).alias("e")).select("e.*")


def describe(df: DataFrame) -> DataFrame:
    """Count, mean, std, min, quartiles and max of the numeric columns (approximate quartiles)."""
    return df.select(*[quoted(c) for c in numeric_columns(df)]).summary()


def ratio_validation(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """Per ratio column: present, total, non-finite, non-positive and valid share."""
    by = by or []
    present = [c for c in columns if c in df.columns]
    aggregates = [F.count(F.lit(1)).alias("_total")]
    for i, c in enumerate(present):
        v = F.col(quoted(c)).try_cast("double")
        aggregates += [
            F.count_if(~is_finite(v)).alias(f"bad{i}"),
            F.count_if(is_finite(v) & (v <= 0)).alias(f"low{i}"),
        ]
    entry = []
    for c in columns:
        i = present.index(c) if c in present else None
        total = F.col("_total") if i is not None else F.lit(0).cast("long")
        bad = F.col(f"bad{i}") if i is not None else F.lit(0).cast("long")
        low = F.col(f"low{i}") if i is not None else F.lit(0).cast("long")
        valid = F.coalesce(F.try_divide((total - bad - low).cast("double"), total.cast("double")), F.lit(0.0))
        entry.append(
            F.struct(
                F.lit(c).alias("feature"),
                F.lit(i is not None).alias("present"),
                total.alias("total"),
                bad.alias("non_finite"),
                low.alias("non_positive"),
                valid.alias("valid_ratio"),
            )
        )
    summary = df.groupBy(*[quoted(b) for b in by]).agg(*aggregates)
    return summary.select(*by, F.explode(F.array(*entry)).alias("e")).select(*by, "e.*")


_GRAMS = ("n", "sums", "squares", "products")
_MERGERS = 64


def _shifted(grams: dict, by: np.ndarray) -> dict:
    """Sums of values as if ``by`` had been added to each column beforehand; entry (i, j) is over rows with both."""
    n, a, q, p = (grams[k] for k in _GRAMS)
    i, j = by[:, None], by[None, :]
    return {"n": n, "sums": a + n * i, "squares": q + 2 * a * i + n * i * i, "products": p + a * j + a.T * i + n * i * j}


def gram_correlation(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of every column pair over the rows that have both, from blocked products.

    Each task adds up products of its rows as matrices, shifted by its own first values; matrices are merged
    in two steps. The plan has one column per feature, however many pairs there are. Infinities and NaN
    count as missing; a pair without spread, or with less than two rows, has no correlation (NULL).
    """
    size = len(columns)
    numbers = df.select(*[F.col(quoted(c)).cast("double").alias(f"x{i}") for i, c in enumerate(columns)])
    schema = "part int, shift binary, " + ", ".join(f"{k} binary" for k in _GRAMS)

    def packed(part: int, shift: np.ndarray, grams: dict) -> pd.DataFrame:
        return pd.DataFrame([{"part": part, "shift": shift.tobytes(), **{k: grams[k].tobytes() for k in _GRAMS}}])

    def block(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shift, total = None, None
        for batch in batches:
            x = batch.to_numpy(dtype=np.float64)
            present = np.isfinite(x)
            if shift is None:
                at = present.argmax(axis=0)
                shift = np.where(present.any(axis=0), np.nan_to_num(x[at, np.arange(size)], posinf=0, neginf=0), 0.0) if len(x) else np.zeros(size)
                total = {k: np.zeros((size, size)) for k in _GRAMS}
            v = present.astype(np.float64)
            x = np.where(present, x - shift, 0.0)
            for k, m in zip(_GRAMS, (v.T @ v, x.T @ v, (x * x).T @ v, x.T @ x)):
                total[k] += m
        if total is not None:
            yield packed(TaskContext.get().partitionId() % _MERGERS, shift, total)

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        shift, total = None, None
        for row in rows.itertuples(index=False):
            own = np.frombuffer(row.shift)
            grams = {k: np.frombuffer(getattr(row, k)).reshape(size, size) for k in _GRAMS}
            if shift is None:
                shift, total = own, {k: np.zeros((size, size)) for k in _GRAMS}
            grams = _shifted(grams, own - shift)
            for k in _GRAMS:
                total[k] += grams[k]
        return packed(0, shift, total)

    def pairs(rows: pd.DataFrame) -> pd.DataFrame:
        row = merge(rows).iloc[0]
        n, a, q, p = (np.frombuffer(row[k]).reshape(size, size) for k in _GRAMS)
        with np.errstate(divide="ignore", invalid="ignore"):
            var = np.where(n > 1, q - a * a / n, 0.0)
            var[var <= 1e-14 * q] = 0.0
            r = (p - a * a.T / n) / np.sqrt(var * var.T)
        i, j = np.triu_indices(size, 1)
        corr = pd.Series(np.clip(r[i, j], -1.0, 1.0)).where(np.isfinite(r[i, j])).astype(object)
        return pd.DataFrame({"x": [columns[k] for k in i], "y": [columns[k] for k in j], "corr": corr.where(corr.notna(), None)})

    merged = numbers.mapInPandas(block, schema).groupBy("part").applyInPandas(merge, schema)
    return merged.groupBy().applyInPandas(pairs, "x string, y string, corr double")


def correlation(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of every column pair, one row per pair, from one aggregate."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    row = df.agg(*[F.corr(quoted(a), quoted(b)).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    entry = [
        F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"r{i}").alias("corr"))
        for i, (a, b) in enumerate(pairs)
    ]
    return row.select(F.explode(F.array(*entry)).alias("e")).select("e.*")


def fold_summary(by_fold: DataFrame, metrics: tuple[str, ...] = ("f1", "precision", "recall", "accuracy")) -> DataFrame:
    """Mean and sample deviation per algorithm over its folds; failed folds carry NULL metrics."""
    present = [m for m in metrics if m in by_fold.columns]
    aggregates = [F.count(present[0]).alias("folds")] if present else [F.count(F.lit(1)).alias("folds")]
    for m in present:
        aggregates += [F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_std")]
    return by_fold.groupBy("algo").agg(*aggregates)


def box_stats(by_fold: DataFrame, metrics: tuple[str, ...] = ("f1", "precision", "recall", "accuracy")) -> DataFrame:
    """Minimum, quartiles and maximum of every metric per algorithm, over its folds."""
    long = by_fold.unpivot(["algo"], [m for m in metrics if m in by_fold.columns], "metric", "value")
    points = F.percentile("value", [0.0, 0.25, 0.5, 0.75, 1.0])  # a few values per algorithm
    return long.groupBy("algo", "metric").agg(points.alias("_q")).select(
        "algo", "metric", *[F.col("_q")[i].alias(n) for i, n in enumerate(("low", "q1", "median", "q3", "high"))]
    )


def phase_timeline(samples: DataFrame, phase: str, ts: str, gauges: list[str]) -> DataFrame:
    """Start, end, duration and mean gauge readings per phase of a monitoring table."""
    t = F.col(quoted(ts))
    return samples.groupBy(F.col(quoted(phase)).alias("phase")).agg(
        F.min(t).alias("start"),
        F.max(t).alias("end"),
        (F.unix_micros(F.max(t.cast("timestamp"))) - F.unix_micros(F.min(t.cast("timestamp")))).alias("duration_us"),
        *[F.avg(quoted(g)).alias(f"avg_{g}") for g in gauges],
    )


def best_per_group(df: DataFrame, by: list[str], score: str, tie: str) -> DataFrame:
    """The best row per group: highest score, ties to the smallest ``tie`` value; no sort needed.

    The aggregate keeps one row per group and task; missing scores never win.
    """
    rest = [c for c in df.columns if c not in by]
    value = F.col(quoted(score))
    usable = df.where(value.isNotNull() & ~F.isnan(value.cast("double")))
    winner = usable.groupBy(*[quoted(b) for b in by]).agg(
        F.min_by(
            F.struct(*[F.col(quoted(c)).alias(c) for c in rest]),
            F.struct((-value).alias("worst_first"), F.col(quoted(tie)).alias("tie")),
        ).alias("_w")
    )
    return winner.select(*by, "_w.*").select(*df.columns)


def top_k(df: DataFrame, by: list[str], score: str, tie: str, k: int) -> DataFrame:
    """The k best rows per group with their rank; a rank filter Spark applies before the shuffle too."""
    w = W.partitionBy(*[F.col(quoted(b)) for b in by]).orderBy(F.desc(quoted(score)), F.asc(quoted(tie)))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
