"""Column and algorithm names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def trim_names(df: DataFrame) -> DataFrame:
    """Strip blanks and a byte-order mark around column names; two names falling together is an error."""
    names = [c.strip().removeprefix("﻿").strip() for c in df.columns]
    clash = sorted({n for n in names if names.count(n) > 1})
    if clash:
        raise ValueError(f"column names fall together after trimming: {clash}")
    return df if names == df.columns else df.toDF(*names)


def safe_name(c: Column | str) -> Column:
    """Algorithm name usable in a file name."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(F.trim(c), r"[ /\\]", "_")


def with_algo(df: DataFrame) -> DataFrame:
    """Result tables carry the algorithm in ``algo``; ``model_name`` and ``model`` are accepted."""
    if "algo" in df.columns:
        return df.withColumn("algo", F.col("algo").cast("string"))
    for other in ("model_name", "model"):
        if other in df.columns:
            return df.withColumnRenamed(other, "algo")
    raise ValueError("result table needs an 'algo' column")


def rename_label(df: DataFrame, drop: tuple[str, ...] = ()) -> DataFrame:
    """Drop columns, and rename the first label candidate to ``label``."""
    from flowcairn.functions.labels import label_column

    df = df.drop(*drop)
    found = label_column(df)
    if found is None or found == "label":
        return df
    return df.withColumnRenamed(found, "label")
