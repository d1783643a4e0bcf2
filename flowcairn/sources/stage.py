"""Hand-over between phases: stage tables, feature names and metric sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_stage(df: DataFrame, folder: str, features: list[str], source: str = "dataset_source", label: str = "label") -> None:
    """Write ``data`` as Parquet, ``features`` as one JSON row and ``summary`` with counts per class."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{folder}/data")
    spark.createDataFrame([(features, len(features))], "features array<string>, n int").coalesce(1).write.mode(
        "overwrite"
    ).json(f"{folder}/features")
    keys = [c for c in (source, label) if c in df.columns]
    written = spark.read.parquet(f"{folder}/data")
    written.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).withColumn(
        "written_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")
    ).write.mode("overwrite").json(f"{folder}/summary")


def read_stage(spark: SparkSession, folder: str, recompute: Callable[[], DataFrame] | None = None) -> DataFrame:
    """Stage table from Parquet, else gzip CSV, else from ``recompute``."""
    try:
        return spark.read.parquet(f"{folder}/data")
    except AnalysisException:
        pass
    try:
        return spark.read.option("header", "true").option("inferSchema", "true").csv(f"{folder}/data.csv.gz")
    except AnalysisException:
        if recompute is None:
            raise
    return recompute()


def read_features(spark: SparkSession, folder: str) -> list[str]:
    """Feature names of a stage table."""
    return list(spark.read.json(f"{folder}/features").first()["features"])


def write_metrics(df: DataFrame, path: str, run: str, fmt: str = "parquet") -> None:
    """Write a result table for a run; nested columns become JSON text in CSV."""
    if fmt == "csv":
        nested = [f.name for f in df.schema if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
        df = df.withColumns({c: F.to_json(c) for c in nested})
    writer = df.withColumn("run", F.lit(run)).write.mode("append").partitionBy("run").format(fmt)
    (writer.option("header", "true") if fmt == "csv" else writer).save(path)
