"""Structured Streaming jobs; each gives the same rows as its batch form on the same data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from flowcairn.operators.flows import sessions
from flowcairn.operators.preparation import Preparation
from flowcairn.plans.models import Trained


def file_stream(
    spark: SparkSession, folder: str, schema: T.StructType, fmt: str = "csv", pattern: str | None = None, files_per_batch: int | None = None
) -> DataFrame:
    """New files of a folder as a stream; the checkpoint of the query remembers the loaded ones."""
    reader = spark.readStream.schema(schema).format(fmt)
    if fmt == "csv":
        reader = reader.option("header", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(folder)


def ingest_new_files(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Append the files that arrived since the last run, then stop."""
    return (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start(target)
    )


def stream_flows(packets: DataFrame, keys: list[str], ts: str, gap: str, watermark: str, forward: Column) -> DataFrame:
    """Flows of a packet stream; a flow is emitted once the watermark has passed its last packet and gap.

    Only counts and bounds are kept as state, and packets later than the watermark are dropped.
    """
    return sessions(packets.withWatermark(ts, watermark), keys, ts, gap, forward)


def score_stream(flows: DataFrame, prepared: Preparation, model: Trained) -> DataFrame:
    """Prepare and score arriving flows. The fitted state is literals, so any sink and mode works."""
    return model.score(prepared.transform(flows))


def write_stream(df: DataFrame, target: str, checkpoint: str, fmt: str = "parquet") -> StreamingQuery:
    """Append a stream to a table of files, processing what is there and stopping."""
    return (
        df.writeStream.format(fmt)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start(target)
    )
