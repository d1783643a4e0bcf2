"""Streaming jobs run to the end over the shared tables; results equal the batch form."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from flowcairn.catalog.registry import query, table
from flowcairn.session import ensure_checkpoint_dir
from flowcairn.streaming import jobs


def _work_folder(spark) -> str:
    return f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"


def _event_stream(spark, sf_dir):
    return jobs.file_stream(spark, sf_dir, table(spark, sf_dir, "events").schema, "parquet", "events.parquet")


@query("stream_ingest", "SELECT event_type, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM events GROUP BY 1")
def stream_ingest(spark, sf_dir):
    """New files appended to a table once; a second run over the same folder adds nothing."""
    work = _work_folder(spark)
    for _ in range(2):
        jobs.ingest_new_files(_event_stream(spark, sf_dir), f"{work}/out", f"{work}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{work}/out").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id")
    )


@query(
    "stream_flow_sessions",
    """WITH o AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 2 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS opens
                  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
            s AS (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts) AS no FROM o)
       SELECT CAST(user_id AS VARCHAR) AS flow_id, min(ts) AS start_time, max(ts) AS end_time, count(*) AS packets
       FROM s GROUP BY user_id, no HAVING max(ts) + INTERVAL 2 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 MINUTE""",
)
def stream_flow_sessions(spark, sf_dir):
    """Flows of the packet stream which the watermark has closed."""
    packets = _event_stream(spark, sf_dir).select(
        F.col("user_id").cast("string").alias("flow_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(F.col("event_type").isin("click", "view"), "a").otherwise("b").alias("src_ip"),
    )
    flows = jobs.stream_flows(packets, ["flow_id"], "ts", "2 hours", "1 minute", F.col("src_ip") == "a")
    work = _work_folder(spark)
    jobs.write_stream(flows, f"{work}/out", f"{work}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{work}/out").select(
        "flow_id",
        F.col("start_time").cast("timestamp_ntz").alias("start_time"),
        F.col("end_time").cast("timestamp_ntz").alias("end_time"),
        "packets",
    )
