"""The shared tables seen as flow feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowcairn.catalog.registry import table

FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with a binary label: a return flag other than N is an attack."""
    return table(spark, sf_dir, "lineitem").withColumn("label", (F.col("l_returnflag") != "N").cast("int"))


def multi_file_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items under the multi-file feed's names; label is the last column."""
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.col("l_extendedprice").alias("Total Length of Fwd Packets"),
        (F.col("l_extendedprice") * F.col("l_discount")).alias("Total Length of Bwd Packets"),
        F.col("l_quantity").alias("Total Fwd Packets"),
        F.col("l_linenumber").cast("double").alias("Total Backward Packets"),
        (F.col("l_tax") * 100).alias("Flow Duration"),
        F.when(F.col("l_returnflag") == "N", "Benign")
        .otherwise(F.concat(F.lit("DrDoS_"), F.col("l_returnflag")))
        .alias("Label"),
    )


# The same feed in SQL.
MULTI_FILE_SQL = """
  SELECT l_orderkey, l_linenumber, l_extendedprice AS fwd_bytes, l_extendedprice * l_discount AS bwd_bytes,
         l_quantity AS fwd_packets, CAST(l_linenumber AS DOUBLE) AS bwd_packets, l_tax * 100 AS duration,
         CASE WHEN l_returnflag = 'N' THEN 'Benign' ELSE 'DrDoS_' || l_returnflag END AS attack
  FROM lineitem
"""


def single_file_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders under the single-file feed's names."""
    status = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.col("o_totalprice").alias("src_bytes"),
        (F.col("o_totalprice") * (F.col("o_orderkey") % 7)).alias("dst_bytes"),
        (F.col("o_custkey") % 50).cast("double").alias("src_pkts"),
        (F.col("o_orderkey") % 50).cast("double").alias("dst_pkts"),
        F.substring("o_orderpriority", 1, 1).cast("double").alias("duration"),
        F.when(status == "O", "normal").when(status == "F", "ddos").otherwise("scanning").alias("type"),
    )


SINGLE_FILE_SQL = """
  SELECT o_orderkey, o_totalprice AS src_bytes, o_totalprice * (o_orderkey % 7) AS dst_bytes,
         CAST(o_custkey % 50 AS DOUBLE) AS src_pkts, CAST(o_orderkey % 50 AS DOUBLE) AS dst_pkts,
         CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS duration,
         CASE o_orderstatus WHEN 'O' THEN 'normal' WHEN 'F' THEN 'ddos' ELSE 'scanning' END AS type
  FROM orders
"""


def wide_vectors(spark: SparkSession, sf_dir: str, width: int = 64) -> tuple[DataFrame, list[str]]:
    """Embeddings as one double column per dimension, with a binary label (class below 3)."""
    names = [f"x{i}" for i in range(width)]
    df = table(spark, sf_dir, "embeddings").select(
        "vec_id",
        (F.col("label") < 3).cast("int").alias("label"),
        *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(names)],
    )
    return df, names


def event_features(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    """Events with numeric features and the binary label error / other."""
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)
    df = table(spark, sf_dir, "events").select(
        "event_id",
        F.col("value").alias("value"),
        F.get_json_object("props", "$.k").try_cast("double").alias("k"),
        (F.col("user_id").cast("double")).alias("user"),
        ((seconds % F.lit(86400.0)) / 3600.0).alias("hour"),
        (F.col("event_type") == "error").cast("int").alias("label"),
    )
    return df, ["value", "k", "user", "hour"]


def scored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a score in [0, 1) and a thresholded prediction, as two algorithms over five folds."""
    base = table(spark, sf_dir, "events").select(
        "event_id",
        (F.col("event_type") == "error").cast("int").alias("label"),
        (F.floor(F.col("value") * 10) % 100 / F.lit(10.0)).alias("score"),
        (F.col("event_id") % 5).cast("int").alias("fold"),
        F.when(F.col("user_id") % 2 == 0, "LR").otherwise("DT").alias("algo"),
    )
    return base.withColumn("prediction", (F.col("score") >= 7.0).cast("int"))


SCORED_EVENTS_SQL = """
  SELECT event_id, label, score, fold, algo, CAST(score >= 7.0 AS INT) AS prediction FROM (
    SELECT event_id, CAST(event_type = 'error' AS INT) AS label, (CAST(floor(value * 10) AS BIGINT) % 100) / 10.0::DOUBLE AS score,
           CAST(event_id % 5 AS INT) AS fold, CASE WHEN user_id % 2 = 0 THEN 'LR' ELSE 'DT' END AS algo
    FROM events) t
"""
