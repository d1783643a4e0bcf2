"""Packets to flows: time bounds, duration and packets per direction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowcairn.functions.numeric import quoted
from flowcairn.operators.ordering import running_sums
from flowcairn.session import cut_lineage

STRETCH = 4096  # pieces of a key that are stitched in one group


def flow_aggregates(ts: str, forward: Column) -> list[Column]:
    """Aggregates of one flow; plain counts and extremes, so no packet list is ever built."""
    t = F.col(quoted(ts))
    start, end = F.min(t), F.max(t)
    seconds = (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / F.lit(1e6)
    return [
        start.alias("start_time"),
        end.alias("end_time"),
        seconds.alias("duration"),
        F.count(F.lit(1)).alias("packets"),
        F.count_if(forward).alias("forward_packets"),
        F.count_if(~F.coalesce(forward, F.lit(False))).alias("backward_packets"),
    ]


def with_direction(packets: DataFrame, packet_source: str, flow_source: str) -> DataFrame:
    """FORWARD when the packet comes from the flow's source address, BACKWARD otherwise."""
    same = F.coalesce(F.col(quoted(packet_source)) == F.col(quoted(flow_source)), F.lit(False))
    return packets.withColumn("direction", F.when(same, "FORWARD").otherwise("BACKWARD"))


def assemble_flows(packets: DataFrame, keys: list[str], ts: str, forward: Column) -> DataFrame:
    """One row per flow key. Partial aggregation keeps a hot flow from weighing on one task."""
    return packets.groupBy(*[quoted(k) for k in keys]).agg(*flow_aggregates(ts, forward))


def epoch_time(packets: DataFrame, ts: str) -> DataFrame:
    """Epoch seconds as a timestamp."""
    return packets.withColumn(ts, F.timestamp_micros((F.col(quoted(ts)) * 1_000_000).cast("long")))


def sessions(packets: DataFrame, keys: list[str], ts: str, gap: str, forward: Column) -> DataFrame:
    """One row per key and burst: a flow closes after ``gap`` without a packet.

    Works on batch tables and, behind a watermark, on streams.
    """
    t = F.col(quoted(ts))
    return (
        packets.groupBy(F.session_window(t, gap).alias("_session"), *[quoted(k) for k in keys])
        .agg(*flow_aggregates(ts, forward))
        .drop("_session")
    )


def split_sessions(packets: DataFrame, keys: list[str], ts: str, gap_seconds: float, forward: Column) -> DataFrame:
    """The rows of ``sessions`` for batch tables in which one key may hold most packets.

    Time is cut into pieces as long as the gap: packets of a key in one piece belong together whatever lies
    between them, so a piece is one partial aggregate and no packet is sorted. Pieces that touch are then
    stitched: stretches of a bounded number of pieces look at the piece before each, the first of a stretch
    at the end of the stretch before, and running numbers of the breaks name the sessions.
    Packets without a time are left out; keys may be null.
    """
    gap = round(gap_seconds * 1e6)
    if gap <= 0:
        raise ValueError("the gap must be positive")
    names = [f"_k{i}" for i in range(len(keys))]
    micros = F.unix_micros(F.col(quoted(ts)).cast("timestamp"))
    rows = packets.where(F.col(quoted(ts)).isNotNull()).select(
        *[F.col(quoted(k)).alias(n) for k, n in zip(keys, names)], F.col(quoted(ts)).alias("_t"),
        F.floor(micros / F.lit(gap)).alias("_piece"), F.coalesce(forward, F.lit(False)).alias("_forward"),
    )
    ends = [F.min("_t").alias("_start"), F.max("_t").alias("_end")]
    pieces = rows.groupBy(*names, "_piece").agg(*ends, F.count(F.lit(1)).alias("_n"), F.count_if("_forward").alias("_f"))
    identity = F.to_json(F.struct(*names)) if names else F.lit("")  # null keys have a text as well
    pieces = cut_lineage(pieces.withColumns({"_id": identity, "_stretch": F.floor(F.col("_piece") / STRETCH)}))
    last = pieces.groupBy("_id", "_stretch").agg(F.max("_end").alias("_last"))
    before = F.lag("_last").over(W.partitionBy("_id").orderBy("_stretch")).alias("_before")  # a row per stretch
    near = F.coalesce(F.lag("_end").over(W.partitionBy("_id", "_stretch").orderBy("_piece")), F.col("_before"))
    at = lambda c: F.unix_micros(c.cast("timestamp"))
    breaks = F.when(at(F.col("_start")) - at(near) <= gap, 0).otherwise(1)  # silence as long as the gap keeps a session open
    marked = pieces.join(last.select("_id", "_stretch", before), ["_id", "_stretch"]).withColumn("_breaks", breaks).drop("_before")
    numbered = running_sums(marked, ["_id"], "_stretch", "_piece", {"_session": "_breaks"})
    whole = numbered.groupBy("_id", "_session", *names).agg(
        F.min("_start").alias("start_time"), F.max("_end").alias("end_time"), F.sum("_n").alias("packets"), F.sum("_f").alias("forward_packets")
    )
    return whole.select(
        *[F.col(n).alias(k) for n, k in zip(names, keys)], "start_time", "end_time",
        ((at(F.col("end_time")) - at(F.col("start_time"))) / F.lit(1e6)).alias("duration"),
        "packets", "forward_packets", (F.col("packets") - F.col("forward_packets")).alias("backward_packets"),
    )
