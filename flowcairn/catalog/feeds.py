"""Feeds seen together: labels, harmonization, fusion, column matching and flow assembly."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowcairn.catalog.bindings import MULTI_FILE_SQL, SINGLE_FILE_SQL, multi_file_feed, single_file_feed
from flowcairn.catalog.registry import query, rounded, sql_round, table
from flowcairn.functions.labels import attack_label, ddos_label, keep_binary_types
from flowcairn.functions.ratios import MULTI_FILE, RATIO_COLUMNS, SINGLE_FILE, with_flow_ratios
from flowcairn.operators import stats
from flowcairn.operators.categories import categorize, category_scores
from flowcairn.operators.flows import assemble_flows, sessions, split_sessions
from flowcairn.operators.harmonize import fuse, harmonize, shared_values
from flowcairn.operators.matching import column_profile, match_columns

_R = sql_round


def _ratio_feeds(spark, sf_dir):
    """Both feeds with ratios and binary labels."""
    multi = with_flow_ratios(multi_file_feed(spark, sf_dir), MULTI_FILE)
    multi = multi.withColumn("label", attack_label(multi, "Label")).select(*RATIO_COLUMNS, "label")
    single = keep_binary_types(single_file_feed(spark, sf_dir))
    single = with_flow_ratios(single, SINGLE_FILE)
    single = single.withColumn("label", ddos_label(single)).select(*RATIO_COLUMNS, "label")
    return multi, single


_FUSED_SQL = f"""
  SELECT 0 AS dataset_source, CAST(upper(attack) <> 'BENIGN' AS INT) AS label,
         (fwd_bytes + bwd_bytes) / greatest(duration, 1e-8) AS "Flow_Bytes_s",
         (fwd_bytes + bwd_bytes) / greatest(fwd_packets + bwd_packets, 1e-8) AS "Avg_Packet_Size"
  FROM ({MULTI_FILE_SQL}) a
  UNION ALL
  SELECT 1, CAST(type = 'ddos' AS INT), (src_bytes + dst_bytes) / greatest(duration, 1e-8),
         (src_bytes + dst_bytes) / greatest(src_pkts + dst_pkts, 1e-8)
  FROM ({SINGLE_FILE_SQL}) b WHERE type IN ('normal', 'ddos')
"""


@query(
    "fusion_class_dist",
    f"""SELECT dataset_source, label, count(*) AS n, {_R(f'count(*) * 100.0 / (SELECT count(*) FROM ({_FUSED_SQL}) t)', 4)} AS pct,
          {_R('avg("Avg_Packet_Size") / 1e6', 4)} AS avg_packet_size FROM ({_FUSED_SQL}) f GROUP BY ALL""",
)
def fusion_class_dist(spark, sf_dir):
    """Ratios of two feeds, fused: class distribution and mean packet size per source."""
    fused = fuse(*_ratio_feeds(spark, sf_dir))
    share = F.count(F.lit(1)) * 100.0 / fused.agg(F.count(F.lit(1))).scalar()
    return fused.groupBy("dataset_source", "label").agg(
        F.count(F.lit(1)).alias("n"),
        rounded(share, 4).alias("pct"),
        rounded(F.avg("Avg_Packet_Size") / 1e6, 4).alias("avg_packet_size"),
    )


@query(
    "fused_source_counts",
    f"SELECT dataset_source, count(*) AS n, {_R(f'count(*) * 100.0 / (SELECT count(*) FROM ({_FUSED_SQL}) t)', 4)} AS pct FROM ({_FUSED_SQL}) f GROUP BY 1",
)
def fused_source_counts(spark, sf_dir):
    return stats.class_counts(fuse(*_ratio_feeds(spark, sf_dir)), ["dataset_source"]).withColumn("pct", rounded("pct", 4))


@query(
    "binary_labels",
    f"""SELECT attack AS raw, CAST(upper(attack) <> 'BENIGN' AS INT) AS label, count(*) AS n
        FROM ({MULTI_FILE_SQL}) a GROUP BY ALL
        UNION ALL SELECT type, CAST(type = 'ddos' AS INT), count(*) FROM ({SINGLE_FILE_SQL}) b
        WHERE type IN ('normal', 'ddos') GROUP BY ALL""",
)
def binary_labels(spark, sf_dir):
    """Both label rules on both feeds."""
    multi = multi_file_feed(spark, sf_dir)
    single = keep_binary_types(single_file_feed(spark, sf_dir))
    both = multi.select(F.col("Label").alias("raw"), attack_label(multi).alias("label")).unionByName(
        single.select(F.col("type").alias("raw"), ddos_label(single).alias("label"))
    )
    return both.groupBy("raw", "label").agg(F.count(F.lit(1)).alias("n"))


_HARMONIZED_SQL = f"""
  SELECT 0 AS dataset_source, CAST(upper(attack) <> 'BENIGN' AS INT) AS label, duration AS duration,
         fwd_bytes, bwd_bytes FROM ({MULTI_FILE_SQL}) a
  UNION ALL
  SELECT 1, CAST(type = 'ddos' AS INT), duration, src_bytes, dst_bytes
  FROM ({SINGLE_FILE_SQL}) b WHERE type IN ('normal', 'ddos')
"""


@query(
    "harmonized_fusion",
    f"""SELECT dataset_source, label, count(*) AS n, {_R('avg(duration)', 4)} AS duration,
          {_R('avg(fwd_bytes) / 1000', 4)} AS fwd_bytes, {_R('avg(bwd_bytes) / 1000', 4)} AS bwd_bytes
        FROM ({_HARMONIZED_SQL}) h GROUP BY ALL""",
)
def harmonized_fusion(spark, sf_dir):
    """Columns matched by name, harmonized to one schema and fused."""
    multi, single, _ = harmonize(multi_file_feed(spark, sf_dir), single_file_feed(spark, sf_dir), label_multi="Label")
    fused = fuse(multi, single)
    return fused.groupBy("dataset_source", "label").agg(
        F.count(F.lit(1)).alias("n"),
        rounded(F.avg("duration"), 4).alias("duration"),
        *[rounded(F.avg(c) / 1000, 4).alias(c) for c in ("fwd_bytes", "bwd_bytes")],
    )


def _matched(single: str, multi: str, name: str, kind: str, category: str, unit: str, score: str, confidence: str) -> str:
    return f"""SELECT '{single}' AS single_name, '{multi[0]}' AS multi_name, '{name}' AS unified_name, '{kind}' AS type, '{category}' AS category,
      '{unit}' AS unit, CAST({score} AS DOUBLE) AS similarity_score, '{confidence}' AS confidence,
      (SELECT count(try_cast({multi[1]} AS DOUBLE)) / count(*) FROM ({MULTI_FILE_SQL})) AS multi_share,
      (SELECT count(try_cast({single} AS DOUBLE)) / count(*) FROM ({SINGLE_FILE_SQL})) AS single_share"""


_FWD, _BWD = ("Total Length of Fwd Packets", "fwd_bytes"), ("Total Length of Bwd Packets", "bwd_bytes")


@query(
    "column_match",
    " UNION ALL ".join([
        _matched("dst_pkts", _FWD, "dst_pkts", "semantic_match", "packet", "seconds", "0.6", "low"),
        _matched("duration", ("Flow Duration", "duration"), "duration", "semantic_match", "temporal", "seconds", "0.8", "medium"),
        _matched("src_pkts", _FWD, "src_pkts", "semantic_match", "packet", "seconds", "0.6", "low"),
        _matched("src_bytes", _FWD, "fwd_bytes", "known_mapping", "byte", "bytes", "NULL", "high"),
        _matched("dst_bytes", _BWD, "bwd_bytes", "known_mapping", "byte", "bytes", "NULL", "high"),
    ]),
)
def column_match(spark, sf_dir):
    """Matched column pairs of both feeds with the numeric share of the partners."""
    multi, single = multi_file_feed(spark, sf_dir), single_file_feed(spark, sf_dir)
    shares = [
        column_profile(df, samples=0).select(F.col("name").alias(key), (F.col("as_number") / F.col("rows")).alias(out))
        for df, key, out in ((multi, "multi_name", "multi_share"), (single, "single_name", "single_share"))
    ]
    return match_columns(single, multi).join(shares[0], "multi_name").join(shares[1], "single_name")


@query(
    "column_profile",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS name, {unit} AS unit, '{category}' AS category, count({c}) AS present,
              count(try_cast({c} AS DOUBLE)) AS as_number, count(*) AS rows FROM orders"""
        for c, unit, category in [
            ("o_orderkey", "NULL", "other"),
            ("o_custkey", "'seconds'", "other"),
            ("o_orderstatus", "'seconds'", "flag"),
            ("o_totalprice", "NULL", "flow_statistic"),
            ("o_orderpriority", "NULL", "other"),
        ]
    ),
)
def profiled_columns(spark, sf_dir):
    """Unit, category and numeric share of every column of a table."""
    df = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"
    )
    return column_profile(df).select("name", "unit", "category", "present", "as_number", "rows")


@query(
    "category_scores",
    """SELECT 26 / 6.0::DOUBLE AS performance, 48 / 6.0::DOUBLE AS explainability, 11 / 6.0::DOUBLE AS resources, count(*) AS rows FROM lineitem""",
)
def feature_category_scores(spark, sf_dir):
    """Criteria scores of the feed's columns, with the number of rows they describe."""
    feed = multi_file_feed(spark, sf_dir).drop("l_orderkey", "l_linenumber")
    profile = column_profile(feed, samples=0)
    return category_scores(categorize(profile)).withColumn("rows", profile.agg(F.max("rows")).scalar())


@query(
    "label_set_algebra",
    """SELECT l_partkey, in_a, in_b, CASE WHEN in_a = 1 AND in_b = 1 THEN 'both' WHEN in_a = 1 THEN 'only_a' ELSE 'only_b' END AS kind
       FROM (SELECT l_partkey, max(a) AS in_a, max(b) AS in_b FROM (
         SELECT l_partkey, 1 AS a, 0 AS b FROM lineitem WHERE l_returnflag = 'A'
         UNION ALL SELECT l_partkey, 0, 1 FROM lineitem WHERE l_returnflag = 'R') u GROUP BY l_partkey) g""",
)
def label_set_algebra(spark, sf_dir):
    """Values found with one label, the other, or both."""
    df = table(spark, sf_dir, "lineitem")
    return shared_values(df.where("l_returnflag = 'A'"), df.where("l_returnflag = 'R'"), "l_partkey")


@query(
    "flow_assembly",
    f"""SELECT CAST(user_id AS VARCHAR) AS flow_id, min(ts) AS start_time, max(ts) AS end_time,
          {_R('(epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6')} AS duration, count(*) AS packets,
          count(*) FILTER (WHERE event_type IN ('click', 'view')) AS forward_packets,
          count(*) FILTER (WHERE event_type NOT IN ('click', 'view')) AS backward_packets
        FROM events GROUP BY user_id""",
)
def flow_assembly(spark, sf_dir):
    """Packets to flows: time bounds, duration and packets per direction."""
    packets = _packets(spark, sf_dir)
    return assemble_flows(packets, ["flow_id"], "ts", F.col("src_ip") == F.lit("a")).withColumn(
        "duration", rounded("duration")
    )


def _packets(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("flow_id"),
        "ts",
        F.when(F.col("event_type").isin("click", "view"), "a").otherwise("b").alias("src_ip"),
    )


@query(
    "flow_sessions",
    """WITH o AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 2 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS opens
                  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
            s AS (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts) AS no FROM o)
       SELECT CAST(user_id AS VARCHAR) AS flow_id, min(ts) AS start_time, max(ts) AS end_time, count(*) AS packets
       FROM s GROUP BY user_id, no""",
)
def flow_sessions(spark, sf_dir):
    """Flows closed by two hours of silence."""
    out = sessions(_packets(spark, sf_dir), ["flow_id"], "ts", "2 hours", F.col("src_ip") == F.lit("a"))
    return out.select("flow_id", "start_time", "end_time", "packets")


@query(
    "flow_sessions_hot",
    """WITH o AS (SELECT event_type, ts, CASE WHEN ts > lag(ts) OVER w + INTERVAL 5 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS opens
                  FROM events WINDOW w AS (ORDER BY ts)),
            s AS (SELECT event_type, ts, sum(opens) OVER (ORDER BY ts) AS no FROM o)
       SELECT min(ts) AS start_time, max(ts) AS end_time, date_diff('microsecond', min(ts), max(ts)) / 1e6 AS duration, count(*) AS packets,
              count(*) FILTER (WHERE event_type IN ('click', 'view')) AS forward_packets
       FROM s GROUP BY no""",
)
def flow_sessions_hot(spark, sf_dir):
    """All packets as one flow key, closed by five minutes of silence: no task sorts the key's packets."""
    packets = _packets(spark, sf_dir).withColumn("flow_id", F.lit("all"))
    out = split_sessions(packets, ["flow_id"], "ts", 300.0, F.col("src_ip") == F.lit("a"))
    return out.select("start_time", "end_time", "duration", "packets", "forward_packets")
