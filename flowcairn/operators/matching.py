"""Which columns of two feeds mean the same: exact names, similar names, and known pairs.

Column descriptions are schema-level tables of a few hundred rows; only the sample values and the
numeric shares are read from data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowcairn.functions.labels import LABEL_CANDIDATES
from flowcairn.functions.numeric import as_number, numeric_columns, quoted

# Name fragments that give a column its unit; the first unit with a hit wins.
UNIT_FRAGMENTS = {
    "bytes": ["byte", "bytes", "b"],
    "seconds": ["sec", "second", "seconds", "s", "duration", "time"],
    "milliseconds": ["ms", "millisecond", "milliseconds"],
    "microseconds": ["us", "microsecond", "microseconds"],
    "packets": ["packet", "packets", "pkt"],
    "count": ["count", "cnt", "num", "number"],
    "ratio": ["ratio", "rate", "percent", "%"],
    "flags": ["flag", "flags"],
    "ip": ["ip", "address"],
    "port": ["port"],
    "protocol": ["protocol", "proto"],
}
# Name fragments that give a column its category; the first category with a hit wins.
CATEGORY_FRAGMENTS = {
    "ip_address": ["ip", "address"],
    "port": ["port"],
    "protocol": ["protocol", "proto"],
    "temporal": ["duration", "time", "iat", "active", "idle"],
    "packet": ["packet", "pkt"],
    "byte": ["byte", "length", "size"],
    "flag": ["flag", "fin", "syn", "rst", "psh", "ack", "urg"],
    "flow_statistic": ["flow", "total", "mean", "std", "max", "min", "avg"],
    "rate": ["rate", "per second", "/s"],
    "label": ["label", "attack", "class", "type"],
}
# Categories that are never matched by similarity.
UNMATCHED_CATEGORIES = ("label", "ip_address", "port", "protocol")
# Known pairs as (unified name, single-file variants, multi-file variants, category, unit).
KNOWN_PAIRS = [
    ("flow_duration", ["duration", "flow_duration", "time", "flow_time"], ["Flow Duration", "Duration"], "temporal", "microseconds"),
    ("fwd_packets", ["fwd_packets", "forward_packets", "src_packets", "packets_sent", "total_packets"], ["Total Fwd Packets", "Fwd Packets"], "packet", "count"),
    ("bwd_packets", ["bwd_packets", "backward_packets", "dst_packets", "packets_received"], ["Total Backward Packets", "Bwd Packets"], "packet", "count"),
    ("fwd_bytes", ["fwd_bytes", "forward_bytes", "src_bytes", "bytes_sent", "fwd_length", "total_bytes"], ["Total Length of Fwd Packets", "Fwd Bytes"], "byte", "bytes"),
    ("bwd_bytes", ["bwd_bytes", "backward_bytes", "dst_bytes", "bytes_received", "bwd_length"], ["Total Length of Bwd Packets", "Bwd Bytes"], "byte", "bytes"),
    ("flow_bytes_per_sec", ["flow_bytes_per_sec", "bytes_per_second", "throughput", "rate", "bps"], ["Flow Bytes/s", "Flow Bytes per second"], "rate", "bytes_per_second"),
    ("flow_packets_per_sec", ["flow_packets_per_sec", "packets_per_second", "pps"], ["Flow Packets/s", "Flow Packets per second"], "rate", "packets_per_second"),
    ("syn_flags", ["syn", "syn_flag", "syn_count", "syn_flags"], ["SYN Flag Count", "SYN"], "flag", "count"),
    ("ack_flags", ["ack", "ack_flag", "ack_count", "ack_flags"], ["ACK Flag Count", "ACK"], "flag", "count"),
    ("fin_flags", ["fin", "fin_flag", "fin_count", "fin_flags"], ["FIN Flag Count", "FIN"], "flag", "count"),
    ("fwd_iat_mean", ["fwd_iat", "forward_iat", "iat_mean", "fwd_iat_mean"], ["Fwd IAT Mean", "Forward IAT Mean"], "temporal", "microseconds"),
    ("bwd_iat_mean", ["bwd_iat", "backward_iat", "bwd_iat_mean"], ["Bwd IAT Mean", "Backward IAT Mean"], "temporal", "microseconds"),
    ("fwd_packet_length_mean", ["fwd_packet_length", "fwd_pkt_len", "forward_packet_length", "packet_length"], ["Fwd Packet Length Mean"], "byte", "bytes"),
    ("bwd_packet_length_mean", ["bwd_packet_length", "bwd_pkt_len", "backward_packet_length"], ["Bwd Packet Length Mean"], "byte", "bytes"),
]
# Name groups of the simple matcher.
NAME_GROUPS = [
    ("src_ip", ["Src IP", "src_ip", "Source IP", "source_ip", "srcip"]),
    ("dst_ip", ["Dst IP", "dst_ip", "Destination IP", "destination_ip", "dstip"]),
    ("src_port", ["Src Port", "src_port", "Source Port", "source_port", "srcport"]),
    ("dst_port", ["Dst Port", "dst_port", "Destination Port", "destination_port", "dstport"]),
    ("proto", ["Protocol", "proto", "Protocol Name", "protocol"]),
    ("duration", ["Flow Duration", "duration", "Flow Duration (ms)", "flow_duration", "time"]),
    ("fwd_packets", ["Total Fwd Packets", "fwd_packets", "forward_packets", "fwd_pkt"]),
    ("fwd_bytes", ["Total Length of Fwd Packets", "fwd_bytes", "forward_bytes", "fwd_length"]),
    ("bwd_packets", ["Total Backward Packets", "bwd_packets", "backward_packets", "bwd_pkt"]),
    ("bwd_bytes", ["Total Length of Bwd Packets", "bwd_bytes", "backward_bytes", "bwd_length"]),
    ("flow_bytes_per_sec", ["Flow Bytes/s", "flow_bytes_per_sec", "bytes_per_second", "throughput"]),
    ("flow_packets_per_sec", ["Flow Packets/s", "flow_packets_per_sec", "packets_per_second"]),
    ("syn_flags", ["SYN Flag Count", "syn_flag", "syn_count", "syn"]),
    ("ack_flags", ["ACK Flag Count", "ack_flag", "ack_count", "ack"]),
    ("fin_flags", ["FIN Flag Count", "fin_flag", "fin_count", "fin"]),
]

MAPPING_SCHEMA = (
    "unified_name string, single_name string, multi_name string, type string, category string, unit string, "
    "similarity_score double, confidence string"
)


def _first_hit(name: Column, fragments: dict[str, list[str]], strict: bool) -> Column:
    out: Column | None = None
    for value, parts in fragments.items():
        hit = F.lit(False)
        for p in parts:
            if strict and p.isalpha():
                hit = hit | name.rlike(rf"(?<![a-z]){p}(?![a-z])")
            else:
                hit = hit | name.contains(p)
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out


def unit_of(name: Column, strict: bool = False) -> Column:
    """Unit by name fragment, or NULL; ``strict`` asks for whole words."""
    return _first_hit(F.lower(F.trim(name)), UNIT_FRAGMENTS, strict)


def category_of(name: Column, strict: bool = False) -> Column:
    """Category by name fragment, default ``other``."""
    return F.coalesce(_first_hit(F.lower(F.trim(name)), CATEGORY_FRAGMENTS, strict), F.lit("other"))


def unified_name(single: Column, multi: Column) -> Column:
    """The shorter of both names, in lower case, blanks as underscores, other signs removed."""
    base = F.when(F.length(single) <= F.length(multi), single).otherwise(multi)
    return F.regexp_replace(F.replace(F.lower(base), F.lit(" "), F.lit("_")), "[^a-z0-9_]", "")


def describe_columns(spark: SparkSession, columns: list[str], strict: bool = False) -> DataFrame:
    """(name, position, unit, category) of a schema."""
    rows = [(c, i) for i, c in enumerate(columns)]
    names = spark.createDataFrame(rows, "name string, position int")
    return names.select(
        "name", "position", unit_of(F.col("name"), strict).alias("unit"), category_of(F.col("name"), strict).alias("category")
    )


def column_profile(df: DataFrame, samples: int = 5) -> DataFrame:
    """Per column: type, numeric flag, unit, category, rows, present and numeric counts, and examples.

    ``examples`` holds the smallest ``samples`` distinct values as text, in rising order; a column without
    values has an empty array. Counts are one aggregate; the examples are a second pass over the table, which
    0 samples leave out.
    """
    types = dict(df.dtypes)
    numeric = set(numeric_columns(df))
    entry = F.array(
        *[
            F.struct(
                F.lit(c).alias("name"),
                F.lit(i).alias("position"),
                F.lit(types[c]).alias("data_type"),
                F.lit(c in numeric).alias("is_numeric"),
                F.col(f"n{i}").alias("present"),
                F.col(f"k{i}").alias("as_number"),
                F.col("_rows").alias("rows"),
            )
            for i, c in enumerate(df.columns)
        ]
    )
    aggregates = [F.count(F.lit(1)).alias("_rows")]
    for i, c in enumerate(df.columns):
        aggregates += [
            F.count(quoted(c)).alias(f"n{i}"),
            F.count(as_number(c) if types[c] == "string" else (as_number(c, text=False) if c in numeric else F.lit(None))).alias(f"k{i}"),
        ]
    profile = df.agg(*aggregates).select(F.explode(entry).alias("e")).select("e.*")
    if samples > 0:
        values = [F.struct(F.lit(i).alias("position"), F.col(quoted(c)).cast("string").alias("x")) for i, c in enumerate(df.columns)]
        distinct = df.select(F.explode(F.array(*values)).alias("v")).select("v.*").where("x IS NOT NULL").distinct()
        # Every task keeps its first few values of a column before they meet.
        place = F.row_number().over(W.partitionBy("position").orderBy("x"))
        first = distinct.withColumn("_place", place).where(F.col("_place") <= samples)
        found = first.groupBy("position").agg(F.array_sort(F.collect_list("x")).alias("examples"))
        profile = profile.join(F.broadcast(found), "position", "left")  # a row per column
    else:
        profile = profile.withColumn("examples", F.lit(None))
    profile = profile.select(
        "name", "position", "data_type", "is_numeric", "present", "as_number", "rows",
        F.coalesce(F.col("examples").cast("array<string>"), F.array().cast("array<string>")).alias("examples"),
    )
    return profile.withColumns({"unit": unit_of(F.col("name")), "category": category_of(F.col("name"))})


def sample_values(df: DataFrame, samples: int = 5) -> dict[str, list]:
    """First present values per column out of ten rows (an action on ten rows)."""
    rows = df.limit(10).collect()
    return {c: [r[c] for r in rows if r[c] is not None][:samples] for c in df.columns}


def match_columns(single: DataFrame, multi: DataFrame, strict: bool = False) -> DataFrame:
    """Mapping between the single-file feed ``single`` and the multi-file feed ``multi``; see MAPPING_SCHEMA.

    ``strict`` uses whole-word fragments and gives every column to one partner only.
    """
    spark = single.sparkSession
    left = describe_columns(spark, single.columns, strict)
    right = describe_columns(spark, multi.columns, strict)
    both = sorted(set(single.columns) & set(multi.columns))

    exact = left.join(right.select("name"), "name").select(
        F.col("name").alias("unified_name"),
        F.col("name").alias("single_name"),
        F.col("name").alias("multi_name"),
        F.lit("exact_match").alias("type"),
        "category",
        "unit",
        F.lit(None).cast("double").alias("similarity_score"),
        F.lit("high").alias("confidence"),
    )

    def words(c):
        return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"(\w+)"), 1))

    a = left.where(~F.col("name").isin(both)).select(
        F.col("name").alias("single_name"), "category", F.col("unit").alias("single_unit"), F.col("position").alias("single_position")
    )
    b = right.where(~F.col("name").isin(both)).select(
        F.col("name").alias("multi_name"), "category", F.col("unit").alias("multi_unit"), F.col("position").alias("multi_position")
    )
    wa, wb = words(F.col("single_name")), words(F.col("multi_name"))
    overlap = F.coalesce(
        F.try_divide(F.size(F.array_intersect(wa, wb)), F.size(F.array_union(wa, wb))).cast("double"), F.lit(0.0)
    )
    same_unit = F.coalesce(F.col("single_unit") == F.col("multi_unit"), F.lit(False)).cast("double")
    score = F.when(F.lower("single_name") == F.lower("multi_name"), F.lit(1.0)).otherwise(
        F.least(overlap * 0.4 + 0.3 + same_unit * 0.3, F.lit(1.0))
    )
    scored = (
        a.join(b, "category")
        .where(~F.col("category").isin(*UNMATCHED_CATEGORIES))
        .withColumn("similarity_score", score)
        .where("similarity_score > 0.5")
    )
    best = F.row_number().over(W.partitionBy("single_name").orderBy(F.desc("similarity_score"), "multi_position"))
    scored = scored.withColumn("_best", best).where("_best = 1")
    if strict:
        one = F.row_number().over(W.partitionBy("multi_name").orderBy(F.desc("similarity_score"), "single_position"))
        scored = scored.withColumn("_one", one).where("_one = 1")
    semantic = scored.select(
        unified_name(F.col("single_name"), F.col("multi_name")).alias("unified_name"),
        "single_name",
        "multi_name",
        F.lit("semantic_match").alias("type"),
        "category",
        F.coalesce("single_unit", "multi_unit").alias("unit"),
        "similarity_score",
        F.when(F.col("similarity_score") > 0.7, "medium").otherwise("low").alias("confidence"),
    )

    def first_column(variants: str, columns: list[str]) -> Column:
        names = F.array(*[F.lit(c) for c in columns])
        hits = F.flatten(
            F.transform(variants, lambda v: F.filter(names, lambda c: F.contains(F.lower(c), F.lower(v))))
        )
        return F.get(hits, 0)

    known = spark.createDataFrame(
        KNOWN_PAIRS, "unified_name string, single array<string>, multi array<string>, category string, unit string"
    ).select(
        "unified_name",
        first_column("single", single.columns).alias("single_name"),
        first_column("multi", multi.columns).alias("multi_name"),
        F.lit("known_mapping").alias("type"),
        "category",
        "unit",
        F.lit(None).cast("double").alias("similarity_score"),
        F.lit("high").alias("confidence"),
    ).where("single_name IS NOT NULL AND multi_name IS NOT NULL")
    found = exact.unionByName(semantic)
    return found.unionByName(known.join(found, ["single_name", "multi_name"], "left_anti"))


def match_by_groups(first: DataFrame, second: DataFrame) -> DataFrame:
    """Simple matcher: equal names, then name groups by exact variant, then by substring either way."""
    spark = first.sparkSession
    equal = [(c, c, c, "exact_match") for c in first.columns if c in second.columns]

    def pick(columns: list[str]) -> Column:
        names = F.array(*[F.lit(c) for c in columns])
        exact = F.get(F.filter("variants", lambda v: F.array_contains(names, v)), 0)
        loose = F.get(
            F.filter(
                names,
                lambda c: F.exists(
                    "variants",
                    lambda v: F.contains(F.lower(c), F.lower(v)) | F.contains(F.lower(v), F.lower(c)),
                ),
            ),
            0,
        )
        return F.coalesce(exact, loose)

    groups = spark.createDataFrame(NAME_GROUPS, "unified_name string, variants array<string>").select(
        "unified_name",
        pick(first.columns).alias("multi_name"),
        pick(second.columns).alias("single_name"),
        F.lit("semantic_match").alias("type"),
    ).where("multi_name IS NOT NULL AND single_name IS NOT NULL")
    names = spark.createDataFrame(equal, "unified_name string, multi_name string, single_name string, type string")
    # A group result replaces an equal-name result under the same unified name.
    return names.join(groups, "unified_name", "left_anti").unionByName(groups)


def mapping_report(mapping: DataFrame, by: str = "type") -> DataFrame:
    """Number of mapped features per type or category, most frequent first."""
    return mapping.groupBy(by).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), by)


def required_features(mapping: DataFrame) -> DataFrame:
    """Mapped features usable for learning: label names are not features."""
    return mapping.where(F.col("unified_name").isNotNull() & ~F.col("unified_name").isin(*LABEL_CANDIDATES))


def check_requirements(features: list[str], has_label: bool = True) -> dict[str, bool]:
    """Requirement flags of a harmonized table."""
    some = len(features) >= 1
    flags = {
        "has_label_column": has_label,
        "has_numeric_features": some,
        "min_features_present": some,
        "sufficient_for_training": some,
        "sufficient_for_shap": some,
        "sufficient_for_lime": some,
    }
    return {**flags, "all_requirements_met": all(flags.values())}
