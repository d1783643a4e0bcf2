"""Tables of source files: search, exclusion, duplicates, caps, manifest and inventory.

A listing is a DataFrame of (path, name, bytes); file contents are not read.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Files with these words in their name are documentation, not data.
NOT_DATA = ("example", "sample", "template", "structure")
# Attack names by lower-case file stem.
ATTACK_NAMES = {
    "portmap": "PortMap", "syn": "SYN", "udplag": "UDP-Lag", "netbios": "NetBIOS", "ldap": "LDAP", "mssql": "MSSQL",
    "udp": "UDP", "ntp": "NTP", "dns": "DNS", "tftp": "TFTP", "ssdp": "SSDP", "snmp": "SNMP", "webddos": "WebDDoS",
    "portscan": "PortScan", "benign": "Benign",
}
# Attacks expected on the training and on the test day.
TRAINING_DAY = ("Benign", "PortMap", "NetBIOS", "LDAP", "MSSQL", "UDP", "UDP-Lag", "SYN")
TEST_DAY = (
    "Benign", "NTP", "DNS", "LDAP", "MSSQL", "NetBIOS", "SNMP", "SSDP", "UDP", "UDP-Lag", "WebDDoS", "SYN", "TFTP",
    "PortScan",
)


def list_files(spark: SparkSession, folder: str, pattern: str = "*.csv") -> DataFrame:
    """All data files below a folder at any depth; hidden folders are skipped."""
    found = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .load(folder)
    )
    return found.select(
        "path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes")
    )


def without_documentation(listing: DataFrame) -> DataFrame:
    """Drop files whose name marks them as documentation."""
    return listing.where(~F.lower("name").rlike("|".join(NOT_DATA)))


def without_duplicates(listing: DataFrame) -> DataFrame:
    """One file per name: the first by path."""
    first = F.min_by(F.struct("path", "bytes"), F.col("path")).alias("_f")
    return listing.groupBy("name").agg(first).select("_f.path", "name", "_f.bytes")


def choose_files(listing: DataFrame, most: int, seed: int = 42) -> DataFrame:
    """At most ``most`` files in seeded order, sorted by name."""
    return listing.orderBy(F.xxhash64("name", F.lit(seed)), "name").limit(most).orderBy("name")


def new_files(listing: DataFrame, manifest: str) -> DataFrame:
    """Files not in the manifest table yet; all of them when there is no manifest."""
    spark = listing.sparkSession
    try:
        loaded = spark.read.parquet(manifest).select("path").distinct()
    except AnalysisException:
        return listing
    return listing.join(loaded, "path", "left_anti")


def record_loaded(listing: DataFrame, manifest: str) -> None:
    """Append files to the manifest."""
    listing.select("path", "name", "bytes", F.current_timestamp().alias("loaded_at")).write.mode("append").parquet(
        manifest
    )


def attack_name(name: Column) -> Column:
    """Attack by file name: no extension and prefix, known spelling, otherwise capitalised."""
    stem = F.regexp_replace(F.regexp_replace(name, r"\.[^.]*$", ""), "^DrDoS_", "")
    stem = F.regexp_replace(stem, "[_ ]", "-")
    known = F.create_map(*[F.lit(x) for pair in ATTACK_NAMES.items() for x in pair])
    rest = F.substring(stem, F.lit(2), F.length(stem))
    capitalised = F.concat(F.upper(F.substring(stem, 1, 1)), F.lower(rest))
    return F.coalesce(F.try_element_at(known, F.lower(stem)), capitalised)


def inventory(listing: DataFrame) -> DataFrame:
    """Per attack: number of files, whether reflected and direct variants exist, and the expected days.

    Expected attacks without a file appear with 0 files; attacks nobody expects have no day.
    """
    spark = listing.sparkSession
    days = sorted(set(TRAINING_DAY) | set(TEST_DAY))
    expected = spark.createDataFrame(
        [(a, a in TRAINING_DAY, a in TEST_DAY) for a in days], "attack string, training_day boolean, test_day boolean"
    )
    reflected = F.col("name").contains("DrDoS")
    found = listing.groupBy(attack_name(F.col("name")).alias("attack")).agg(
        F.count(F.lit(1)).alias("files"),
        F.bool_or(reflected).alias("has_reflected"),
        F.bool_or(~reflected).alias("has_direct"),
    )
    no = F.lit(False)
    return found.join(F.broadcast(expected), "attack", "full").select(
        "attack",
        F.coalesce("files", F.lit(0)).cast("long").alias("files"),
        F.coalesce("has_reflected", no).alias("has_reflected"),
        F.coalesce("has_direct", no).alias("has_direct"),
        F.coalesce(F.col("has_reflected") & F.col("has_direct"), no).alias("both_variants"),
        F.coalesce("training_day", no).alias("training_day"),
        F.coalesce("test_day", no).alias("test_day"),
        (F.coalesce("training_day", "test_day").isNotNull() & F.col("files").isNull()).alias("missing"),
        F.col("training_day").isNull().alias("unexpected"),
    )
