"""Readers of the two flow feeds.

Headers are read first, so every file is scanned with an explicit schema: no inference pass, and files
whose columns come in another order or number are aligned by name.
"""

from __future__ import annotations

from collections import defaultdict
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowcairn.functions.labels import attack_label, ddos_label, keep_binary_types
from flowcairn.functions.names import trim_names
from flowcairn.operators.harmonize import concat
from flowcairn.operators.matching import match_columns, required_features
from flowcairn.operators.splits import cap_per_source, sample_exact, sample_fraction
from flowcairn.sources.listing import (
    choose_files,
    list_files,
    new_files,
    record_loaded,
    without_documentation,
    without_duplicates,
)

# Text columns of the feeds; every other column is numeric.
TEXT_COLUMNS = (
    "Flow ID", "Source IP", "Destination IP", "Timestamp", "SimillarHTTP", "Label", "src_ip", "dst_ip", "proto", "type",
    "service", "conn_state",
)
FILE_COLUMN = "source_file"


def read_header(spark: SparkSession, path: str) -> list[str]:
    """Trimmed column names of a CSV file, from its first line only."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(where)
    try:
        line = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8")).readLine()
    finally:
        stream.close()
    if line is None:
        return []
    return [c.strip().strip('"').strip() for c in line.removeprefix("﻿").split(",")]


def feed_schema(columns: list[str]) -> T.StructType:
    """Explicit schema of a feed file: known text columns, doubles otherwise."""
    return T.StructType(
        [T.StructField(c, T.StringType() if c in TEXT_COLUMNS else T.DoubleType()) for c in columns]
    )


def read_files(spark: SparkSession, paths: list[str], with_file: bool = False) -> DataFrame:
    """One table from CSV files; files with equal headers share a scan, different ones are united by name."""
    with ThreadPoolExecutor(max_workers=8) as pool:
        headers = list(pool.map(lambda p: tuple(read_header(spark, p)), paths))
    groups: dict[tuple[str, ...], list[str]] = defaultdict(list)
    for path, header in zip(paths, headers):
        if not header:
            raise ValueError(f"{path} has no header")
        groups[header].append(path)
    parts = []
    for header, files in groups.items():
        # Malformed numbers become NULL, as with a coercing reader.
        df = spark.read.schema(feed_schema(list(header))).option("header", "true").option("mode", "PERMISSIVE").option(
            "ignoreLeadingWhiteSpace", "true"
        ).option("ignoreTrailingWhiteSpace", "true").option("positiveInf", "Infinity").csv(files)
        parts.append(df.withColumn(FILE_COLUMN, F.col("_metadata.file_path")) if with_file else df)
    if not parts:
        raise FileNotFoundError("no file with a header")
    return concat(parts)


def read_single_file_feed(spark: SparkSession, candidates: list[str]) -> DataFrame:
    """The single-file feed from the first path that exists."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in candidates:
        where = jvm.org.apache.hadoop.fs.Path(path)
        if where.getFileSystem(conf).exists(where):
            return trim_names(read_files(spark, [path]))
    raise FileNotFoundError(f"none of {candidates} exists")


def read_multi_file_feed(
    spark: SparkSession,
    folder: str,
    manifest: str | None = None,
    max_files: int | None = None,
    max_rows_per_file: int | None = None,
    seed: int = 42,
    with_file: bool = False,
) -> DataFrame | None:
    """The multi-file feed; with a manifest only files that were not loaded before, None if there is none.

    ``max_files`` and ``max_rows_per_file`` are the caller's own limits.
    """
    files = without_duplicates(without_documentation(list_files(spark, folder)))
    if manifest:
        files = new_files(files, manifest)
    if max_files is not None:
        files = choose_files(files, max_files, seed)
    rows = files.orderBy("name").collect()  # one short row per file
    if not rows:
        return None
    df = read_files(spark, [r["path"] for r in rows], with_file=True)
    if max_rows_per_file is not None:
        keys = [c for c in df.columns if c != FILE_COLUMN]
        df = cap_per_source(df, FILE_COLUMN, keys, max_rows_per_file, seed)
    return df if with_file else df.drop(FILE_COLUMN)


def load_new_files(spark: SparkSession, folder: str, manifest: str, target: str, **options) -> int:
    """Append the files that are not in the manifest to the Parquet table ``target``; returns their number.

    Each load is a folder of its own below ``target``, a value of the partition column ``load``. Files
    enter the manifest only after their rows are written, so a load that fails is done again.
    """
    df = read_multi_file_feed(spark, folder, manifest, with_file=True, **options)
    if df is None:
        return 0
    batch = f"{target.rstrip('/')}/load={uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(batch)
    loaded = spark.read.parquet(batch).select(F.col(FILE_COLUMN).alias("path")).distinct()
    listing = new_files(without_duplicates(without_documentation(list_files(spark, folder))), manifest)
    record_loaded(listing.join(loaded, "path", "left_semi"), manifest)
    return loaded.count()


def sample_feed(df: DataFrame, ratio: float, keys: list[str] | None = None, exact: bool = False, seed: int = 42) -> DataFrame:
    """Sample of a feed: all of it at 1, otherwise exact or by row hash, at every ratio alike."""
    keys = keys or df.columns
    if ratio >= 1.0:
        return df
    return sample_exact(df, keys, ratio=ratio, seed=seed) if exact else sample_fraction(df, ratio, keys, seed)


def load_both(
    spark: SparkSession,
    single_file: list[str],
    folder: str,
    ratio: float = 1.0,
    tags: tuple[str, str] = ("single_file", "multi_file"),
    allow_missing: bool = False,
) -> DataFrame:
    """Both feeds as one lazy table of their shared columns plus ``is_ddos``, ``type`` and ``dataset``.

    ``tags`` are the values of ``dataset``. A feed without data is an error unless ``allow_missing``.
    """
    parts = []
    try:
        single = read_single_file_feed(spark, single_file)
        if "type" in single.columns:
            single = keep_binary_types(single)
            single = single.withColumn("is_ddos", ddos_label(single)).withColumn("type", F.col("is_ddos"))
        parts.append(single.withColumn("dataset", F.lit(tags[0])))
    except FileNotFoundError:
        if not allow_missing:
            raise
    multi = read_multi_file_feed(spark, folder)
    if multi is not None:
        if "Label" in multi.columns:
            multi = multi.withColumn("is_ddos", attack_label(multi, "Label")).withColumn("type", F.col("is_ddos"))
        parts.append(multi.withColumn("dataset", F.lit(tags[1])))
    elif not allow_missing:
        raise FileNotFoundError(f"no data file below {folder}")
    if not parts:
        raise FileNotFoundError("neither feed has data")
    if len(parts) == 2:
        shared = [c for c in parts[0].columns if c in parts[1].columns]
        parts = [p.select(*shared) for p in parts]
    out = concat(parts)
    return sample_fraction(out, ratio, out.columns) if ratio < 1.0 else out


def discover_features(spark: SparkSession, single_file: str, folder: str) -> DataFrame:
    """Mapping of the columns both feeds share, from headers alone; later scans read only these."""
    files = [r["path"] for r in without_documentation(list_files(spark, folder)).orderBy("name").collect()]
    single = spark.createDataFrame([], feed_schema(read_header(spark, single_file)))
    names: dict[str, None] = {}
    for path in files:
        names.update(dict.fromkeys(read_header(spark, path)))
    return required_features(match_columns(single, spark.createDataFrame([], feed_schema(list(names)))))


def head_sample(spark: SparkSession, path: str, rows: int = 1000) -> DataFrame:
    """The first rows of a file, for a look before the load."""
    return read_files(spark, [path]).limit(rows)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """CSV or Parquet by extension."""
    return spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else read_files(spark, [path])


def count_rows(spark: SparkSession, path: str) -> int:
    """Rows of a source without loading its columns."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path).count()
    return spark.read.option("header", "true").csv(path).count()


def preview(df: DataFrame, keys: list[str], seed: int = 42) -> DataFrame:
    """First row by key and one seeded other row."""
    first = df.orderBy(*keys).limit(1)
    other = sample_exact(df.join(first.select(*keys), keys, "left_anti"), keys, n=1, seed=seed)
    return first.unionByName(other)
