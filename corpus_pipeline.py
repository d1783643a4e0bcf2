"""A corpus pipeline of five stages, each calling one operator of ``flowcairn.llm``.

Columns whose names begin with ``__`` are reserved; all other columns of the documents travel along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowcairn.llm.decontaminate import find_overlap
from flowcairn.llm.jaccard_groups import SEMI_JOIN_ROWS, similarity_components
from flowcairn.llm.packing import pack
from flowcairn.llm.secret_scan import find_secrets, redact
from flowcairn.llm.shared import materialise
from flowcairn.llm.toxicity import DECISION, fit


def _listed(ids: DataFrame) -> DataFrame:
    """A list of ids for a semi or anti join: broadcast while it is short, shuffled beyond that."""
    ids = materialise(ids, "listed")
    return F.broadcast(ids) if ids.count() <= SEMI_JOIN_ROWS else ids


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the classifier, fitted on the labels of these documents, calls toxic."""
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = model.score(docs, score_col="__toxicity")
    return scored.where(F.col("__toxicity") < DECISION).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of linked ones, and one of exactly repeated rows.

    Documents without words or without an id link with nothing and stay.
    """
    found = materialise(similarity_components(docs), "components")
    gone = _listed(found.where("doc_id <> component_id").select("doc_id").distinct())
    kept = docs.join(gone, "doc_id", "left_anti")
    again = found.where("doc_id IS NOT NULL AND n_shingles > 0").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if again.isEmpty():
        return kept.select(docs.columns)
    again = _listed(again)
    worded = F.coalesce(F.trim(F.regexp_replace("text", r"[\x09-\x0D]", " ")), F.lit("")) != ""
    repeated = kept.join(again, "doc_id", "left_semi")
    once = repeated.where(worded).dropDuplicates(["doc_id", "text"]).unionByName(repeated.where(~worded))
    return kept.join(again, "doc_id", "left_anti").unionByName(once).select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in which a window of ten benchmark words occurs."""
    found = find_overlap(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), prefix="__overlap_")
    return found.where(F.size("__overlap_spans") == 0).select(docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every secret by a mark; ``n_chars`` follows the text where it changed."""
    found = find_secrets(docs, prefix="__secret_")
    changed = F.size("__secret_spans") > 0
    if "n_chars" not in docs.columns:
        return redact(found, prefix="__secret_").select(docs.columns)
    clean = redact(found.withColumn("__changed", changed), prefix="__secret_")
    n_chars = F.when(F.col("__changed"), F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return clean.withColumn("n_chars", n_chars).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Everything that is left, concatenated and cut into sequences of 2048 ids: a row for each piece."""
    columns = ("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "ids")
    return pack(docs).select(*columns)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("packing", packing),
]

# Tokenization and the fitted classifier cannot be said in SQL; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents; each stage's result is written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
