"""Concatenate-and-cut packing: prefix sums over partition totals, then fixed windows."""

from __future__ import annotations

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowcairn.llm.shared import lean, materialise
from flowcairn.llm.tokens import encoder, text_slices, tokenizer_path

ENCODED = "doc_id {id}, part int, local long, n_tokens long, ids binary"


def _encode_partition(path: str, end_id: int):
    def run(batches):
        part = TaskContext.get().partitionId()
        coder, end, local = encoder(path), end_id.to_bytes(4, "little"), 0
        for batch in batches:
            texts = batch["text"].tolist()
            for a, b in text_slices(texts):
                ids = coder.encode(texts[a:b], end)
                counts = [len(x) // 4 for x in ids]
                starts = []
                for n in counts:
                    starts.append(local)
                    local += n
                yield pd.DataFrame(
                    {"doc_id": batch["doc_id"].iloc[a:b].array, "part": part, "local": starts, "n_tokens": counts, "ids": ids}
                )

    return run


def encode_partitions(docs: DataFrame, path: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """First pass: ids of every document with its offset inside its partition, kept as a table."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    coded = rows.mapInPandas(lean("encoders", _encode_partition(path, end_id)), ENCODED.format(id=kind))
    return materialise(coded, "encoded")


def pack(
    docs: DataFrame,
    length: int = 2048,
    path: str | None = None,
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Cut the concatenation of all documents into windows of ``length`` ids; one row per piece.

    First pass: each partition encodes its documents and notes their offsets inside the partition.
    A prefix sum over the partition totals (one row per partition) turns them into global offsets.
    Second pass: each document is cut where the global offset passes a multiple of ``length``; nothing
    is shuffled. Only the last sequence may be short.

    Returns doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.
    A null or empty text is the end id alone; null and repeated document ids are kept as rows of their
    own; an empty table gives no rows; other columns are ignored.
    """
    path = path or tokenizer_path()
    coded = encode_partitions(docs, path, end_id, id_col, text_col)
    totals = coded.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = F.sum("total").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    bases = totals.select("part", F.coalesce(before, F.lit(0)).alias("base"))  # a row per partition
    at = coded.join(F.broadcast(bases), "part").withColumn("first", F.col("base") + F.col("local"))
    last = F.col("first") + F.col("n_tokens") - 1
    window = F.sequence((F.col("first") / length).cast("long"), (last / length).cast("long"))
    cut = at.select("doc_id", "first", "n_tokens", "ids", F.explode(window).alias("sequence_id"))
    begin = F.greatest(F.col("first"), F.col("sequence_id") * length)
    end = F.least(F.col("first") + F.col("n_tokens"), (F.col("sequence_id") + 1) * length)
    cut = cut.select(
        "doc_id", "ids", "n_tokens", "sequence_id",
        (begin - F.col("first")).alias("start"),
        (end - begin).alias("length"),
        (begin - F.col("sequence_id") * length).alias("offset"),
    )
    piece = F.substring(F.col("ids"), (F.col("start") * 4 + 1).cast("int"), (F.col("length") * 4).cast("int"))
    return cut.select(
        "doc_id", "start", "length", piece.alias("ids"), F.col("n_tokens").alias("doc_tokens"), "sequence_id", "offset"
    )


def sequences(pieces: DataFrame, length: int = 2048, pad_id: int = 0) -> DataFrame:
    """Whole sequences from pieces: sequence_id, n_tokens, padded_length, ids (binary), pieces.

    At most ``length`` ids meet in one group. A short sequence is padded to ``length`` unless its own
    length is a power of two.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "start", "length", "ids")))
    rows = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), parts.alias("parts"))
    n = F.col("n_tokens")
    whole = (n.bitwiseAND(n - 1) == 0) | (n >= length)
    padded = F.when(whole, n).otherwise(F.lit(length))
    hexed = F.array_join(F.transform("parts", lambda x: F.hex(x["ids"])), "")
    pad = F.repeat(F.lit(pad_id.to_bytes(4, "little").hex()), (padded - n).cast("int"))
    return rows.select(
        "sequence_id", "n_tokens", padded.alias("padded_length"),
        F.unhex(F.concat(hexed, pad)).alias("ids"),
        F.transform("parts", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["start"].alias("start"), x["length"].alias("length"))).alias("pieces"),
    )
