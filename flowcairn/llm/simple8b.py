"""Simple-8b token files: word-aligned integer coding with escapes and per-block offsets.

A shard file is a series of groups. A group holds whole documents and about a million ids:

    magic ``S8G1`` | six unsigned 64-bit counts: documents, ids, blocks, words, escapes, null ids
    document ids (signed 64) | null positions (unsigned 64) | ids per document (unsigned 64)
    word offset of every block (unsigned 32) | words (unsigned 64)
    escape positions (unsigned 64) | escape values (unsigned 64)

All numbers are little-endian. Ids are coded in blocks of ``BLOCK``; a word's four low bits select how
many ids it holds and of which width. An id of 60 bits or more is coded as 0 and listed as an escape.
A file ends with a group of no documents, so a cut file is noticed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowcairn.llm.shared import lean, materialise, open_store, shared_folder
from flowcairn.llm.tokens import encoder, text_slices, tokenizer_path

# Fixed values of the Simple-8b format: ids per word and bits per id, by selector.
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
BLOCK = 512
GROUP_IDS = 1 << 20
MAGIC = b"S8G1"


_SHORT = np.array([i.bit_length() for i in range(1 << 16)], dtype=np.int8)


def _bit_lengths(values: np.ndarray) -> np.ndarray:
    """Bits of values below 2**60; at most one too many near powers of two above 2**53."""
    if not len(values) or values.max() < len(_SHORT):
        return _SHORT[values.astype(np.uint16)]
    return np.minimum(np.frexp(values.astype(np.float64))[1], 60).astype(np.int8)


def _widest(bits: np.ndarray, count: int) -> np.ndarray:
    """The most bits of every ``count`` neighbouring ids."""
    span = 1
    while 2 * span <= count:
        bits, span = np.maximum(bits[:-span], bits[span:]), 2 * span
    rest = count - span
    return np.maximum(bits[:-rest], bits[rest:]) if rest else bits


def _narrowest_runs(bits: np.ndarray) -> dict[int, int]:
    """By length 1, 2, 4 ...: the fewest bits that hold all ids of an aligned run of that length.

    Ids in a row, c of them, hold an aligned run of the power of two below (c + 1) / 2 or equal to it.
    """
    found, span = {1: int(bits.min())}, 1
    while len(bits) > 1:
        bits, span = np.maximum(bits[: len(bits) // 2 * 2 : 2], bits[1::2]), 2 * span
        found[span] = int(bits.min())
    return found


def encode_words(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, the first word of every block, and the positions of escaped values."""
    values = np.ascontiguousarray(values, dtype=np.uint64)
    n = len(values)
    escapes = np.flatnonzero(values >= np.uint64(1 << 60))
    if len(escapes):
        values = values.copy()
        values[escapes] = 0
    if n == 0:
        return np.zeros(0, "<u8"), np.zeros(0, "<u4"), escapes
    bits = _bit_lengths(values)
    room = np.resize(np.arange(BLOCK, 0, -1, dtype=np.int16), n)  # ids left in the block
    selector = np.full(n, 15, dtype=np.int8)
    runs = _narrowest_runs(bits)
    for s in range(14, -1, -1):  # the last that fits is the one with most ids
        count = int(COUNTS[s])
        if count > n:
            break
        if runs[1 << ((count + 1) // 2).bit_length() - 1] > WIDTHS[s]:
            continue  # no ids in a row fit
        fits = _widest(bits, count) <= WIDTHS[s]
        fits &= room[: n - count + 1] >= count
        np.copyto(selector[: n - count + 1], np.int8(s), where=fits)
    # Every block takes its words one step at a time, all blocks together.
    starts = np.arange(0, n, BLOCK)
    ends = np.minimum(starts + BLOCK, n)
    at, alive = starts.copy(), np.arange(len(starts))
    heads, owners = [], []
    while len(alive):
        heads.append(at[alive])
        owners.append(alive)
        at[alive] += COUNTS[selector[at[alive]]]
        alive = alive[at[alive] < ends[alive]]
    head, owner = np.concatenate(heads), np.concatenate(owners)
    head = np.sort(head)
    chosen = selector[head]
    words = chosen.astype(np.uint64)
    for s in np.unique(chosen):
        rows = np.flatnonzero(chosen == s)
        if WIDTHS[s]:
            lanes = values[head[rows, None] + np.arange(COUNTS[s])]
            shifts = (4 + np.arange(COUNTS[s]) * WIDTHS[s]).astype(np.uint64)
            words[rows] |= np.bitwise_or.reduce(lanes << shifts, axis=1)
    per_block = np.bincount(owner, minlength=len(starts))
    offsets = np.concatenate([[0], np.cumsum(per_block)[:-1]])
    return words.astype("<u8"), offsets.astype("<u4"), escapes


def decode_words(words: np.ndarray, n: int) -> np.ndarray:
    """All ids of ``words``; a run of whole blocks decodes alone, from its first word."""
    words = np.asarray(words, dtype=np.uint64)
    chosen = (words & np.uint64(15)).astype(np.int64)
    head = np.concatenate([[0], np.cumsum(COUNTS[chosen])])
    if head[-1] != n:
        raise ValueError("the words hold another number of ids")
    values = np.zeros(n, dtype=np.uint64)
    for s in np.unique(chosen):
        rows = np.flatnonzero(chosen == s)
        if WIDTHS[s]:
            shifts = (4 + np.arange(COUNTS[s]) * WIDTHS[s]).astype(np.uint64)
            mask = np.uint64((1 << int(WIDTHS[s])) - 1)
            values[head[rows, None] + np.arange(COUNTS[s])] = (words[rows, None] >> shifts) & mask
    return values


def decode_block(words: np.ndarray, offsets: np.ndarray, block: int, n: int) -> np.ndarray:
    """The ids of one block of a group with ``n`` ids, read at its offset without the blocks before it."""
    end = offsets[block + 1] if block + 1 < len(offsets) else len(words)
    return decode_words(words[offsets[block] : end], min(BLOCK, n - block * BLOCK))


def write_group(out, doc_ids: list, lengths: list[int], values: np.ndarray) -> None:
    nulls = np.array([i for i, d in enumerate(doc_ids) if pd.isna(d)], dtype="<u8")
    numbers = np.array([0 if pd.isna(d) else int(d) for d in doc_ids], dtype="<i8")
    words, offsets, escapes = encode_words(values)
    counts = [len(doc_ids), len(values), len(offsets), len(words), len(escapes), len(nulls)]
    escaped = np.asarray(values, dtype=np.uint64)[escapes]
    out.write(MAGIC + np.array(counts, dtype="<u8").tobytes())
    for part in (numbers, nulls, np.array(lengths, dtype="<u8"), offsets, words, escapes.astype("<u8"), escaped.astype("<u8")):
        out.write(part.tobytes())


def read_groups(source):
    """Yield (document ids, ids per document, all ids) group by group."""

    def take(n: int, kind: str) -> np.ndarray:
        data = source.read(n * np.dtype(kind).itemsize)
        if len(data) != n * np.dtype(kind).itemsize:
            raise ValueError("the file is cut")
        return np.frombuffer(data, dtype=kind)

    while True:
        if source.read(4) != MAGIC:
            raise ValueError("not a token file, or a cut one")
        n_docs, n_ids, n_blocks, n_words, n_escapes, n_nulls = take(6, "<u8").tolist()
        if n_docs == 0:
            return
        numbers, nulls, lengths = take(n_docs, "<i8"), take(n_nulls, "<u8"), take(n_docs, "<u8")
        take(n_blocks, "<u4")
        values = decode_words(take(n_words, "<u8"), n_ids)
        escapes = take(n_escapes, "<u8")
        values[escapes.astype(np.int64)] = take(n_escapes, "<u8")
        ids = pd.array(numbers, dtype="Int64")
        ids[nulls.astype(np.int64)] = pd.NA
        yield ids, lengths.astype(np.int64), values


def _write_shards(folder: str, path: str, end_id: int):
    def run(batches):
        part = TaskContext.get().partitionId()
        coder, end = encoder(path), end_id.to_bytes(4, "little")
        store, root = open_store(folder)
        store.create_dir(root, recursive=True)
        name = f"{root}/shard-{part:06d}.s8b"
        draft = f"{root}/.shard-{part:06d}-{TaskContext.get().taskAttemptId()}"
        n_docs = n_ids = 0
        docs, lengths, parts, held = [], [], [], 0
        with store.open_output_stream(draft) as out:
            for batch in batches:
                texts, numbers = batch["text"].tolist(), batch["doc_id"].tolist()
                for a, b in text_slices(texts):
                    for doc, ids in zip(numbers[a:b], coder.encode(texts[a:b], end)):
                        docs.append(doc)
                        lengths.append(len(ids) // 4)
                        parts.append(ids)
                        held += len(ids) // 4
                        if held >= GROUP_IDS:
                            write_group(out, docs, lengths, np.frombuffer(b"".join(parts), dtype="<u4"))
                            n_docs, n_ids = n_docs + len(docs), n_ids + held
                            docs, lengths, parts, held = [], [], [], 0
            if docs:
                write_group(out, docs, lengths, np.frombuffer(b"".join(parts), dtype="<u4"))
                n_docs, n_ids = n_docs + len(docs), n_ids + held
            write_group(out, [], [], np.zeros(0, dtype="<u4"))
        if n_docs:
            store.move(draft, name)  # a second attempt writes the same bytes
            yield pd.DataFrame({"shard": [part], "file": [f"shard-{part:06d}.s8b"], "n_docs": [n_docs], "n_ids": [n_ids]})
        else:
            store.delete_file(draft)

    return run


def write_tokens(
    docs: DataFrame,
    folder: str | None = None,
    path: str | None = None,
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> tuple[str, DataFrame]:
    """Encode every document and write shard files in ascending document order.

    Returns the folder and the manifest: shard, file, n_docs, n_ids, first_id (ids in all earlier
    shards). A null text is the end id alone. Null document ids come first; rows that share an id are
    ordered by text. An empty table writes no file. Document ids are 64-bit integers; other columns are
    ignored.
    """
    folder = folder or shared_folder(docs.sparkSession, "tokens")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ordered = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    shards = ordered.mapInPandas(
        lean("encoders", _write_shards(folder, path or tokenizer_path(), end_id)), "shard int, file string, n_docs long, n_ids long"
    )
    manifest = materialise(shards, "shards")
    earlier = F.sum("n_ids").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1))  # a row per file
    return folder, manifest.withColumn("first_id", F.coalesce(earlier, F.lit(0)))


def _read_shards(folder: str):
    def run(batches):
        store, root = open_store(folder)
        for batch in batches:
            for file, first in zip(batch["file"], batch["first_id"]):
                start = int(first)
                with store.open_input_stream(f"{root}/{file}") as source:
                    for docs, lengths, values in read_groups(source):
                        data = values.astype("<u4").tobytes()
                        ends = np.cumsum(lengths)
                        cuts = (np.concatenate([[0], ends]) * 4).tolist()
                        ids = [data[a:b] for a, b in zip(cuts, cuts[1:])]
                        yield pd.DataFrame({"doc_id": docs, "start": start + ends - lengths, "n_tokens": lengths, "ids": ids})
                        start += int(ends[-1])

    return run


def read_tokens(folder: str, manifest: DataFrame) -> DataFrame:
    """Documents from the files: doc_id, start, n_tokens, ids (little-endian unsigned 32-bit).

    A task streams one file after another, a group at a time. Ids of 32 bits are expected here;
    ``decode_words`` and ``read_groups`` give wider ones.
    """
    spread = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    files = manifest.select("file", "first_id").repartition(spread, "file")
    return files.mapInPandas(lean("shards", _read_shards(folder)), "doc_id long, start long, n_tokens long, ids binary")
