"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, scanned over whole texts."""

from __future__ import annotations

import re
import uuid
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowcairn.llm.shared import lean, materialise, worker_state

# Words are runs of digits, ASCII letters and everything beyond ASCII, whose UTF-8 bytes are all above 7F.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
MOST_BYTES = 64 << 20  # of benchmark text in one broadcast
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words; only A to Z change."""
    return WORD.findall((text or "").encode("utf-8").lower())


class NgramSet:
    """Windows of benchmark items as word numbers: hashes for the scan, the words for the check of a hit."""

    def __init__(self, items: list[tuple[object, str | None]], size: int):
        self.vocabulary: dict[bytes, int] = {}
        windows: dict[tuple[int, ...], set] = {}
        for item_id, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            n = min(size, len(ids))
            if n:
                for i in range(len(ids) - n + 1):
                    windows.setdefault(tuple(ids[i : i + n]), set()).add(item_id)
        self.by_length: dict[int, tuple[np.ndarray, dict[tuple[int, ...], set]]] = {}
        for n in sorted({len(w) for w in windows}):
            own = {w: found for w, found in windows.items() if len(w) == n}
            rows = np.array(list(own), dtype=np.uint64).reshape(len(own), n)
            self.by_length[n] = (np.unique(self._hash(rows.T, n, len(rows))), own)

    @staticmethod
    def _hash(columns, n: int, count: int) -> np.ndarray:
        total = np.zeros(count, dtype=np.uint64)
        for k in range(n):
            total = (total + columns[k]) * MULTIPLIER
            total ^= total >> np.uint64(29)
        return total

    def scan(self, text: str | None) -> tuple[int, np.ndarray, set]:
        """Words in the text, which of them are hit (None if none is), and the items with occurring windows."""
        words = words_of(text)
        ids = np.array(list(map(self.vocabulary.get, words, repeat(0))), dtype=np.uint64)
        known = np.concatenate([[0], np.cumsum(ids > 0)])
        hit, items = None, set()
        for n, (hashes, windows) in self.by_length.items():
            if len(ids) < n:
                continue
            starts = np.flatnonzero(known[n:] - known[:-n] == n)  # windows of benchmark words only
            if not len(starts):
                continue
            codes = self._hash([ids[starts + k] for k in range(n)], n, len(starts))
            spots = np.minimum(np.searchsorted(hashes, codes), len(hashes) - 1)
            for start in starts[hashes[spots] == codes].tolist():
                found = windows.get(tuple(ids[start : start + n].tolist()))
                if found:
                    hit = np.zeros(len(ids), dtype=bool) if hit is None else hit
                    hit[start : start + n] = True
                    items |= found
        return len(words), hit, items


def _runs(hit: np.ndarray) -> list[int]:
    """Start and end of every run of hit words, one after the other."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
    return edges.tolist()


def _mark(shared, size: int, columns: list[str]):
    """Add what this slice of the benchmark hits to the marks that earlier slices left."""
    key = uuid.uuid4().hex

    def run(batches):
        state = worker_state("ngram_sets")
        if state.get("key") != key:  # the worker keeps one set, built once
            state.update(key=key, set=NgramSet(shared.value, size))
        grams = state["set"]
        for batch in batches:
            counts, marks, names = [], [], []
            for text, runs, items in zip(batch["__text"], batch["__runs"], batch["__items"]):
                n, hit, found = grams.scan(text)
                if hit is not None and len(runs):
                    for a, b in zip(runs[::2], runs[1::2]):
                        hit[a:b] = True
                counts.append(n)
                marks.append(list(runs) if hit is None else _runs(hit))
                named = {x for x in items if x is not None} | {str(x) for x in found if x is not None}
                names.append(sorted(named) + [None] * (None in found or None in list(items)))
            batch["__words"], batch["__runs"], batch["__items"] = counts, marks, names
            yield batch[columns]

    return run


def find_overlap(
    docs: DataFrame,
    benchmark: DataFrame,
    size: int = 10,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    most_bytes: int = MOST_BYTES,
    prefix: str = "",
) -> DataFrame:
    """The rows with n_words, spans (word ranges that are hit), items (their ids) and n_items added, after ``prefix``.

    A window is ``size`` consecutive words of an item, or all words of a shorter one. Each executor gets
    the windows as a hash set; every window of a document whose words all occur in the benchmark is
    looked up, and a hit is checked word by word. Texts are read whole and nothing is shuffled.

    The broadcast is bounded by ``most_bytes`` of benchmark text. A larger benchmark is cut into slices
    and the documents are scanned once for each, carrying their marks along.

    Null texts and items have no words; null and repeated document ids stay rows of their own; items
    with the same id count once. Items without an id hit words like all others; together they are one of
    ``n_items`` and have no name in ``items``. Empty tables give no rows or no hits. Columns of the added names are
    replaced, all others stay; __text, __runs, __items and __words are reserved.
    """
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).cast("string").alias("text"))
    items = items.where("text IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    added = [f"{prefix}n_words", f"{prefix}spans", f"{prefix}items", f"{prefix}n_items"]
    marked = docs.drop(*added).select(
        "*", F.col(text_col).cast("string").alias("__text"), F.lit(0).cast("long").alias("__words"),
        F.array().cast("array<int>").alias("__runs"), F.array().cast("array<string>").alias("__items"),
    )
    for i, part in enumerate([items] if total <= most_bytes else _cut(items, most_bytes)):
        shared = docs.sparkSession.sparkContext.broadcast([(r["item"], r["text"]) for r in part.collect()])  # bounded by most_bytes
        marked = materialise(marked, "marked") if i else marked
        marked = marked.mapInPandas(lean("ngram_sets", _mark(shared, size, marked.columns)), marked.schema)
    pairs = F.transform(
        F.sequence(F.lit(0), F.greatest(F.size("__runs") - 2, F.lit(0)), F.lit(2)),
        lambda i: F.struct(F.get("__runs", i).alias("first"), F.get("__runs", i + 1).alias("end")),
    )
    spans = F.when(F.size("__runs") > 0, pairs).otherwise(F.array().cast("array<struct<first:int,end:int>>"))
    named = F.filter("__items", lambda x: x.isNotNull())
    found = marked.select(
        "*", F.col("__words").alias(added[0]), spans.alias(added[1]), named.alias(added[2]), F.size("__items").cast("long").alias(added[3])
    )
    return found.drop("__text", "__words", "__runs", "__items")


def _cut(items: DataFrame, most_bytes: int) -> list[DataFrame]:
    """Slices of the benchmark by a hash of the item, each expected to hold half of ``most_bytes``."""
    total = items.agg(F.sum(F.octet_length("text"))).first()[0]
    n = int(2 * total // most_bytes) + 1
    bucket = F.pmod(F.xxhash64("item", "text"), F.lit(n))
    return [items.where(bucket == k) for k in range(n)]


def overlap_report(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated from ``find_overlap``."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + (s["end"] - s["first"]))
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def _without(columns: list[str]):
    def clean(text: str | None, spans) -> str | None:
        if text is None or not len(spans):
            return text
        data = text.encode("utf-8")
        places = [m.span() for m in WORD.finditer(data.lower())]
        out, at = [], 0
        for span in spans:
            out.append(data[at : places[span["first"]][0]])
            at = places[span["end"] - 1][1]
        out.append(data[at:])
        return b"".join(out).decode("utf-8")

    def run(batches):
        for batch in batches:
            batch["text"] = [clean(t, s) for t, s in zip(batch["text"], batch["spans"])]
            yield batch[columns]

    return run


def remove_spans(found: DataFrame) -> DataFrame:
    """The texts of ``find_overlap`` without the words that are hit and what stands between them."""
    kept = found.select("doc_id", "text", "spans")
    kind = kept.schema["doc_id"].dataType.simpleString()
    return kept.mapInPandas(_without(["doc_id", "text"]), f"doc_id {kind}, text string")
