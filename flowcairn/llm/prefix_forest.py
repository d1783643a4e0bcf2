"""Hash-prefix forest for approximate nearest neighbours by inner product.

Every tree gives a vector a long string of bits, the sides of random hyperplanes, and is the array of
all strings in sorted order. The rows that share a prefix with a query are a contiguous range of that
array, so a descent to the longest prefix and an ascent from it only move the ends of a range.

The first bits of the strings, ``DEPTH`` of them, are counted per tree; these counts give the number of
candidates of a query at every prefix length. All trees ascend together, one bit at a time, until they
hold enough entries. The arrays are stored in blocks of bounded length, cut between prefixes; the rows
of a prefix that is longer than a block are dealt to several. A query visits the blocks of its range.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowcairn.llm.shared import materialise

TREES = 10
LENGTH = 48  # bits of a hash string
DEPTH = 14  # bits that are counted
BLOCK = 8_192  # entries of a block
QUERIES = 16_384  # queries that meet a block in one task
SHARE = 1.0  # entries that the trees hold together before the ascent stops, as a share of all rows
LEAST = 2_000  # and at least so many


def clean_vectors(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): vectors of the collection's dimension that are not zero and hold only finite numbers."""
    v = F.col(vector_col).cast("array<double>")
    good = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return rows.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(
        F.coalesce(good, F.lit(False))
    )


@dataclass
class Forest:
    """Hyperplanes, the largest norm, and per tree: rows before each prefix, and its first block.

    All of it is bounded by ``TREES`` and ``DEPTH``, whatever the number of rows.
    """

    planes: np.ndarray
    norm: float
    rows: int
    before: np.ndarray
    first_block: np.ndarray
    pieces: np.ndarray

    def strings(self, vectors: np.ndarray, stored: bool) -> np.ndarray:
        """Hash strings, a row per tree. Stored vectors get the coordinate that makes their norms equal."""
        if stored:
            square = np.einsum("ij,ij->i", vectors, vectors)
            extra = np.sqrt(np.maximum(self.norm**2 - square, 0.0))
        else:
            extra = np.zeros(len(vectors))
        sides = np.column_stack([vectors, extra]) @ self.planes > 0
        weights = np.uint64(1) << np.arange(LENGTH - 1, -1, -1, dtype=np.uint64)
        return np.stack([sides[:, t * LENGTH : (t + 1) * LENGTH] @ weights for t in range(TREES)]).astype(np.uint64)

    def blocks(self, strings: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The block of every entry; a long prefix, of equal vectors perhaps, is dealt to several by id."""
        prefix = (strings >> np.uint64(LENGTH - DEPTH)).astype(np.int64)
        dealt = ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64)
        tree = np.arange(TREES)[:, None]
        return self.first_block[tree, prefix] + dealt % self.pieces[tree, prefix]

    def ascend(self, strings: np.ndarray, enough: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Prefix length per query, and per tree the first and last prefix of its range."""
        prefix = (strings >> np.uint64(LENGTH - DEPTH)).astype(np.int64)
        tree = np.arange(TREES)[:, None]
        level = np.zeros(strings.shape[1], dtype=np.int64)
        for bits in range(DEPTH + 1):  # the longest prefix with enough entries; level 0 holds everything
            free = DEPTH - bits
            low = (prefix >> free) << free
            held = (self.before[tree, low + (1 << free)] - self.before[tree, low]).sum(axis=0)
            level[held >= enough] = bits
        free = (DEPTH - level)[None, :]
        low = (prefix >> free) << free
        return level, low, low + (1 << free) - 1


def fit(vectors: DataFrame, seed: int = 11) -> Forest | None:
    """Count the prefixes of all vectors; None for an empty collection."""
    about = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("s")).first()
    if not about["n"]:
        return None
    rng = np.random.default_rng(seed)
    d = about["d"] + 1
    planes = np.empty((d, TREES * LENGTH))
    at = 0
    while at < planes.shape[1]:  # hyperplanes of one draw are at right angles
        size = min(d, planes.shape[1] - at)
        planes[:, at : at + size] = np.linalg.qr(rng.standard_normal((d, d)))[0][:, :size]
        at += size
    size = 1 << DEPTH
    forest = Forest(planes, float(np.sqrt(about["s"])), about["n"], *(np.zeros((TREES, size), dtype=np.int64) for _ in range(3)))
    counts = np.zeros((TREES, size), dtype=np.int64)
    found = vectors.mapInPandas(_count_prefixes(forest, d - 1), "tree int, prefix int, rows long").groupBy("tree", "prefix").agg(F.sum("rows").alias("rows"))
    table = found.toPandas()  # at most TREES * 2**DEPTH rows
    counts[table["tree"], table["prefix"]] = table["rows"]
    forest.rows = int(counts[0].sum())
    forest.before = np.concatenate([np.zeros((TREES, 1), dtype=np.int64), counts.cumsum(axis=1)], axis=1)
    forest.pieces = np.maximum(-(-counts // BLOCK), 1)
    block = -1
    for t in range(TREES):  # consecutive prefixes share a block until it is full
        held = BLOCK
        for p in range(size):
            if held + counts[t, p] > BLOCK:
                block += 1
                held = 0
            forest.first_block[t, p] = block
            held += counts[t, p]
            if forest.pieces[t, p] > 1:
                block += int(forest.pieces[t, p]) - 1
                held = BLOCK
    return forest


def _matrix(column, d: int) -> tuple[np.ndarray, np.ndarray]:
    keep = np.array([len(v) == d for v in column], dtype=bool)
    rows = [v for v, k in zip(column, keep) if k]
    return keep, np.array(rows, dtype=np.float64).reshape(len(rows), d)


def _count_prefixes(forest: Forest, d: int):
    def run(batches):
        counts = np.zeros((TREES, 1 << DEPTH), dtype=np.int64)
        for batch in batches:
            _, matrix = _matrix(batch["v"], d)
            prefix = (forest.strings(matrix, True) >> np.uint64(LENGTH - DEPTH)).astype(np.int64)
            for t in range(TREES):
                counts[t] += np.bincount(prefix[t], minlength=1 << DEPTH)
        tree, prefix = np.nonzero(counts)
        for at in range(0, len(tree), 50_000):
            s = slice(at, at + 50_000)
            yield pd.DataFrame({"tree": tree[s].astype(np.int32), "prefix": prefix[s].astype(np.int32), "rows": counts[tree[s], prefix[s]]})

    return run


def _place_rows(forest: Forest, d: int, salts: int):
    def run(batches):
        for batch in batches:
            keep, matrix = _matrix(batch["v"], d)
            ids = batch["id"].to_numpy()[keep]
            blocks = forest.blocks(forest.strings(matrix, True), ids)
            data = [row.tobytes() for row in matrix]
            for t in range(TREES):
                for salt in range(salts):
                    yield pd.DataFrame({"block": blocks[t], "salt": np.int32(salt), "id": ids, "v": data})

    return run


def _place_queries(forest: Forest, d: int, salts: int, enough: float):
    def run(batches):
        for batch in batches:
            keep, matrix = _matrix(batch["v"], d)
            ids = batch["id"].to_numpy()[keep]
            strings = forest.strings(matrix, False)
            _, low, high = forest.ascend(strings, enough)
            data = [row.tobytes() for row in matrix]
            for t in range(TREES):
                first = forest.first_block[t, low[t]]
                last = forest.first_block[t, high[t]] + forest.pieces[t, high[t]] - 1
                times = last - first + 1
                at = np.repeat(np.arange(len(ids)), times)
                step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                yield pd.DataFrame({
                    "block": first[at] + step, "salt": (ids[at] // 7 % salts).astype(np.int32), "id": ids[at],
                    "low": (low[t][at] << (LENGTH - DEPTH)), "high": ((high[t][at] + 1) << (LENGTH - DEPTH)) - 1,
                    "tree": np.int32(t), "v": [data[i] for i in at],
                })

    return run


def _search_block(forest: Forest, k: int):
    """The k best rows of each query among the entries of a block that lie in its range."""

    def run(key, rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
        if not len(rows) or not len(queries):
            return empty
        stored = np.stack([np.frombuffer(v) for v in rows["v"]])
        ids = rows["id"].to_numpy()
        single = len(np.unique(ids)) == len(ids)
        tree = int(queries["tree"].iloc[0])
        strings = forest.strings(stored, True)[tree].astype(np.int64)
        order = np.lexsort((ids, strings))
        stored, ids, strings = stored[order], ids[order], strings[order]
        out = []
        for at in range(0, len(queries), 256):
            some = queries.iloc[at : at + 256]
            low = np.searchsorted(strings, some["low"].to_numpy(), side="left")
            high = np.searchsorted(strings, some["high"].to_numpy(), side="right")
            first, last = int(low.min()), int(high.max())
            asked = np.stack([np.frombuffer(v) for v in some["v"]])
            scores = asked @ stored[first:last].T
            for i, query in enumerate(some["id"].to_numpy()):
                at = np.arange(low[i], high[i])
                at = at[ids[at] != query]
                if single and len(at) > k:  # the block product rounds a row by its place: near ties stay for the exact score
                    rough = scores[i, at - first]
                    edge = np.partition(rough, len(rough) - k)[len(rough) - k]
                    at = at[rough >= edge - 1e-9 * max(abs(edge), 1e-300)]
                own, names = (stored[at] * asked[i]).sum(axis=1), ids[at]
                best = np.lexsort((names, -own))
                if not single:  # rows that share an id count once, with the best of them
                    best = best[np.sort(np.unique(names[best], return_index=True)[1])]
                best = best[:k]
                out.append(pd.DataFrame({"query_id": query, "vec_id": names[best], "score": own[best]}))
        return pd.concat(out) if out else empty

    return run


def search(
    rows: DataFrame,
    queries: DataFrame,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    share: float = SHARE,
    least: int = LEAST,
    seed: int = 11,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows with the largest inner product that were found.

    ``share`` sets the work: the ascent stops when the trees hold that share of all rows, counted once
    for each tree, and at least ``least`` entries. Vectors without clusters need about one; on clustered
    ones a hundredth will do. Scores are exact, in double precision; ties go to the smaller id.

    Vectors that are null, zero, of another length than the longest, or hold null or non-finite numbers
    take no part, as do rows without an id. Rows that share an id with the query are not its neighbours;
    other rows that share an id are one neighbour. An empty table gives no rows; other columns are ignored.
    """
    stored = clean_vectors(rows, id_col, vector_col)
    asking = clean_vectors(queries, id_col, vector_col)
    forest = fit(stored, seed)
    spark = rows.sparkSession
    if forest is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    d = forest.planes.shape[0] - 1
    salts = -(-asking.count() // QUERIES) or 1
    enough = min(max(share * forest.rows, least), TREES * forest.rows)
    placed = stored.mapInPandas(_place_rows(forest, d, salts), "block long, salt int, id long, v binary")
    sent = asking.mapInPandas(_place_queries(forest, d, salts, enough), "block long, salt int, id long, low long, high long, tree int, v binary")
    found = placed.groupBy("block", "salt").cogroup(sent.groupBy("block", "salt")).applyInPandas(
        _search_block(forest, k), "query_id long, vec_id long, score double"
    )
    found = materialise(found, "found")
    # A row is met in several trees; its score is the same there but for the order of a sum.
    met = found.repartition("query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
