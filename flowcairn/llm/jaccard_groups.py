"""Exact Jaccard self-join of word shingles through a token-group matrix.

1. Shingles become 64-bit codes, counted over all documents. The common ones go to the end of the global
   order of codes, the most frequent last.
2. Each document keeps its head: enough codes, in that order, that two documents which link share one.
   Of documents with equal sets only the one with the smallest id goes on.
3. Documents that agree in a pair of min-hashes meet the smallest documents of that band; those that
   link to one, checked on whole sets, form the first groups of similar documents.
   Documents near a large group ask its smallest members too, so that few parts of it are left.
   Documents that link with nothing so far, but share a frequent code of their heads, form groups of
   similar documents, cut into chunks.
4. The token-group matrix has a row for every code in the union of a group's heads. Joining it with the
   heads counts how much of a document's head lies in each other group; the count bounds the overlap.
   A qualifying chunk of similar documents is opened on heads alone: they bound it member by member.
5. Only groups whose bound allows a link are opened: the union of their whole sets bounds the overlap
   once more, then members are compared one by one until one links.
6. Links are contracted to components.

No pair of documents within a group is ever listed, and documents of one group are never compared again.
"""

from __future__ import annotations


import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowcairn.llm.components import connected_components
from flowcairn.llm.shared import lean, materialise, worker_state

WORDS = 5
PERCENT = 80
COMMON = 8  # codes in more documents than this are common
COUNT_BITS = 32  # codes are counted by their high bits; a clash only moves a code in the order
COUNT_DOCS = 512  # documents' worth of codes that one group counts
MOST_COMMON = 1 << 20  # common codes broadcast at most, the most frequent ones; the rest keep their place
CHUNK = 64  # members of a group that are opened together
TOGETHER = 16  # chunks that a task opens one after another
QUERIES = 256  # documents that meet a chunk in one task
SEMI_JOIN_ROWS = 2_000_000  # a list of ids up to this length is broadcast, a longer one is joined by shuffle
COPIED_SETS = 200_000  # digests of sets held twice that are broadcast at most
BANDS = 3
LARGE = 32  # members of a group that documents near it ask before any other
TAIL = 8  # codes of a head by which they find it
SIMILAR = 32  # documents that hold a code by which similar ones are grouped
SIMILAR_SINGLES = 8  # of them that link with nothing
SIMILAR_CHUNK = 256  # documents of such a group that are asked together
LEADERS = 16  # documents of a band that the others are compared with first
SEGMENT = 1 << 20

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_SEED = np.random.default_rng(20240229)
BYTE_CODES = _SEED.integers(1, 1 << 63, 256, dtype=np.uint64)
PLACES = _SEED.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
MINS = _SEED.integers(1, 1 << 63, 2 * BANDS, dtype=np.uint64) | np.uint64(1)
BASE, BASE_INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
MIX = np.uint64(0xD6E8FEB86659FD93)


def _powers(length: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, kept by the worker."""
    state = worker_state("powers")
    if len(state.get("up", ())) < length:
        size = 1 << max(12, (length - 1).bit_length())
        for name, base in (("up", BASE), ("down", BASE_INVERSE)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            state[name] = np.multiply.accumulate(steps)
    return state["up"], state["down"]


def _mixed(codes: np.ndarray) -> np.ndarray:
    codes = (codes ^ (codes >> np.uint64(32))) * MIX
    codes = (codes ^ (codes >> np.uint64(29))) * MIX
    return codes ^ (codes >> np.uint64(32))


def _segments(data: bytes):
    """The text in pieces that end at white space, so no word is cut."""
    start = 0
    while start < len(data):
        end = start + SEGMENT
        while end < len(data) and not SPACE[data[end]]:
            end += 1
        yield data[start:end]
        start = end


def word_codes(text: str | None) -> np.ndarray:
    """A 64-bit code for every word; words are cut at ASCII white space and A to Z lower-cased."""
    found = []
    for piece in _segments((text or "").encode("utf-8").lower()):
        chars = np.frombuffer(piece, dtype=np.uint8)
        inside = np.concatenate([[False], ~SPACE[chars], [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[::2], edges[1::2]
        up, down = _powers(len(chars) + 1)
        sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(BYTE_CODES[chars] * up[: len(chars)])])
        found.append(_mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)))
    return np.concatenate(found) if found else np.zeros(0, dtype=np.uint64)


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct codes of the shingles; with fewer words, one code of all of them."""
    codes = word_codes(text)
    if not len(codes):
        return codes
    n = min(words, len(codes))
    total = np.full(len(codes) - n + 1, n, dtype=np.uint64)
    for k in range(n):
        total += codes[k : len(codes) - n + 1 + k] * PLACES[k]
    return np.unique(_mixed(total))


def least_overlap(a, b, percent: int = PERCENT):
    """Smallest intersection of sets of sizes a and b with 100 * intersection >= percent * union."""
    return -((-percent * (a + b)) // (100 + percent))


def _packed(codes: np.ndarray) -> bytes:
    """Sorted distinct numbers as differences, of 16 bits where all of them fit."""
    steps = np.diff(codes, prepend=np.uint64(0))
    return b"2" + steps.astype("<u2").tobytes() if steps.max() < 1 << 16 else b"8" + steps.astype("<u8").tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, dtype="<u2" if data[:1] == b"2" else "<u8", offset=1).astype(np.uint64))


def _count_codes(words: int, bits: int):
    """Per batch: the codes, cut to their high bits, in ranges of the code space."""
    rest = np.uint64(COUNT_BITS - bits)

    def run(batches):
        for batch in batches:
            codes = np.concatenate([shingle_set(t, words) for t in batch["text"]]) >> np.uint64(64 - COUNT_BITS)
            codes, docs = np.unique(codes, return_counts=True)  # a hot code is one number for each batch
            docs = docs.astype("<u4")
            edges = np.searchsorted(codes, np.arange((1 << bits) + 1, dtype=np.uint64) << rest)
            ranges = np.flatnonzero(edges[1:] > edges[:-1])
            for at in range(0, len(ranges), 1024):
                some = ranges[at : at + 1024]
                data = [_packed(codes[edges[r] : edges[r + 1]] - (np.uint64(r) << rest)) for r in some]
                held = [docs[edges[r] : edges[r + 1]].tobytes() for r in some]
                yield pd.DataFrame({"range": some.astype(np.int32), "data": data, "docs": held})

    return run


def _add_counts(bits: int):
    rest = np.uint64(COUNT_BITS - bits)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        codes, at = np.unique(np.concatenate([_unpacked(d) for d in rows["data"]]), return_inverse=True)
        docs = np.bincount(at, weights=np.concatenate([np.frombuffer(d, dtype="<u4") for d in rows["docs"]]))
        codes, docs = codes[docs > COMMON] + (np.uint64(key[0]) << rest), docs[docs > COMMON]
        return pd.DataFrame({"code": codes.astype(np.int64), "docs": docs.astype(np.int64)})

    return run


def common_codes(docs: DataFrame, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted high bits of the codes that more than ``COMMON`` documents hold, and how many do."""
    ranges = max(1, docs.count() // COUNT_DOCS)
    bits = min(20, max(1, (ranges - 1).bit_length()))
    packed = docs.select("text").mapInPandas(lean("powers", _count_codes(words, bits)), "range int, data binary, docs binary")
    counts = packed.groupBy("range").applyInPandas(_add_counts(bits), "code long, docs long")
    counts = materialise(counts, "counts")
    top = counts if counts.count() <= MOST_COMMON else counts.orderBy(F.desc("docs"), "code").limit(MOST_COMMON)
    top = top.toPandas().sort_values("code")
    return top["code"].to_numpy(dtype=np.uint32), np.minimum(top["docs"].to_numpy(), (1 << 24) - 1).astype(np.uint32)


def _heads(shared, words: int, percent: int):
    def run(batches):
        common, docs = shared.value
        for batch in batches:
            sizes, heads, lasts, mins, same, families = [], [], [], [], [], []
            for text in batch["text"]:
                codes = shingle_set(text, words)
                n = len(codes)
                sizes.append(n)
                same.append(hashlib.blake2b(codes.tobytes(), digest_size=16).digest())
                if n == 0:
                    heads.append([])
                    lasts.append(0)
                    mins.append([])
                    families.append([])
                    continue
                held = np.zeros(n, dtype=np.int64)
                if len(common):
                    short = (codes >> np.uint64(64 - COUNT_BITS)).astype(np.uint32)
                    at = np.minimum(np.searchsorted(common, short), len(common) - 1)
                    held = np.where(common[at] == short, docs[at], 0).astype(np.int64)
                order = np.argsort(held, kind="stable")[: n - -(-percent * n // 100) + 1]
                heads.append(codes[order].view(np.int64).tolist())
                families.append(codes[order[held[order] >= SIMILAR]].view(np.int64).tolist())
                lasts.append((int(held[order[-1]]) << 38) | (int(codes[order[-1]]) >> 26))
                mins.append([int((codes * m).min()) - (1 << 63) for m in MINS])
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n": sizes, "head": heads, "last": lasts, "mins": mins, "same": same, "often": families})

    return run


def document_heads(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n (set size), head (codes), last (place of the last head code), mins, same (set digest), often (head codes that many hold)."""
    shared = docs.sparkSession.sparkContext.broadcast(common_codes(docs, words))  # at most MOST_COMMON pairs
    schema = "doc_id long, n long, head array<long>, last long, mins array<long>, same binary, often array<long>"
    heads = materialise(docs.select("doc_id", "text").mapInPandas(lean("powers", _heads(shared, words, percent)), schema), "heads")
    shared.destroy()
    return heads


def _short_list(ids: DataFrame) -> DataFrame:
    """A list of ids for a semi or anti join: broadcast while it is short, shuffled beyond that."""
    return F.broadcast(ids) if ids.count() <= SEMI_JOIN_ROWS else ids


def star_groups(heads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(query, unit) and (unit, member): documents that agree in a pair of min-hashes, and their leaders.

    The leaders are the ``LEADERS`` smallest documents of a band. Several of them are needed where copies
    of one text each differ a little: two such copies need not link, while each links to many others.
    """
    bands = F.array(*[F.xxhash64(F.lit(b), F.col("mins")[2 * b], F.col("mins")[2 * b + 1]) for b in range(BANDS)])
    keyed = heads.select("doc_id", F.explode(bands).alias("band"))
    place = F.row_number().over(W.partitionBy("band").orderBy("doc_id"))
    lead = keyed.withColumn("place", place).where(F.col("place") <= LEADERS)
    lists = lead.groupBy("band").agg(F.array_sort(F.collect_set("doc_id")).alias("leaders")).where(F.size("leaders") > 1)
    lists = materialise(lists.withColumn("unit", F.xxhash64("leaders")), "leaders")  # bands with the same leaders are one unit
    asks = keyed.join(lists, "band").where(F.col("doc_id") > F.col("leaders")[0]).select(F.col("doc_id").alias("query"), "unit")
    return materialise(asks.distinct(), "star"), lists.select("unit", F.explode("leaders").alias("member")).distinct()


def _token_rows(words: int):
    def run(batches):
        for batch in batches:
            codes = [shingle_set(t, words).tobytes() for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "codes": codes})

    return run


def _whole_sets(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """(doc_id, codes) of the documents listed in ``ids``."""
    chosen = docs.select("doc_id", "text").join(_short_list(ids), "doc_id", "left_semi")
    return materialise(chosen.mapInPandas(lean("powers", _token_rows(words)), "doc_id long, codes binary"), "sets")


def _open_groups(percent: int, below: bool):
    """Compare the documents that ask with the members of each chunk of a group in this bucket."""

    def shared_codes(a: np.ndarray, b: np.ndarray) -> int:
        if len(a) > len(b):
            a, b = b, a
        return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())

    def linked(names: list, sets: list[np.ndarray], asking: list[tuple[int, np.ndarray]]):
        union = np.unique(np.concatenate(sets)) if len(sets) > 1 else sets[0]
        least, most = min(map(len, sets)), max(map(len, sets))
        for query, own in asking:
            n = len(own)
            low, high = max(least, -(-percent * n // 100)), min(most, 100 * n // percent)
            if low > high or shared_codes(own, union) < least_overlap(n, low, percent):
                continue
            for member, other in zip(names, sets):
                if below and member >= query:
                    continue
                if low <= len(other) <= high and shared_codes(own, other) >= least_overlap(n, len(other), percent):
                    yield query, member  # groups are connected, leaders need only a start: one link is enough
                    break

    def run(key, members: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        held: dict[tuple, tuple[list, list, list]] = {}
        for unit, chunk, salt, doc, codes in members.itertuples(index=False):
            names, sets, _ = held.setdefault((unit, chunk, salt), ([], [], []))
            names.append(doc)
            sets.append(np.frombuffer(codes, dtype=np.uint64))
        for unit, chunk, salt, doc, codes in queries.itertuples(index=False):
            if (unit, chunk, salt) in held:
                held[unit, chunk, salt][2].append((doc, np.frombuffer(codes, dtype=np.uint64)))
        out = [pair for parts in held.values() for pair in linked(*parts)]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def open_groups(docs: DataFrame, asks: DataFrame, members: DataFrame, words: int, percent: int, below: bool = False) -> DataFrame:
    """Links (a, b) between documents that ask and groups.

    ``asks`` has (query, unit), ``members`` (unit, member). Groups are cut into chunks of about ``CHUNK``
    members, and the documents that ask a chunk are dealt to tasks by ``QUERIES``. With ``below`` a
    document meets smaller members only.
    """
    wanted = asks.groupBy("unit").agg(F.count(F.lit(1)).alias("asked"))
    sized = members.join(wanted, "unit").groupBy("unit").agg(F.count(F.lit(1)).alias("size"), F.first("asked").alias("asked"))
    sized = materialise(sized.select(
        "unit", F.ceil(F.col("size") / CHUNK).cast("int").alias("chunks"), F.ceil(F.col("asked") / QUERIES).cast("int").alias("salts")
    ), "units")
    listed = members.join(sized, "unit")
    ids = listed.select(F.col("member").alias("doc_id")).union(asks.select("query")).distinct()
    sets = _whole_sets(docs, materialise(ids, "ids"), words)
    placed = listed.select(
        "unit", F.pmod(F.xxhash64("member"), F.col("chunks")).cast("int").alias("chunk"),
        F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("member").alias("doc_id"),
    ).join(sets, "doc_id")
    asking = asks.join(sized, "unit").select(
        "unit", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"),
        F.pmod(F.xxhash64("query"), F.col("salts")).cast("int").alias("salt"), F.col("query").alias("doc_id"),
    ).join(sets.toDF("doc_id", "codes"), "doc_id")
    total = sized.agg(F.sum(F.col("chunks") * F.col("salts")).alias("n")).first()["n"] or 0
    bucket = F.pmod(F.xxhash64("unit", "chunk", "salt"), F.lit(total // TOGETHER + 1))
    columns = ["unit", "chunk", "salt", "doc_id", "codes"]
    links = placed.select(*columns).groupBy(bucket).cogroup(asking.select(*columns).groupBy(bucket)).applyInPandas(_open_groups(percent, below), "a long, b long")
    return materialise(links, "links")


def large_group_asks(heads: DataFrame, groups: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(query, unit) and (unit, member): documents near a large group, and the smallest members of it.

    Copies of one text that differ a little each fall into several bands, so a large group is found in
    parts. A document asks the largest group that holds one of the last, most frequent codes of its head.
    """
    sizes = groups.groupBy("unit").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= LARGE)
    large = heads.join(groups.join(sizes, "unit"), "doc_id")
    kind = F.floor(F.log(F.col("n")) / float(np.log(1.008 * 100 / percent))).cast("int")
    held = large.select("unit", "size", kind.alias("class"), F.explode("head").alias("code"))
    best = held.groupBy("code", "class").agg(F.max_by("unit", F.struct("size", "unit")).alias("unit"))
    tail = F.slice("head", -F.least(F.size("head"), F.lit(TAIL)), F.lit(TAIL))
    probe = heads.join(groups.withColumnRenamed("unit", "own"), "doc_id", "left").select(
        F.col("doc_id").alias("query"), F.coalesce("own", "doc_id").alias("own"), F.explode(tail).alias("code"),
        kind.alias("class"),
    )
    near = best.select("code", "unit", F.explode(F.array(F.col("class") - 1, F.col("class"), F.col("class") + 1)).alias("class"))
    asks = probe.join(near, ["code", "class"]).where("own <> unit").select("query", "unit").distinct()
    place = F.row_number().over(W.partitionBy("unit").orderBy("doc_id"))
    members = large.select("unit", "doc_id", place.alias("place")).where(F.col("place") <= CHUNK)
    return materialise(asks, "near-large"), members.select("unit", F.col("doc_id").alias("member"))


def similar_groups(named: DataFrame) -> DataFrame:
    """(doc_id, chunk): single documents that share a frequent code with enough others, in chunks of bounded size.

    Each goes with the code of its head that most other single documents hold, so that the copies of one
    text, whatever they changed, fall into few groups.
    """
    single = named.where("unit IS NULL").select("doc_id", F.explode("often").alias("family"))
    held = single.groupBy("family").agg(F.count(F.lit(1)).alias("held")).where(F.col("held") >= SIMILAR_SINGLES)
    picked = single.join(held, "family").groupBy("doc_id").agg(F.max(F.struct("held", "family")).alias("best"))
    picked = materialise(picked.select("doc_id", F.col("best.family").alias("family")), "families")
    sizes = materialise(picked.groupBy("family").agg(F.count(F.lit(1)).alias("size")), "family-sizes")
    listed = F.broadcast(sizes) if sizes.count() <= SEMI_JOIN_ROWS else sizes
    part = F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("size") / SIMILAR_CHUNK))
    return materialise(picked.join(listed, "family").select("doc_id", F.xxhash64("family", part).alias("chunk")), "similar")


def _open_heads(percent: int):
    """(query, unit) for the documents of a chunk that two heads cannot rule out."""

    def run(key, members: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        asked = dict(list(queries.groupby(["chunk", "salt"])))
        for name, some in members.groupby(["chunk", "salt"]):
            if name not in asked:
                continue
            owner = np.repeat(np.arange(len(some)), [len(h) for h in some["head"]])
            codes = np.concatenate(some["head"].to_list())
            order = np.argsort(codes, kind="stable")
            codes, owner = codes[order], owner[order]
            ids, n, last, taken = (some[c].to_numpy() for c in ("doc_id", "n", "last", "taken"))
            for query, q_n, q_last, q_taken, head in asked[name][["doc_id", "n", "last", "taken", "head"]].itertuples(index=False):
                a, b = np.searchsorted(codes, head), np.searchsorted(codes, head, "right")
                size = b - a
                at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(a, size)
                met = np.bincount(owner[at], minlength=len(ids))
                bound = np.full(len(ids), 1 << 62)
                bound = np.where(last <= q_last, met + n - taken, bound)
                bound = np.where(q_last <= last, np.minimum(bound, met + q_n - q_taken), bound)
                fits = (bound >= least_overlap(q_n, n, percent)) & (100 * n >= percent * q_n) & (100 * q_n >= percent * n) & (ids != query) & (met > 0)
                out += [(query, x) for x in ids[fits].tolist()]
        return pd.DataFrame(out, columns=["query", "unit"], dtype="int64")

    return run


def open_similar(info: DataFrame, asks: DataFrame, percent: int) -> DataFrame:
    """(query, unit): ``asks`` has (query, chunk), ``info`` doc_id, chunk, n, last, taken and head of every document."""
    sized = materialise(asks.groupBy("chunk").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("salts")), "chunks")
    data = ["n", "last", "taken", "head"]
    members = info.join(sized, "chunk").select("chunk", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "doc_id", *data)
    asking = asks.join(sized, "chunk").select("chunk", F.pmod(F.xxhash64("query"), F.col("salts")).cast("int").alias("salt"), F.col("query").alias("doc_id"))
    asking = asking.join(info.select("doc_id", *data).toDF("doc_id", *data), "doc_id").select("chunk", "salt", "doc_id", *data)
    bucket = F.pmod(F.xxhash64("chunk", "salt"), F.lit(1 << 16))
    return members.groupBy(bucket).cogroup(asking.groupBy(bucket)).applyInPandas(_open_heads(percent), "query long, unit long")


def matrix_asks(heads: DataFrame, groups: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(query, unit) for every other group that the token-group matrix cannot rule out.

    A head is complete up to its last code, so of two heads the one that ends first shows every code that
    the sets share so far; what is beyond it bounds the rest. For a group of several documents the union
    of heads takes the place of a head, and only a query whose head ends first is bounded. A document meets
    the chunk it is in as well: its members need not link with each other.
    """
    named = heads.join(groups, "doc_id", "left")
    named = materialise(named.join(similar_groups(named), "doc_id", "left"), "named")
    kind, own = F.col("chunk").isNotNull(), F.coalesce("chunk", "unit", "doc_id")
    # Sizes of documents that link lie in one class or two neighbouring ones: 1.26 is over 100 / 80.
    ratio = 1.008 * 100 / percent
    rows = named.select(
        F.col("doc_id").alias("query"), F.nullif(own, F.col("doc_id")).alias("group"), kind.alias("similar"),
        F.floor(F.log(F.col("n")) / float(np.log(ratio))).cast("byte").alias("class"), F.explode("head").alias("code"),
    ).repartition("code")
    unit = F.coalesce("group", "query")
    matrix = rows.groupBy("code", "similar", unit.alias("unit")).agg(F.min("class").alias("low"), F.max("class").alias("high"))
    probe = rows.select("query", unit.alias("own"), F.col("similar").alias("own_similar"), "class", "code")
    other = (F.col("own") != F.col("unit")) | F.col("similar") | F.col("own_similar")
    meet = probe.join(matrix, "code").where(other & (F.col("low") <= F.col("class")) & (F.col("high") >= F.col("class") - 1))
    met = materialise(meet.groupBy("query", "similar", "unit").agg(F.count(F.lit(1)).alias("met")), "met")
    info = named.select("doc_id", kind.alias("similar"), own.alias("unit"), "n", "last", F.size("head").cast("long").alias("taken"))
    about = info.groupBy("similar", "unit").agg(
        F.count(F.lit(1)).alias("members"), F.min("n").alias("low"), F.max("n").alias("high"), F.min("last").alias("ends"), F.max("taken").alias("took")
    )
    joined = met.join(about, ["similar", "unit"]).join(info.select(F.col("doc_id").alias("query"), "n", "last", "taken"), "query")
    low = F.greatest("low", F.ceil(F.col("n") * percent / 100))
    need = F.ceil((F.col("n") + low) * percent / (100 + percent))
    bound = F.when(F.col("last") <= F.col("ends"), F.col("met") + F.col("n") - F.col("taken"))
    bound = bound.when(F.col("members") == 1, F.col("met") + F.col("high") - F.col("took")).otherwise(F.lit((1 << 62)))
    possible = (F.col("low") <= F.col("n") * 100 / percent) & (F.col("high") >= F.col("n") * percent / 100) & (bound >= need)
    found = materialise(joined.where(possible).select("query", "similar", "unit").distinct(), "qualifying")
    chunks = found.where("similar").select("query", F.col("unit").alias("chunk"))
    known = named.select("doc_id", "chunk", "n", "last", F.size("head").cast("long").alias("taken"), "head")
    return found.where("NOT similar").select("query", "unit").union(open_similar(known, chunks, percent)).distinct()


def similarity_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links).

    Two documents link when 100 * intersection >= percent * union of their sets of distinct shingles of
    ``words`` words. Sets are compared by 64-bit codes. A null, empty or blank text has no shingles and
    links with nothing. Rows that share a doc_id are one document to links, and keep their own rows. A
    null doc_id links with nothing and has a null component. An empty table gives no rows; other columns
    are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    heads = document_heads(docs, words, percent)
    worded = heads.where("n > 0 AND doc_id IS NOT NULL")
    least = worded.groupBy("same").agg(F.min("doc_id").alias("b"), F.max("doc_id").alias("most")).where("b < most").select("same", "b")
    least = materialise(least, "least")
    least = F.broadcast(least) if least.count() <= COPIED_SETS else least  # a set with many copies is not dealt to one task
    copies = materialise(worded.select("same", F.col("doc_id").alias("a")).join(least, "same").where("a <> b").select("a", "b").distinct(), "copies")
    single = worded.join(_short_list(copies.select(F.col("a").alias("doc_id")).distinct()), "doc_id", "left_anti")
    star, leaders = star_groups(single)
    first = open_groups(docs, star, leaders, words, percent, below=True)
    named = lambda links: materialise(connected_components(links).select(F.col("node").alias("doc_id"), F.col("component").alias("unit")), "groups")
    groups = named(first)
    near, leaders = large_group_asks(single, groups, percent)
    if not near.isEmpty():
        more = open_groups(docs, near, leaders, words, percent)
        groups = named(groups.toDF("a", "b").union(more))
    asks = materialise(matrix_asks(single, groups, percent), "asks")
    owned = single.select("doc_id").distinct().join(groups, "doc_id", "left")
    members = owned.select(F.coalesce("unit", "doc_id").alias("unit"), F.col("doc_id").alias("member")).join(asks.select("unit").distinct(), "unit", "left_semi")
    second = open_groups(docs, asks, members, words, percent)
    whole = connected_components(copies.union(groups.select("doc_id", "unit")).union(second))
    found = whole.select(F.col("node").alias("doc_id"), "component")
    return heads.select("doc_id", F.col("n").alias("n_shingles")).join(found, "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")
    )
