"""Phrase collocations by Rabin-Karp fingerprints with occurrence pointers.

1. Texts are normalised (A-Z lower-cased, one space between words, one line per piece) and written as
   slices of bounded size. Everything later refers to a slice and a word in it.
2. Prefix polynomials over a slice's bytes give a fingerprint of every n-gram at once. A slice sends each
   distinct n-gram once: fingerprint, count, and a pointer to its first occurrence.
3. A range of fingerprints adds the counts. Pointers of n-grams that are frequent go back to their slices.
4. A slice turns pointers into text. Counts are added once more by text, so two phrases that share a
   fingerprint are told apart; only frequent phrases ever become text.

One and two words go first; three and four words follow only where every pair of neighbouring words in
them is frequent, which no frequent phrase can miss.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowcairn.llm.shared import lean, materialise, worker_state

ORDERS = 4
MIN_COUNT = 30
COVERED = 80  # percent of a phrase's occurrences that lie inside one longer candidate
TOP = 2000
SLICE_BYTES = 4_000_000
SALTS = 8
STRETCH = 1 << 16  # bytes whose polynomial is summed at a time
SPARE_BITS = 10  # bits of a sent fingerprint beyond those that number all n-grams
NO_LANG = "und"

_LOWER_AND_SPLIT = bytes.maketrans(
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\t\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz\n\n\n\n\n\n \n\n\n"
)
_SPACES, _BREAKS = re.compile(rb"  +"), re.compile(rb" ?\n[ \n]*")
# Marks a line that goes on: as many of its first words as there are marks were counted in the part before.
_GOES_ON = b"\x0b"

_SEED = np.random.default_rng(20260311)
BYTE_CODES = _SEED.integers(1, 1 << 63, 256, dtype=np.uint64)
BASE = 0xD1342543DE82EF95
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def _powers() -> tuple[np.ndarray, np.ndarray]:
    """The first ``STRETCH`` powers of the base and of its inverse modulo 2**64, kept by the worker."""
    state = worker_state("collocations")
    if not state:
        for name, base in (("up", BASE), ("down", BASE_INVERSE)):
            steps = np.full(STRETCH, base, dtype=np.uint64)
            steps[0] = 1
            state[name] = np.multiply.accumulate(steps)
    return state["up"], state["down"]


def _prefix_sums(chars: np.ndarray) -> np.ndarray:
    """Prefix polynomials of the bytes, a stretch at a time, so that only the sums are as long as the slice."""
    up, _ = _powers()
    sums = np.zeros(len(chars) + 1, dtype=np.uint64)
    for a in range(0, len(chars), STRETCH):
        part = BYTE_CODES[chars[a : a + STRETCH]]
        part *= up[: len(part)]
        part *= np.uint64(pow(BASE, a, 1 << 64))
        part[:1] += sums[a : a + 1]
        np.cumsum(part, out=sums[a + 1 : a + 1 + len(part)])
    return sums


def _stirred(codes: np.ndarray) -> np.ndarray:
    codes = (codes ^ (codes >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    codes = (codes ^ (codes >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return codes ^ (codes >> np.uint64(33))


def normalised(text: str | None) -> bytes:
    """Pieces as lines, words parted by one space, A-Z lower-cased; no empty lines."""
    data = (text or "").encode("utf-8").translate(_LOWER_AND_SPLIT)
    return _BREAKS.sub(b"\n", _SPACES.sub(b" ", data)).strip(b" \n")


def _cut_lines(data: bytes, most: int):
    """(part, repeated words): parts of about ``most`` bytes that end at a line or, in a longer line, at a word.

    A part that starts inside a line repeats the last words before it, each announced by one mark.
    """
    start, line_start, context, repeated = 0, 0, b"", 0
    while start < len(data):
        end = len(data)
        if end - start > most:
            line = data.rfind(b"\n", start, start + most)
            ends = [x for x in (data.find(b" ", start + most), data.find(b"\n", start + most), end) if x > 0]
            end = line if line > start else min(ends)
        part = data[start:end]
        yield (_GOES_ON * repeated + context + b" " + part, repeated) if repeated else (part, 0)
        line_start = max(line_start, data.rfind(b"\n", start, end) + 1)
        context, repeated = b"", 0
        if data[end : end + 1] == b" ":
            at = end
            while repeated < ORDERS - 1 and at > line_start:
                before = data.rfind(b" ", line_start, at)
                repeated, at = repeated + 1, max(before, line_start)
                context = data[before + 1 if before >= line_start else line_start : end]
                if before < line_start:
                    break
        start = end + 1


def _slices(most: int):
    """Rows of one slice each: normalised texts, sorted by language, with a language for each part."""

    def packed(number: int, parts: list[tuple[str, bytes, int]]) -> pd.DataFrame:
        parts.sort(key=lambda x: x[0])
        langs, starts, words, at, held = [], [], [], 0, []
        for lang, data, repeated in parts:
            if not langs or langs[-1] != lang:
                langs.append(lang)
                starts.append(at)
                words.append(0)
            words[-1] += data.count(b" ") + data.count(b"\n") + 1 - repeated
            held.append(data)
            at += len(data) + 1
        text = b"\n".join(held)
        return pd.DataFrame({
            "slice": [TaskContext.get().partitionId() << 32 | number], "size": [len(text)], "langs": [langs],
            "starts": [starts], "words": [words], "text": [pa.compress(text, codec="zstd", asbytes=True)],
        })

    def run(batches):
        number, size, parts = 0, 0, []
        for batch in batches:
            for text, lang in zip(batch["text"], batch["lang"]):
                for data, repeated in _cut_lines(normalised(text), most):
                    if parts and size + len(data) > most:
                        yield packed(number, parts)
                        number, size, parts = number + 1, 0, []
                    parts.append((lang, data, repeated))
                    size += len(data) + 1
        if parts:
            yield packed(number, parts)

    return run


class SliceWords:
    """Words of a slice and fingerprints of its n-grams."""

    def __init__(self, size: int, langs, starts, text: bytes):
        self.text = pa.decompress(text, decompressed_size=int(size), codec="zstd", asbytes=True)
        self.langs = list(langs)
        chars = np.frombuffer(self.text, dtype=np.uint8)
        gap = (chars == 32) | (chars == 10) | (chars == _GOES_ON[0])
        edges = np.flatnonzero(np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8)))
        self.starts, self.ends = edges[::2], edges[1::2]
        self.line = np.searchsorted(np.flatnonzero(chars == 10), self.starts)
        self.lang = np.searchsorted(np.asarray(starts), self.starts, side="right") - 1
        # Words that a line repeats from the part before end no n-gram of their own.
        first, repeated = np.unique(np.searchsorted(self.starts, np.flatnonzero(chars == _GOES_ON[0])), return_counts=True)
        self.fresh = np.ones(len(self.starts), dtype=bool)
        for a, n in zip(first.tolist(), repeated.tolist()):
            self.fresh[a : a + n] = False
        self.sums = _prefix_sums(chars)
        self.far = np.array([pow(BASE_INVERSE, a, 1 << 64) for a in range(0, len(chars) + 1, STRETCH)], dtype=np.uint64)
        seeds = [int.from_bytes(hashlib.blake2b(x.encode("utf-8"), digest_size=8).digest(), "little") for x in self.langs]
        self.seeds = np.array(seeds, dtype=np.uint64)
        self._ids = None

    def grams(self, n: int) -> np.ndarray:
        """First words of all n-grams that lie in one line and end with a word counted here."""
        last = len(self.starts) - n + 1
        if last <= 0:
            return np.zeros(0, dtype=np.int64)
        return np.flatnonzero((self.line[:last] == self.line[n - 1 :]) & self.fresh[n - 1 :])

    def prints(self, first: np.ndarray, n: int) -> np.ndarray:
        """Fingerprints of the n-grams that start at the words ``first``, apart for each language."""
        return _stirred(self._polynomials(self.starts[first], self.ends[first + n - 1]) ^ self.seeds[self.lang[first]])

    def _polynomials(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Polynomials of the bytes from ``start`` to ``end``, the same wherever they stand."""
        _, down = _powers()
        codes = self.sums[end] - self.sums[start]
        codes *= down[start % STRETCH]
        codes *= self.far[start // STRETCH]
        codes += (end - start).astype(np.uint64)
        return codes

    def word_ids(self) -> np.ndarray:
        """A number for each distinct word, by its bytes."""
        if self._ids is None:
            every = np.arange(len(self.starts))
            start, size = self.starts, self.ends - self.starts
            _, first, ids = np.unique(self._polynomials(start, self.ends), return_index=True, return_inverse=True)
            model = first[ids]
            differs = size != size[model]
            chars = np.frombuffer(self.text, dtype=np.uint8)
            for a in range(0, len(every), 1 << 17):
                some = every[a : a + (1 << 17)]
                some = some[~differs[some]]
                total = size[some].sum()
                at = np.arange(total) - np.repeat(np.cumsum(size[some]) - size[some], size[some])
                same = chars[np.repeat(start[some], size[some]) + at] == chars[np.repeat(start[model[some]], size[some]) + at]
                if not same.all():
                    differs[np.repeat(some, size[some])[~same]] = True
            named: dict[bytes, int] = {}
            for i in np.flatnonzero(differs):
                word = self.text[self.starts[i] : self.ends[i]]
                ids[i] = named.setdefault(word, len(first) + len(named))
            self._ids = ids
        return self._ids

    def distinct(self, n: int, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(fingerprints, first words, counts) of the distinct n-grams, compared word by word."""
        first = self.grams(n) if keep is None else keep
        if not len(first):
            return np.zeros(0, dtype=np.uint64), first, first
        codes = self.prints(first, n)
        order = np.argsort(codes, kind="stable")
        first, codes, ids = first[order], codes[order], self.word_ids()
        new = np.concatenate([[True], codes[1:] != codes[:-1]])
        model = first[np.flatnonzero(new)[np.cumsum(new) - 1]]
        clash = self.lang[first] != self.lang[model]
        for k in range(n):
            clash |= ids[first + k] != ids[model + k]
        runs, counts = np.flatnonzero(new), np.bincount(np.cumsum(new) - 1, weights=~clash).astype(np.int64)
        found = codes[runs], first[runs], counts
        if not clash.any():
            return found
        others: dict[tuple, list] = {}
        for i in np.flatnonzero(clash):
            key = (int(codes[i]), int(self.lang[first[i]]), *ids[first[i] : first[i] + n].tolist())
            others.setdefault(key, [first[i], 0])[1] += 1
        more = [np.array(x) for x in zip(*[(key[0], at, count) for key, (at, count) in others.items()])]
        return tuple(np.concatenate([x, y.astype(x.dtype)]) for x, y in zip(found, more))

    def phrase(self, first: int, n: int) -> str:
        return self.text[self.starts[first] : self.ends[first + n - 1]].decode("utf-8")


SENT = "range long, slice long, steps binary, pointers binary, counts binary"
POINTED = "slice long, pointers binary, counts binary"


def _narrow(values: np.ndarray, small: str, large: str) -> bytes:
    wide = len(values) and int(values.max()) > np.iinfo(small).max
    return (b"L" + values.astype(large).tobytes()) if wide else (b"S" + values.astype(small).tobytes())


def _wide(data: bytes, small: str, large: str) -> np.ndarray:
    return np.frombuffer(data, dtype=large if data[:1] == b"L" else small, offset=1)


def _ranged(slice_id: int, found: list[tuple[int, tuple]], range_bits: int, key_bits: int) -> pd.DataFrame:
    """Distinct n-grams of a slice, dealt by the high bits of their fingerprints.

    A pointer is the first word times ``ORDERS`` plus the number of further words. Only ``key_bits`` of a
    fingerprint travel; n-grams that agree in them are told apart by their text at the end.
    """
    codes = np.concatenate([x[0] for _, x in found]) >> np.uint64(64 - key_bits)
    pointers = np.concatenate([x[1] * ORDERS + (n - 1) for n, x in found])
    counts = np.concatenate([x[2] for _, x in found])
    order = np.argsort(codes, kind="stable")
    codes, pointers, counts = codes[order], pointers[order], counts[order]
    part = codes >> np.uint64(key_bits - range_bits) if range_bits else np.zeros(len(codes), dtype=np.uint64)
    cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])) if len(codes) else np.zeros(1, dtype=int)
    rows = []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        steps = np.diff(codes[a:b] - (part[a] << np.uint64(key_bits - range_bits)), prepend=np.uint64(0))
        rows.append((
            int(part[a]), slice_id, _narrow(steps, "<u4", "<u8"), pointers[a:b].astype("<u4").tobytes(), _narrow(counts[a:b], "u1", "<u4"),
        ))
    return pd.DataFrame(rows, columns=["range", "slice", "steps", "pointers", "counts"])


def _read(row) -> SliceWords:
    return SliceWords(row.size_, row.langs, row.starts, row.text)


def _short_grams(range_bits: int, key_bits: int):
    def run(batches):
        for batch in batches:
            for row in batch.rename(columns={"size": "size_"}).itertuples(index=False):
                words = _read(row)
                found = [(n, words.distinct(n)) for n in (1, 2)]
                del words  # the next slice is not opened beside it
                yield _ranged(row.slice, found, range_bits, key_bits)

    return run


def _long_grams(range_bits: int, key_bits: int):
    """Three and four words whose neighbouring pairs are all frequent."""

    def run(key, slices: pd.DataFrame, pointed: pd.DataFrame) -> pd.DataFrame:
        found = []
        for row in slices.rename(columns={"size": "size_"}).itertuples(index=False):
            words = _read(row)
            pointers = np.concatenate([np.zeros(0, dtype="<u4"), *[np.frombuffer(x, dtype="<u4") for x in pointed["pointers"]]])
            pairs = (pointers[pointers % ORDERS == 1] // ORDERS).astype(np.int64)
            frequent = np.sort(words.prints(pairs, 2))
            starts = np.zeros(len(words.starts) + 1, dtype=bool)
            # A pair that a line repeats was counted in another slice: it may be frequent.
            every = np.flatnonzero(words.line[:-1] == words.line[1:])
            starts[every[~words.fresh[every + 1]]] = True
            if len(frequent) and len(every):
                codes = words.prints(every, 2)
                starts[every[frequent[np.minimum(np.searchsorted(frequent, codes), len(frequent) - 1)] == codes]] = True
            grams = []
            for n in range(3, ORDERS + 1):
                keep = words.grams(n)
                for k in range(n - 1):
                    keep = keep[starts[keep + k]]
                grams.append((n, words.distinct(n, keep)))
            found.append(_ranged(row.slice, grams, range_bits, key_bits))
        return pd.concat(found) if found else pd.DataFrame([], columns=["range", "slice", "steps", "pointers", "counts"])

    return run


def _add_counts(min_count: int):
    """Pointers and counts of the n-grams in a range whose fingerprint is frequent, by slice."""

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        codes = [np.cumsum(_wide(x, "<u4", "<u8").astype(np.uint64)) for x in rows["steps"]]
        counts = [_wide(x, "u1", "<u4") for x in rows["counts"]]
        every, at = np.unique(np.concatenate(codes), return_inverse=True)
        total = np.bincount(at, weights=np.concatenate(counts))
        frequent, out, start = total[at] >= min_count, [], 0
        for name, pointers, own in zip(rows["slice"], rows["pointers"], counts):
            keep = frequent[start : start + len(own)]
            start += len(own)
            if keep.any():
                out.append((name, np.frombuffer(pointers, dtype="<u4")[keep].tobytes(), own[keep].astype("<u4").tobytes()))
        return pd.DataFrame(out, columns=["slice", "pointers", "counts"])

    return run


def _as_text(key, slices: pd.DataFrame, pointed: pd.DataFrame) -> pd.DataFrame:
    """(lang, n_words, phrase, f) for the pointers of a slice."""
    out = {"lang": [], "n_words": [], "phrase": [], "f": []}
    for row in slices.rename(columns={"size": "size_"}).itertuples(index=False):
        words = _read(row)
        for pointers, counts in zip(pointed["pointers"], pointed["counts"]):
            at = np.frombuffer(pointers, dtype="<u4").astype(np.int64)
            first, n = at // ORDERS, at % ORDERS + 1
            text, starts, ends = words.text, words.starts[first].tolist(), words.ends[first + n - 1].tolist()
            out["phrase"] += [text[a:b].decode("utf-8") for a, b in zip(starts, ends)]
            out["lang"] += [words.langs[i] for i in words.lang[first].tolist()]
            out["n_words"] += n.tolist()
            out["f"] += np.frombuffer(counts, dtype="<u4").tolist()
    return pd.DataFrame(out, dtype=None if out["f"] else object)  # empty columns of numbers are no strings


def frequent_phrases(docs: DataFrame, min_count: int = MIN_COUNT, slice_bytes: int = SLICE_BYTES) -> tuple[DataFrame, DataFrame]:
    """(lang, n_words, phrase, f) of all phrases of one to four words with f >= min_count; (lang, n) word totals.

    Counts are exact: fingerprints only choose what becomes text, and counts are added by text.
    """
    rows = docs.select(F.col("text").cast("string").alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANG)).alias("lang"))
    schema = "slice long, size long, langs array<string>, starts array<long>, words array<long>, text binary"
    slices = materialise(rows.mapInPandas(lean("collocations", _slices(slice_bytes)), schema), "slices")
    parts = slices.select(F.explode(F.arrays_zip("langs", "words")).alias("x"))
    totals = parts.groupBy(F.col("x.langs").alias("lang")).agg(F.sum("x.words").alias("n"))
    size = slices.agg(F.sum("size").alias("size")).first()["size"] or 0
    range_bits = max(0, (size // slice_bytes).bit_length())
    key_bits = min(64, max(32, size.bit_length() + SPARE_BITS))
    text = slices.select("slice", "size", "langs", "starts", "text")

    def pointed(sent: DataFrame) -> DataFrame:
        return materialise(sent.groupBy("range").applyInPandas(_add_counts(min_count), POINTED), "pointed")

    short = pointed(text.mapInPandas(lean("collocations", _short_grams(range_bits, key_bits)), SENT))
    by_slice = text.groupBy("slice")
    long = pointed(by_slice.cogroup(short.groupBy("slice")).applyInPandas(_long_grams(range_bits, key_bits), SENT))
    found = by_slice.cogroup(short.union(long).groupBy("slice")).applyInPandas(_as_text, "lang string, n_words int, phrase string, f long")
    counted = found.groupBy("lang", "phrase").agg(F.first("n_words").alias("n_words"), F.sum("f").alias("f"))
    return materialise(counted.where(F.col("f") >= min_count).select("lang", "n_words", "phrase", "f"), "frequent"), totals


def _words(first, n):
    """``n`` words of the phrase from word number ``first`` (from 1)."""
    return F.array_join(F.slice("words", first, n), " ")


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, covered: int = COVERED, top: int = TOP, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """The ``top`` collocations of each language: lang, rank, phrase, a, l, r, n, score.

    A phrase is two to four words in a row within a piece; pieces end at ``. , ; : ! ?`` and line breaks.
    The score is the lowest of floor(2000000 * a / (l + r)) over the phrase's cuts. A phrase that lies
    inside a longer candidate with at least ``covered`` percent of its occurrences is dropped.

    A null text is empty and has no phrases; a null language counts as ``und``; repeated rows count each
    time; an empty table gives no rows; other columns, whatever their names, are ignored. Texts of any
    length are cut into slices without losing a phrase.
    """
    frequent, totals = frequent_phrases(docs, min_count, slice_bytes)
    candidates = frequent.where("n_words > 1").select("lang", "phrase", "n_words", F.col("f").alias("a"), F.split("phrase", " ").alias("words"))
    cuts = candidates.select("*", F.explode(F.sequence(F.lit(1), F.col("n_words") - 1)).alias("k"))
    # A first or last word is shared by very many candidates, so both sides of the look-up are salted.
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int")
    parts = frequent.where(F.col("n_words") < ORDERS).select(
        "lang", F.col("phrase").alias("part"), F.col("f").alias("part_f"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    )
    n = F.col("n_words")
    sides = cuts.select("lang", "phrase", "n_words", "a", "k", salt.alias("salt"), F.explode(F.array(
        F.struct(F.lit(0).alias("side"), _words(F.lit(1), F.col("k")).alias("part")),
        F.struct(F.lit(1).alias("side"), _words(F.col("k") + 1, n - F.col("k")).alias("part")),
    )).alias("x")).select("lang", "phrase", "n_words", "a", "k", "salt", "x.side", "x.part")
    found = sides.join(parts, ["lang", "part", "salt"]).groupBy("lang", "phrase", "n_words", "a", "k").agg(
        F.sum(F.when(F.col("side") == 0, F.col("part_f"))).alias("l"), F.sum(F.when(F.col("side") == 1, F.col("part_f"))).alias("r")
    )
    score = F.expr("CAST(2000000BD * CAST(a AS DECIMAL(20, 0)) DIV (CAST(l AS DECIMAL(20, 0)) + CAST(r AS DECIMAL(20, 0))) AS BIGINT)")
    scored = found.groupBy("lang", "phrase", "n_words", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    inner = candidates.where("n_words > 2").select("lang", "n_words", F.col("a").alias("outer_a"), "words", F.explode(F.sequence(F.lit(2), n - 1)).alias("m"))
    inner = inner.select("lang", "outer_a", "words", "m", F.explode(F.sequence(F.lit(1), n - F.col("m") + 1)).alias("at"))
    most = inner.select("lang", _words(F.col("at"), F.col("m")).alias("phrase"), "outer_a").groupBy("lang", "phrase").agg(F.max("outer_a").alias("outer_a"))
    wide = lambda c: F.col(c).cast("decimal(20, 0)")
    inside = F.coalesce(wide("outer_a") * 100 >= wide("a") * covered, F.lit(False))
    kept = scored.join(most, ["lang", "phrase"], "left").where(~inside)
    ranked = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # Best of each part of a language first, so that no task sorts a whole language.
    part = F.pmod(F.xxhash64("phrase"), F.lit(64))
    best = ranked.withColumn("part", part).withColumn("place", F.row_number().over(W.partitionBy("lang", "part").orderBy(*order))).where(F.col("place") <= top)
    best = best.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
