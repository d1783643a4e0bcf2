"""Alignment of two tokenizers over the same bytes, and how often their ids go together.

1. A text falls into units at single spaces between visible characters, and before marks behind a letter.
   Both tokenizers end a token there, so a unit is encoded once while it stays in the worker's cache.
2. Between these shared cuts, a common token end near the middle is found by bisection and both halves are
   done the same way; an interval without a common end is a group. Many units go through this at once.
3. A slice of documents sends each pair of ids it links once, with the number of its documents. Sums over
   all slices and the highest sum of each first id come back to the slices that hold the pair.
"""

from __future__ import annotations

import hashlib
import re
from array import array

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowcairn.llm.shared import lean, materialise, worker_state
from flowcairn.llm.tokens import tokenizer_path

FIRST, SECOND = "byte_bpe_50k.json", "piece_bpe_32k.model"
ID_BITS = 20  # of the second id in the code of a pair
SLICE_CHARS = 3_000_000
CHUNK_CHARS = 1_000_000  # of a text that is cut into units at once
CACHE_BYTES = 150_000_000
LARGE_GROUP = 4096  # links of a group beyond which only its distinct ids are paired
MARKS = ".,;:!?"
LAST_LATIN = "\u024f"
UNIT = re.compile(r"(?<=\S) (?=\S)")


def shared_cuts(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Groups (a from, a to, b from, b to) between neighbouring common ends of two ascending arrays.

    Both end at the same place. An interval is cut at a common end near its middle end of ``a``: the middle
    is looked up in ``b`` by bisection, then its neighbours, further and further out. Both halves are cut
    the same way; an interval without a common end inside is a group. All intervals of a depth go together.
    """
    groups, open_ = [], np.array([[0, len(a), 0, len(b)]], dtype=np.int64) if len(a) else np.zeros((0, 4), np.int64)
    while len(open_):
        leaf = (open_[:, 1] - open_[:, 0] <= 1) | (open_[:, 3] - open_[:, 2] <= 1)
        groups.append(open_[leaf])
        search, halves, step = open_[~leaf], [], 0
        while len(search):
            a0, a1, b0, b1 = search.T
            i = (a0 + a1 - 1) // 2 + (step + 1) // 2 * (1 if step % 2 else -1)
            inside = (a0 <= i) & (i < a1 - 1)
            j = np.searchsorted(b, a[np.where(inside, i, 0)])
            hit = inside & (b0 <= j) & (j < b1 - 1)
            hit[hit] = b[j[hit]] == a[i[hit]]
            halves += [np.stack([a0, i + 1, b0, j + 1], 1)[hit], np.stack([i + 1, a1, j + 1, b1], 1)[hit]]
            step += 1
            done = ~hit & (step > a1 - a0)
            groups.append(search[done])
            search = search[~hit & ~done]
        open_ = np.concatenate(halves) if halves else np.zeros((0, 4), np.int64)
    every = np.concatenate(groups) if groups else np.zeros((0, 4), np.int64)
    return every[np.argsort(every[:, 0])]


def _byte_letters() -> dict[str, int]:
    """The byte behind each letter of a byte-level vocabulary: visible Latin-1 characters stand for
    themselves, the other bytes follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Units:
    """What units add to their documents, encoded once while the cache has room.

    ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``texts`` and ``pairs`` with ``times`` are lists by unit number;
    ``whole`` tells whether both tokenizers give a unit's bytes back. Unit 0 adds nothing.
    """

    def __init__(self, first: str, second: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(first)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=second)
        letters = _byte_letters()
        vocabulary = self.a.get_vocab(with_added_tokens=False)
        self.a_bytes = [b""] * (max(vocabulary.values(), default=-1) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else b""
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(x[3:5], 16)]) if self.b.is_byte(i) else x.replace("▁", " ").encode("utf-8") for i, x in enumerate(pieces)]
        self.a_sizes, self.b_sizes = np.array([len(x) for x in self.a_bytes]), np.array([len(x) for x in self.b_bytes])
        # No piece goes on behind a space mark inside it, so a unit's pieces do not depend on its neighbours.
        self.apart = not any("▁" in x.lstrip("▁") for x in pieces)
        joined = {x[i] for x in pieces for i in range(1, len(x)) if x[i] in MARKS and x[i - 1].isalpha()}
        self.marks = "".join(m for m in MARKS if m not in joined) if self.apart else ""
        self.clear()

    def clear(self) -> None:
        self.words: dict[str, int] = {}
        self.tails: dict[str, int] = {"": 0}
        self.n = [array("q", [0]) for _ in range(4)]
        self.whole, self.texts = array("b", [1]), [""]
        self.pairs, self.times, self.starts = array("q"), array("q"), array("q", [0, 0])
        self.held = 0

    def split(self, text: str):
        """The text's units in parts of bounded size; a single space goes before each."""
        if not self.apart:
            yield [text]
            return
        start = 0
        while start < len(text):
            cut = UNIT.search(text, start + CHUNK_CHARS) if len(text) - start > CHUNK_CHARS else None
            end = cut.start() if cut else len(text)
            yield UNIT.split(text[start:end])
            start = end + 1

    def parts(self, unit: str) -> tuple[str, str]:
        """A unit and the marks behind its last letter, where both tokenizers end a token between them."""
        core = unit.rstrip(self.marks) if self.marks else unit
        return (core, unit[len(core) :]) if core and len(core) < len(unit) and core[-1] <= LAST_LATIN and core[-1].isalpha() else (unit, "")

    def learn(self, words: list[str], tails: list[str]) -> None:
        some, size = [], 0
        for word in words:
            some.append(word)
            size += len(word)
            if size >= 20_000:
                self._learn(some, self.words)
                some, size = [], 0
        if some:
            self._learn(some, self.words)
        for tail in tails:
            self._learn([tail], self.tails, "a")

    def _learn(self, units: list[str], into: dict[str, int], before: str = "") -> None:
        """Encode units joined by spaces in one call each; one by one where bytes are not given back.

        With ``before``, a letter and the one unit follow each other; the letter's own token is left out.
        """
        text = before + " ".join(units)
        data = (" " + text).encode("utf-8")
        a = np.array(self.a.encode(" " + text, add_special_tokens=False).ids, dtype=np.int64)
        b = np.array(self.b.encode(text, num_threads=1), dtype=np.int64)
        same = b"".join([self.a_bytes[i] for i in a.tolist()]) == data and b"".join([self.b_bytes[i] for i in b.tolist()]) == data
        sizes = np.array([len(u.encode("utf-8")) for u in units]) + (0 if before else 1)
        ends = np.cumsum(sizes) + (2 if before else 0)
        if same:
            a_ends, b_ends = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
            if before:  # the first token of each is the letter
                a, b, a_ends, b_ends = a[1:], b[1:], a_ends[1:], b_ends[1:]
            a_to, b_to = np.searchsorted(a_ends, ends), np.searchsorted(b_ends, ends)
            same = bool((a_to < len(a)).all() and (b_to < len(b)).all() and (a_ends[a_to] == ends).all() and (b_ends[b_to] == ends).all())
        if not same:
            if len(units) > 1:
                for unit in units:
                    self._learn([unit], into, before)
                return
            self._add(units, into, np.zeros((0, 4), np.int64), a, b, np.zeros(1, np.int64), False)
            return
        groups = shared_cuts(a_ends, b_ends)
        self._add(units, into, groups, a, b, np.searchsorted(groups[:, 1], a_to + 1) + 1, True)

    def _add(self, units, into, groups, a, b, upto, whole: bool) -> None:
        """Units with their groups; ``upto`` is the number of groups up to the end of each unit."""
        a0, a1, b0, b1 = groups.T
        starts = np.concatenate([[0], upto[:-1]])
        links = (a1 - a0) * (b1 - b0)
        total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[np.concatenate([[0], upto])])
        for held, values in zip(self.n, (total(a1 - a0), total(b1 - b0), upto - starts, total(links))):
            held.extend(values.tolist())
        x, y = list(map(str, a.tolist())), list(map(str, b.tolist()))
        texts = [",".join(x[i:j]) + "|" + ",".join(y[k:m]) for i, j, k, m in groups.tolist()]
        self.texts += [";".join(texts[i:j]) for i, j in zip(starts.tolist(), upto.tolist())]
        small = links <= LARGE_GROUP
        n = links * small
        group = np.repeat(np.arange(len(n)), n)
        place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        width = (b1 - b0)[group]
        pairs = a[a0[group] + place // np.maximum(width, 1)] << ID_BITS | b[b0[group] + place % np.maximum(width, 1)]
        times, owner = np.ones(len(pairs), np.int64), np.searchsorted(upto, group, "right")
        for g in np.flatnonzero(~small).tolist():  # distinct ids only
            (p, n_p), (q, n_q) = (np.unique(v, return_counts=True) for v in (a[a0[g] : a1[g]], b[b0[g] : b1[g]]))
            pairs = np.concatenate([pairs, (p[:, None] << ID_BITS | q).ravel()])
            times = np.concatenate([times, (n_p[:, None] * n_q).ravel()])
            owner = np.concatenate([owner, np.full(len(p) * len(q), np.searchsorted(upto, g, "right"))])
        order = np.argsort(owner, kind="stable")
        self.pairs.frombytes(pairs[order].tobytes())
        self.times.frombytes(times[order].tobytes())
        self.starts.extend((self.starts[-1] + np.cumsum(np.bincount(owner, minlength=len(units)))).tolist())
        self.whole.extend([int(whole)] * len(units))
        first = len(self.whole) - len(units)
        for i, unit in enumerate(units):
            into[unit] = first + i
        self.held += 16 * len(pairs) + sum(map(len, texts)) + 260 * len(units) + sum(map(len, units))


def _units(first: str, second: str) -> Units:
    state = worker_state("aligner")
    if "units" not in state:
        state["units"] = Units(first, second)
    return state["units"]


ROWS = "slice long, number int, doc_id {id}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary, docs binary"
OUT = "doc_id {id}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
NO_TOKENS = (0, 0, 0, 0, "")


class _Slice:
    """Documents of a slice, gathered until it is large enough. A long document is worked off part by part."""

    def __init__(self, units: Units):
        self.units, self.chars, self.rows, self.pairs, self.times = units, 0, [], [], []
        self._next()

    def _next(self) -> None:
        self.surfaces: dict[str, int] = {}
        self.segments: list[tuple[int, array]] = []
        self.waiting = 0

    def add(self, doc_id, text: str | None) -> None:
        row = len(self.rows)
        self.rows.append([doc_id, np.zeros(4, dtype=np.int64), None, True])
        known = self.surfaces
        for some in self.units.split(text or ""):
            self.segments.append((row, array("i", [known.setdefault(u, len(known)) for u in some])))
            self.waiting += sum(map(len, some))
            if self.waiting > SLICE_CHARS:
                self.work_off()
                known = self.surfaces
        self.chars += len(text or "")

    def work_off(self) -> None:
        """Add what waits to the rows of its documents."""
        units = self.units
        if units.held > CACHE_BYTES:
            units.clear()
        parts = [units.parts(u) for u in self.surfaces]
        units.learn([w for w in dict.fromkeys(w for w, _ in parts) if w not in units.words], [t for t in dict.fromkeys(t for _, t in parts) if t not in units.tails])
        word = np.array([units.words[w] for w, _ in parts], dtype=np.int64)
        tail = np.array([units.tails[t] for _, t in parts], dtype=np.int64)
        texts = [units.texts[w] + ";" + units.texts[t] if t else units.texts[w] for w, t in zip(word.tolist(), tail.tolist())]
        numbers = np.stack([np.frombuffer(x, dtype=np.int64) for x in units.n], axis=1) if parts else np.zeros((1, 4), np.int64)
        whole = np.frombuffer(units.whole, dtype=np.int8)
        of_surface, fine = numbers[word] + numbers[tail], (whole[word] & whole[tail]).astype(bool)
        rows, surfaces = [], []
        for row, segment in self.segments:
            held = self.rows[row]
            at = np.frombuffer(segment, dtype=np.int32)
            if not len(at) or not held[3]:
                continue
            if not fine[at].all():
                held[3] = False
                continue
            held[1] += of_surface[at].sum(axis=0)
            start = ";" if held[2] else ""
            held[2] = held[2] or hashlib.sha256()
            held[2].update((start + ";".join([texts[i] for i in segment])).encode("ascii"))
            rows.append(np.full(len(at), row, dtype=np.int64))
            surfaces.append(at)
        if rows:
            key, n = np.unique(np.concatenate(rows) * len(parts) + np.concatenate(surfaces), return_counts=True)
            row, surface = np.divmod(key, len(parts))
            starts, pairs, times = (np.frombuffer(x, dtype=np.int64) for x in (units.starts, units.pairs, units.times))
            for unit in (word[surface], tail[surface]):
                sizes = starts[unit + 1] - starts[unit]
                at = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts[unit], sizes)
                self.pairs.append((np.repeat(row, sizes), pairs[at]))
                self.times.append(times[at] * np.repeat(n, sizes))
            del starts, pairs, times
        del numbers, whole
        self._next()

    def frames(self, slice_id: int):
        """A row for each document, with its pairs as places in the slice's list, and that list as a last row."""
        self.work_off()
        n = len(self.rows)
        row, pairs, times = (np.concatenate([np.zeros(0, np.int64), *x]) for x in ([r for r, _ in self.pairs], [p for _, p in self.pairs], self.times))
        good = np.array([bool(r[3] and r[2]) for r in self.rows], dtype=bool)
        row, pairs, times = (x[good[row]] for x in (row, pairs, times))
        records = [(r[0], *r[1].tolist(), r[2].hexdigest()) if ok else (r[0], *NO_TOKENS) for r, ok in zip(self.rows, good)]
        codes, place = np.unique(pairs, return_inverse=True)
        key = row * max(1, len(codes)) + place
        order = np.argsort(key, kind="stable")
        key, times = key[order], times[order]
        new = np.flatnonzero(np.diff(key, prepend=-1))
        key, times = key[new], np.add.reduceat(times, new) if len(new) else times
        row, place = np.divmod(key, max(1, len(codes)))
        docs = np.bincount(place, minlength=len(codes))
        cuts = np.searchsorted(row, np.arange(n + 1)).tolist()
        place, times = place.astype("<u4"), times.astype("<u4" if not len(times) or times.max() < 1 << 32 else "<u8")
        width = b"4" if times.dtype.itemsize == 4 else b"8"
        for a in range(0, n, 2000):
            some = records[a : a + 2000]
            spans = list(zip(cuts[a : a + 2000], cuts[a + 1 : a + 2001]))
            out = pd.DataFrame(some, columns=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"])
            out.insert(0, "slice", slice_id)
            out.insert(1, "number", range(a, a + len(some)))
            out["pairs"] = [place[x:y].tobytes() for x, y in spans]
            out["times"] = [width + times[x:y].tobytes() for x, y in spans]
            yield out.assign(docs=None)
        nothing = {c: [None] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "times")}
        yield pd.DataFrame({"slice": [slice_id], "number": [-1], **nothing, "pairs": [codes.astype("<i8").tobytes()], "docs": [docs.astype("<u4").tobytes()]})


def _align(first: str, second: str, columns: list[str]):
    def run(batches):
        part, number, held = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].tolist(), batch["text"].tolist()):
                held = held or _Slice(_units(first, second))
                held.add(doc_id, text)
                if held.chars >= SLICE_CHARS:
                    yield from (x[columns] for x in held.frames(part << 32 | number))
                    number, held = number + 1, None
        if held:
            yield from (x[columns] for x in held.frames(part << 32 | number))

    return run


def _listed(batches):
    """(slice, place, pair, docs) rows of the slices' lists."""
    for batch in batches:
        for name, pairs, docs in zip(batch["slice"], batch["pairs"], batch["docs"]):
            codes, held = np.frombuffer(pairs, dtype="<i8"), np.frombuffer(docs, dtype="<u4").astype(np.int64)
            for a in range(0, len(codes), 100_000):
                some = slice(a, a + 100_000)
                yield pd.DataFrame({"slice": name, "place": np.arange(len(codes))[some], "pair": codes[some], "docs": held[some]})


def _judged(columns: list[str]):
    """Sums of a slice's documents over their links."""

    def run(key, rows: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        counts = np.zeros(int(known["place"].max()) + 1 if len(known) else 0, dtype=np.int64)
        best = np.zeros(len(counts), dtype=np.int64)
        counts[known["place"]] = known["count"]
        best[known["place"]] = known["best"]
        sums, bests = [], []
        for pairs, times in zip(rows["pairs"], rows["times"]):
            at = np.frombuffer(pairs, dtype="<u4")
            n = np.frombuffer(times, dtype="<u4" if times[:1] == b"4" else "<u8", offset=1).astype(np.int64)
            bests.append(int((n * best[at]).sum()))
            sums.append(int((n * counts[at]).sum()))
        return rows.assign(n_best=bests, count_sum=sums)[columns]

    return run


def align(docs: DataFrame, first: str | None = None, second: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document.

    ``first`` is a byte-level vocabulary file that sees a space before the text, ``second`` a sentence-piece
    model that adds one. Groups are the intervals between byte offsets where tokens of both end; every first
    and second token of a group are linked. A pair of ids counts in how many documents it is linked.

    Texts that are null or empty, or that a tokenizer does not give back byte for byte, have no tokens:
    zeros and an empty digest. Null and repeated ids are documents of their own; an empty table gives no
    rows; other columns are ignored. A text of any length is cut into units part by part; the memory of one
    group grows with the product of its distinct ids.
    """
    first, second = first or tokenizer_path(FIRST), second or tokenizer_path(SECOND)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    schema = ROWS.format(id=kind)
    names = [x.split(" ")[0] for x in schema.split(", ")]
    aligned = materialise(rows.mapInPandas(lean("aligner", _align(first, second, names)), schema), "aligned")
    held = aligned.where("number < 0").select("slice", "pairs", "docs").mapInPandas(_listed, "slice long, place int, pair long, docs long")
    held = materialise(held, "pairs")
    total = held.groupBy("pair").agg(F.sum("docs").alias("count"))
    total = materialise(total, "pair-counts")
    a_id = F.shiftright("pair", ID_BITS)
    most = total.groupBy(a_id.alias("a_id")).agg(F.max("count").alias("most"))
    judged = total.withColumn("a_id", a_id).join(most, "a_id").select("pair", "count", (F.col("count") == F.col("most")).cast("int").alias("best"))
    known = held.select("slice", "place", "pair").join(judged, "pair").select("slice", "place", "count", "best")
    out = OUT.format(id=kind)
    columns = [x.split(" ")[0] for x in out.split(", ")]
    return aligned.where("number >= 0").groupBy("slice").cogroup(known.groupBy("slice")).applyInPandas(_judged(columns), out)
