"""Collocations, mixing and tokenizer alignment against plain versions, and on odd rows."""

import hashlib
import random
import re
import tracemalloc
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from flowcairn.llm import alignment, collocations, pareto_mix

RANDOM = random.Random(5)
WORDS = "the of and alpha beta gamma delta eps zeta état straße İstanbul 木 é".split()


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


# ---------------------------------------------------------------- collocations


def plain_collocations(docs, min_count, covered=80, top=2000):
    counts, totals = defaultdict(Counter), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for m in range(1, 5):
                counts[lang].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = set()
    for lang, f in counts.items():
        wide = {p: a for p, a in f.items() if len(p) > 1 and a >= min_count}
        rows = []
        for p, a in wide.items():
            if any(
                100 * b >= covered * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
                for q, b in wide.items() if len(q) > len(p)
            ):
                continue
            cuts = [(2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, phrase, left, right) in enumerate(sorted(rows)[:top], 1):
            out.add((lang, rank, phrase.decode(), -a, left, right, totals[lang], -s))
    return out


def phrase_documents():
    fixed = [" ".join(RANDOM.choice(WORDS) for _ in range(4)) for _ in range(6)]
    docs = []
    for _ in range(220):
        words = [RANDOM.choice(fixed) if RANDOM.random() < 0.3 else RANDOM.choice(WORDS) for _ in range(RANDOM.randrange(1, 25))]
        glue = [RANDOM.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\r\n", " \x0b ", "\x0c"]) for _ in words]
        text = "".join(w + g for w, g in zip(words, glue))
        docs.append((text.upper() if RANDOM.random() < 0.2 else text, RANDOM.choice(["en", "de", None, "und", ""])))
    docs += [(None, "en"), ("", None), (" \t ", "en"), ("...", "de"), ("one two", "fr")]
    docs += [docs[0]] * 12
    docs.append((" ".join(RANDOM.choice(WORDS) for _ in range(3000)), "en"))  # one long piece
    docs.append(("x" * 500 + " " + "y" * 700 + " the of " + "z" * 300, "en"))
    return docs


@pytest.mark.parametrize("slice_bytes", [64, 1000, collocations.SLICE_BYTES])
def test_collocations_equal_the_plain_version(spark, slice_bytes):
    docs = phrase_documents()
    rows = [(i, t, lang, "en", 1.5) for i, (t, lang) in enumerate(docs)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, phrase string, slice double").repartition(5)
    found = collocations.collocations(df, min_count=5, top=40, slice_bytes=slice_bytes)
    got = [tuple(r) for r in found.collect()]
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert len(got) == len(set(got)) and set(got) == plain_collocations(docs, 5, top=40)


def test_a_slice_takes_little_more_than_its_sums():
    words = [f"w{RANDOM.randrange(5000)}" for _ in range(200_000)]
    text = " ".join(words).encode()
    collocations.worker_state("other")  # drops kept tables
    tracemalloc.start()
    try:
        found = collocations.SliceWords(len(text), ["en"], [0], pa.compress(text, codec="zstd", asbytes=True))
        assert len(found.starts) == len(words)
        assert tracemalloc.get_traced_memory()[1] < 24 * len(text)
    finally:
        tracemalloc.stop()


def test_no_collocations(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert collocations.collocations(empty).collect() == []
    assert collocations.collocations(spark.createDataFrame([(1, None, None)], "doc_id long, text string, lang string")).collect() == []


def test_equal_fingerprints_are_told_apart(monkeypatch):
    """With constant byte codes all n-grams of one length collide."""
    monkeypatch.setattr(collocations, "BYTE_CODES", np.zeros(256, dtype=np.uint64))
    lines = [b" ".join(RANDOM.choice([b"ab", b"ba", b"cc", b"d"]) for _ in range(RANDOM.randrange(1, 9))) for _ in range(60)]
    text = b"\n".join(lines)
    words = collocations.SliceWords(len(text), ["en"], [0], pa.compress(text, codec="zstd", asbytes=True))
    for n in (1, 2, 3, 4):
        want = Counter(tuple(w[i : i + n]) for w in (x.split(b" ") for x in lines) for i in range(len(w) - n + 1))
        codes, first, counts = words.distinct(n)
        got = [(words.phrase(int(i), n), int(c)) for i, c in zip(first, counts)]
        assert len(got) == len(dict(got)) and dict(got) == {b" ".join(p).decode(): c for p, c in want.items()}
        assert len(set(codes.tolist())) < len(codes) or len(codes) < 3


# ---------------------------------------------------------------- mixing


def plain_targets(sizes, most=3):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        open_weight = sum(weight[s] for s in order if s not in full)
        share = {s: Fraction(most * sizes[s]) if s in full else Fraction(rest * weight[s], open_weight) for s in order}
        above = {s for s in order if share[s] > most * sizes[s]}
        if not above:
            return share
        full |= above


def mixed_documents():
    rows = []
    for i in range(900):
        source = RANDOM.choice(["hot"] * 10 + ["a", "Z", "z", "é", "", None, "tiny", "src2", "src10"])
        n = RANDOM.randrange(0, 40) if source != "tiny" else 1
        rows.append((i if i % 50 else None, " ".join(["w"] * n) if i % 30 else None, source))
    return rows + [(7, "same words here", "hot")] * 40 + [(8, "b " * 3000, "big")]


def test_mix_meets_its_targets(spark):
    rows = mixed_documents()
    wide = [(*r, 5, 0.5, "x") for r in rows]
    df = spark.createDataFrame(wide, "doc_id long, text string, source string, size int, random double, rank string").repartition(7)
    out = [r.asDict() for r in pareto_mix.mix(df).collect()]
    again = [r.asDict() for r in pareto_mix.mix(df.repartition(3)).collect()]
    key = lambda r: (str(r["doc_id"]), r["source"] or "", r["size"], r["taken"], r["copies"])
    assert sorted(map(key, out)) == sorted(map(key, again))
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((d, s, size(t)) for d, t, s in rows) == Counter((r["doc_id"], r["source"], r["size"]) for r in out)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += size(t)
    want, taken, largest = plain_targets(sizes), Counter(), Counter()
    for r in out:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(float(want[r["source"]]))
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
        assert r["copies"] in (int(want[r["source"]] / sizes[r["source"]]), int(want[r["source"]] / sizes[r["source"]]) + 1)
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    for s in sizes:
        assert abs(taken[s] - float(want[s])) <= largest[s] / 2 + 1


def test_mix_takes_documents_in_order_of_odds(spark):
    rows = [(i, "w " * (1 + i % 9), "ab"[i % 3 == 0], 1.0 + i % 4) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, quality double")
    out = pareto_mix.mix(df, weight_col="quality").collect()
    by_weight = defaultdict(list)
    for r in out:
        by_weight[r["source"], 1.0 + r["doc_id"] % 4].append(r)
    for (source, weight), some in by_weight.items():
        share, chance = sum(r["copies"] for r in some) / len(some), some[0]["chance"]
        assert all(r["chance"] == pytest.approx(chance) for r in some)
        assert min(abs(share - sure - chance) for sure in range(4)) < 0.25
    for source in "ab":
        some = [r for r in out if r["source"] == source]
        expected = sum(min(3.0, r["target"] * (1.0 + r["doc_id"] % 4) / sum(x["size"] * (1.0 + x["doc_id"] % 4) for x in some)) * r["size"] for r in some)
        assert abs(sum(r["taken"] for r in some) - expected) <= 5


def test_mix_of_nothing(spark):
    schema = "doc_id long, text string, source string"
    assert pareto_mix.mix(spark.createDataFrame([], schema)).collect() == []
    out = pareto_mix.mix(spark.createDataFrame([(1, None, None), (2, "", "a")], schema)).collect()
    assert sorted((r["doc_id"], r["size"], r["target"], r["taken"]) for r in out) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]
    one = pareto_mix.mix(spark.createDataFrame([(1, "a b c", None)], schema)).collect()
    assert [(r["target"], r["taken"]) for r in one] == [(3.0, 3)]


# ---------------------------------------------------------------- alignment


def plain_alignment(texts):
    """Whole texts through both libraries, groups by set intersection, pairs counted with dictionaries."""
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, extra = {}, 0
    for byte in range(256):
        if byte in printable:
            letters[chr(byte)] = byte
        else:
            letters[chr(256 + extra)] = byte
            extra += 1
    docs, held = [], Counter()
    for text in texts:
        groups = []
        if text:
            ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            bytes_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
            bytes_b = [bytes([int(b.id_to_piece(i)[1:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
            if b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
                ends = [np.cumsum([len(x) for x in some]).tolist() for some in (bytes_a, bytes_b)]
                at = [0, 0]
                for end in sorted(set(ends[0]) & set(ends[1])):
                    to = [ends[0].index(end) + 1, ends[1].index(end) + 1]
                    groups.append((ids_a[at[0] : to[0]], ids_b[at[1] : to[1]]))
                    at = to
        links = [(x, y) for p, q in groups for x in p for y in q]
        held.update(set(links))
        docs.append((groups, links))
    best = Counter()
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    out = []
    for groups, links in docs:
        text = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        out.append((
            sum(len(p) for p, _ in groups), sum(len(q) for _, q in groups), len(groups), len(links),
            sum(held[x] == best[x[0]] for x in links), sum(held[x] for x in links),
            hashlib.sha256(text.encode()).hexdigest() if groups else "",
        ))
    return out


def odd_texts():
    chars = "ab cd.,!?'s\n\t  é木　​ \x1c\x00\U0001f600İßﬁ0123<|>"
    texts = [None, "", " ", "   ", "a", " a", "a ", "  a  b  ", "<|endoftext|> x", "<s> </s> <0x41> <unk>", "x▁y", "▁", "don't  we'll", "a\n b", "a \nb", "\n\n a", "aaaa" * 50]
    texts += ["".join(RANDOM.choice(chars) for _ in range(RANDOM.randrange(1, 90))) for _ in range(250)]
    texts += [" ".join(RANDOM.choice(WORDS + ["internationalisation", "Reconnaissance,", "1234567", "…"]) for _ in range(60)) for _ in range(40)]
    return texts + ["repeated text here"] * 30


def test_alignment_equals_whole_texts(spark, monkeypatch):
    monkeypatch.setattr(alignment, "SLICE_CHARS", 700)
    monkeypatch.setattr(alignment, "CHUNK_CHARS", 40)
    texts = odd_texts()
    rows = [(i, t, 1, "x", 2) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, slice int, pair string, n_a int").repartition(4)
    got = {r["doc_id"]: tuple(r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for r in alignment.align(df).collect()}
    want = dict(enumerate(plain_alignment(texts)))
    assert [(i, texts[i], got[i], want[i]) for i in want if got[i] != want[i]] == []
    assert len(got) == len(texts) and want[0] == (0, 0, 0, 0, 0, 0, "")


def test_alignment_of_long_and_odd_rows(spark):
    long = " ".join(RANDOM.choice(WORDS) for _ in range(260_000)) + "9" * 30_000
    rows = [(None, long), (3, "one two"), (3, "one two"), (None, None)]
    out = alignment.align(spark.createDataFrame(rows, "doc_id int, text string")).collect()
    assert sorted((str(r["doc_id"]), r["n_a"] > 0, r["n_links"] >= r["n_groups"]) for r in out) == [("3", True, True)] * 2 + [("None", False, True), ("None", True, True)]
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_cuts_of_random_ends():
    for _ in range(400):
        n = RANDOM.randrange(1, 60)
        a = sorted({*RANDOM.sample(range(1, n + 1), RANDOM.randrange(0, n)), n})
        b = sorted({*RANDOM.sample(range(1, n + 1), RANDOM.randrange(0, n)), n})
        cuts, groups = sorted(set(a) & set(b)), alignment.shared_cuts(np.array(a), np.array(b)).tolist()
        assert [a[x[1] - 1] for x in groups] == [b[x[3] - 1] for x in groups] == cuts
        assert all(x[1] == y[0] and x[3] == y[2] for x, y in zip(groups, groups[1:]))
