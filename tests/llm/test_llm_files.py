"""Token files, archives and packing: exact round trips and plain versions."""

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from flowcairn.llm import packing, simple8b, warc_chunks
from flowcairn.llm.catalog import QUERIES
from flowcairn.llm.tokens import TextEncoder, tokenizer_path

ODD_TEXTS = [
    "", "  \n", "<|endoftext|>A", "A<|EndOfText|>b", "it's. they'll, 3.14... x\x1cy é́ .́ Σ ΑΣ ΑΣ.", "İstanbul. I'S don'T!!",
    "x!!' y a'.s b..'s", "a b c d", "漢字かな, 123 ¼ ½", "word*** other%%% &&&", "́start á.́",
]
DOCS = [(5, "Of the, end."), (1, None), (None, "no id"), (3, ""), (2, "long " * 3000), (5, "Of the, end."), (4, "é😀 tail")]


@pytest.fixture(scope="module")
def coder():
    return TextEncoder(tokenizer_path())


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame(DOCS, "doc_id long, text string")
    return rows.withColumns({"ids": F.lit("clash"), "start": F.lit(1), "n_tokens": F.lit(None).cast("int"), "part": F.lit(0)})


def library(coder, text):
    return [*coder.tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def test_encoder_agrees_with_the_library(coder, spark, sf_dir):
    texts = ODD_TEXTS + [r[0] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    for text, ids in zip(texts, coder.encode(texts, b"\1\0\0\0")):
        assert np.frombuffer(ids, "<u4").tolist() == library(coder, text), text[:60]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("aBzé '.,!?*&́İΣ\t\x1c<|>endoftx3½漢"), max_size=40))
def test_encoder_on_odd_texts(text):
    coder = test_encoder_on_odd_texts.__dict__.setdefault("coder", TextEncoder(tokenizer_path()))
    assert np.frombuffer(coder.encode([text])[0], "<u4").tolist() == library(coder, text)[:-1]


def test_letters_go_to_the_library_once(monkeypatch):
    coder, sent = TextEncoder(tokenizer_path()), []
    ask = coder._library
    monkeypatch.setattr(coder, "_library", lambda texts: sent.extend(w for t in texts for w in t.split()) or ask(texts))
    texts = ["word, word. straße", "Word! word; the word", "straße: the!"]
    for text in texts:
        assert np.frombuffer(coder.encode([text])[0], "<u4").tolist() == library(coder, text)[:-1]
    assert [sent.count(w) for w in ("word", "straße", "the")] == [1, 1, 1]


def test_words_met_first_stay_in_a_full_cache():
    coder = TextEncoder(tokenizer_path(), cache_words=6)
    for text in ("the of and", "one two. three, four", "seven eight 木 nine. the", "ten the of"):
        assert np.frombuffer(coder.encode([text])[0], "<u4").tolist() == library(coder, text)[:-1]
        assert {b"the", b"of", b"and"} <= set(coder.cache)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 1), st.integers(0, 60_000), st.integers(0, 2**64 - 1)), max_size=1500))
def test_words_round_trip(values):
    values = np.array(values, dtype=np.uint64)
    words, offsets, escapes = simple8b.encode_words(values)
    found = simple8b.decode_words(words, len(values))
    for b in range(len(offsets)):
        part = simple8b.decode_block(words, offsets, b, len(values))
        assert (part == found[b * simple8b.BLOCK :][: len(part)]).all()
    found[escapes] = values[escapes]
    assert (found == values).all() and (values[escapes] >= 1 << 60).all()


def test_zero_runs_are_dense():
    words, _, _ = simple8b.encode_words(np.zeros(480, dtype=np.uint64))
    assert len(words) == 2


def test_token_files(spark, docs, coder):
    folder, manifest = simple8b.write_tokens(docs)
    rows = sorted(simple8b.read_tokens(folder, manifest).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [None, 1, 2, 3, 4, 5, 5]
    texts = {d: t for d, t in DOCS}
    at = 0
    for r in rows:
        ids = library(coder, texts[r["doc_id"]])
        assert r["start"] == at and r["n_tokens"] == len(ids) and np.frombuffer(r["ids"], "<u4").tolist() == ids
        at += len(ids)
    folder, manifest = simple8b.write_tokens(docs.limit(0))
    assert simple8b.read_tokens(folder, manifest).count() == 0


def test_a_cut_token_file_is_noticed(tmp_path):
    with open(tmp_path / "x", "wb") as out:
        simple8b.write_group(out, [1, None], [2, 1], np.array([5, 2**61, 7], dtype=np.uint64))
    with open(tmp_path / "x", "rb") as source, pytest.raises(ValueError):
        list(simple8b.read_groups(source))


def test_token_query(spark, sf_dir, coder):
    texts = dict(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    at = 0
    rows = {r["doc_id"]: r for r in QUERIES["op3_simple8b_tokens"](spark, sf_dir).collect()}
    assert len(rows) == len(texts)
    for d in sorted(texts):
        ids = np.array(library(coder, texts[d]), dtype="<u4")
        assert (rows[d]["start"], rows[d]["n_tokens"], rows[d]["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_packing(spark, docs, coder):
    pieces = packing.pack(docs, length=64).collect()
    texts = {d: t for d, t in DOCS}
    by_sequence = {}
    for p in pieces:
        ids = library(coder, texts[p["doc_id"]])
        assert np.frombuffer(p["ids"], "<u4").tolist() == ids[p["start"] : p["start"] + p["length"]] and p["doc_tokens"] == len(ids)
        by_sequence.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    assert sum(p["length"] for p in pieces) == sum(len(library(coder, t)) for _, t in DOCS)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for s, parts in by_sequence.items():
        parts.sort()
        assert [a for a, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))]
        assert sum(n for _, n in parts) == 64 or s == max(by_sequence)
    assert packing.pack(docs.limit(0)).count() == 0


def test_sequences_are_padded(spark):
    pieces = spark.createDataFrame(
        [(1, 0, 3, bytearray(b"\1\0\0\0\2\0\0\0\3\0\0\0"), 3, 0, 0), (2, 0, 2, bytearray(b"\4\0\0\0\5\0\0\0"), 2, 1, 0)],
        "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long",
    )
    rows = {r["sequence_id"]: r for r in packing.sequences(pieces, length=8).collect()}
    assert rows[0]["padded_length"] == 8 and np.frombuffer(rows[0]["ids"], "<u4").tolist() == [1, 2, 3, 0, 0, 0, 0, 0]
    assert rows[1]["padded_length"] == 2 and np.frombuffer(rows[1]["ids"], "<u4").tolist() == [4, 5]


def test_packing_query(spark, sf_dir, coder):
    texts = dict(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    total = 0
    for p in QUERIES["op10_concat_and_cut"](spark, sf_dir).collect():
        ids = np.array(library(coder, texts[p["doc_id"]]), dtype="<u4")[p["start"] : p["start"] + p["length"]]
        assert zlib.crc32(ids.tobytes()) == p["ids_crc32"] and p["offset"] + p["length"] <= 2048
        total += p["length"]
    assert total == sum(len(library(coder, t)) for t in texts.values())


PAGES = [
    (7, "http://a/x y", "é" * 300), (3, None, "é" * 300), (9, "http://b/", "é" * 300), (4, "u", "short"), (2, "u", "short"),
    (1, "u", None), (5, "u", ""), (9, "http://b/", "é" * 300), (None, "n", "z" * 200), (8, "n", "z" * 200), (6, "w", "0123456789" * 5000),
    (10, "crlf\r\n", "WARC/1.1\r\n\r\nWARC-Type: fake\r\n\r\n" * 10),
]


def test_archives(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    folder, files = warc_chunks.write_archives(pages, chunk=64, archive_bytes=600)
    assert files.agg(F.sum("n_records")).first()[0] == len(PAGES) and files.count() > 2
    rows = warc_chunks.read_archives(folder, files, chunk=100).collect()
    payloads = {}
    for r in sorted(rows, key=lambda r: r["chunk"]):
        assert len(r["data"]) <= 100
        key = (r["page_id"], r["record_type"], r["refers_to"])
        payloads.setdefault(key, []).append(r)
    first = {}
    for page, _, html in PAGES:
        h = html or ""
        if len(h.encode()) >= 100 and page is not None:
            first[h] = min(page, first.get(h, page))
    expected = {}
    for page, _, html in PAGES:
        h = html or ""
        refers = first.get(h) if len(h.encode()) >= 100 and first.get(h) != page else None
        expected[page, "response" if refers is None else "revisit", refers] = h.encode()
    assert set(payloads) == set(expected)
    for key, parts in payloads.items():
        last = [r for r in parts if r["is_last"]][-1]
        assert last["payload_bytes"] == len(expected[key]) and last["payload_digest"] == hashlib.sha256(expected[key]).hexdigest()
        if key[1] == "response" and key[0] != 9:
            assert b"".join(bytes(r["data"]) for r in parts) == expected[key]
    assert warc_chunks.read_archives(*warc_chunks.write_archives(pages.limit(0))).count() == 0
