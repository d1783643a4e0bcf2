"""Similarity joins, nearest neighbours, list joins and the pipeline against plain versions, and on odd rows."""

import datetime as dt
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from flowcairn.llm import components, decontaminate, jaccard_groups, prefix_forest, secret_scan, toxicity, url_lists
from flowcairn.llm.catalog import QUERIES

RANDOM = random.Random(11)
VOCABULARY = [f"w{i}" for i in range(3000)]


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def plain_components(docs, percent=80):
    """{doc_id: smallest id reachable}; rows that share an id are one node."""
    sets = [(d, shingles(t)) for d, t in docs if d is not None]
    at = {d: d for d, _ in sets}

    def root(x):
        while at[x] != x:
            x = at[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if s and t and len(t) * 5 >= len(s) * 4 and len(s) * 5 >= len(t) * 4:
                k = len(s & t)
                if 100 * k >= percent * (len(s) + len(t) - k):
                    x, y = root(a), root(b)
                    at[max(x, y)] = min(x, y)
    return {d: root(d) for d in at}


def changed(words, n):
    words = list(words)
    for _ in range(n):
        words[RANDOM.randrange(len(words))] = RANDOM.choice(VOCABULARY)
    return words


def similar_documents():
    """Copies, families whose members differ a little or a lot, passages in many documents, chains, and one
    text whose many copies mostly differ too much from each other to link."""
    text = lambda n: [RANDOM.choice(VOCABULARY) for _ in range(n)]
    out = []
    common = [text(40) for _ in range(3)]
    for _ in range(60):
        out.append(text(RANDOM.randrange(1, 150)) + RANDOM.choice(common) + text(RANDOM.randrange(60)))
    base = text(120)
    out += [changed(base, RANDOM.randrange(6)) for _ in range(80)]
    out += [list(base)] * 15
    far = text(120)
    out += [changed(far, RANDOM.randrange(4, 9)) for _ in range(90)]
    chain = text(100)
    for _ in range(25):
        chain = changed(chain, 2)
        out.append(chain)
    out += [RANDOM.choice(common) + text(RANDOM.randrange(1, 8)) for _ in range(40)]
    for _ in range(15):
        one = text(RANDOM.randrange(5, 60))
        out += [one, one + text(1), one[1:]]
    out += [text(k) for k in (1, 2, 3, 4, 5)] * 2 + [["w1", "w2"], ["W1", "w2"], ["w1"]]
    docs = [(i * 3 + 5, " ".join(w)) for i, w in enumerate(out)]
    RANDOM.shuffle(docs)
    return docs + [(1, None), (2, ""), (3, " \n\t"), (None, docs[0][1]), (None, None), docs[1], (docs[2][0], "another text for an id that is there"), (4, "a\x0bb c D É")]


@pytest.mark.parametrize("limits", [{}, {"CHUNK": 3, "QUERIES": 2, "TOGETHER": 2, "COMMON": 2, "COUNT_DOCS": 20, "SEMI_JOIN_ROWS": 0, "SEGMENT": 50, "LEADERS": 2, "LARGE": 3, "TAIL": 2, "SIMILAR": 4, "SIMILAR_SINGLES": 2, "SIMILAR_CHUNK": 3, "COPIED_SETS": 0}])
def test_similarity_components(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(jaccard_groups, name, value)
    docs = similar_documents()
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"unit": F.lit("clash"), "n": F.lit(1), "code": F.lit(2)})
    rows = jaccard_groups.similarity_components(table).collect()
    want = plain_components(docs)
    assert sorted((r["doc_id"] or -1, r["n_shingles"]) for r in rows) == sorted((d or -1, len(shingles(t))) for d, t in docs)
    assert {r["doc_id"]: r["component_id"] for r in rows if r["doc_id"] is not None} == want
    assert all(r["component_id"] is None for r in rows if r["doc_id"] is None)
    assert len(set(want.values())) < len(want) - 100


def test_no_documents_have_no_components(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_groups.similarity_components(empty).count() == 0


@pytest.mark.parametrize("local_links", [7, 500_000])
def test_connected_components(spark, monkeypatch, local_links):
    monkeypatch.setattr(components, "LOCAL_LINKS", local_links)
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 200), (200, 100), (300, 300)] + [(1000, 1000 + i) for i in range(1, 50)]
    found = dict(components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert {found[i] for i in range(1, 61)} == {1} and found[200] == 100 and 300 not in found and found[1049] == 1000


def test_forest_finds_neighbours(spark):
    rng = np.random.default_rng(3)
    vectors = rng.standard_normal((1500, 24)) * rng.uniform(0.5, 2, (1500, 1))
    vectors[:300] = vectors[0]  # a very common vector
    rows = [(i, [float(x) for x in np.float32(v)]) for i, v in enumerate(vectors)]
    odd = [(9001, None), (9002, [0.0] * 24), (9003, [float("nan")] + [1.0] * 23), (9004, [None] + [1.0] * 23), (9005, [1.0] * 3), (9006, []), (None, rows[5][1]), (9007, [float("inf")] * 24), rows[7]]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumns({"score": F.lit("clash"), "id": F.lit(1)})
    found = prefix_forest.search(table, table.where("vec_id % 20 = 0"), k=20).toPandas()
    kept = np.array([v for _, v in rows], dtype=np.float64)
    hits = 0
    assert set(found["query_id"]) == set(range(0, 1500, 20))
    for q, own in found.groupby("query_id"):
        own = own.sort_values("rank")
        scores = kept @ kept[q]
        scores[q] = -np.inf
        best = np.lexsort((np.arange(1500), -scores))[:20]
        assert own["rank"].tolist() == list(range(1, 21)) and np.allclose(own["score"], scores[own["vec_id"]], rtol=0, atol=1e-12)
        hits += len(set(best) & set(own["vec_id"]))
        if q < 300:
            assert own["vec_id"].tolist() == best.tolist()
    assert hits / len(found) >= 0.9
    few = prefix_forest.search(table.limit(4), table.limit(1), k=20).collect()
    assert len(few) == 3
    assert prefix_forest.search(table.limit(0), table).count() == 0 and prefix_forest.search(table, table.limit(0)).count() == 0


def test_forest_recall_on_the_table(spark):
    folder = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").toPandas().sort_values("vec_id")
    vectors, ids = np.stack(rows["embedding"]).astype(np.float64), rows["vec_id"].to_numpy()
    hits = total = 0
    for q, own in QUERIES["op5_prefix_forest"](spark, folder).toPandas().groupby("query_id"):
        scores = vectors @ vectors[np.searchsorted(ids, q)]
        scores[ids == q] = -np.inf
        hits += len(set(ids[np.lexsort((ids, -scores))[:20]]) & set(own["vec_id"]))
        total += 20
    assert hits / total >= 0.9


def plain_keys(url):
    m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", url or "")
    if not m or not m[1].rstrip("."):
        return []
    host = m[1].lower().rstrip(".")
    labels = host.split(".")
    keys = [host] if len(labels) <= 2 else [".".join(labels[i:]) for i in range(len(labels) - 1)]
    path = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", url)
    parts = [x for x in (path[1] if path else "").split("/") if x]
    return keys + [host + "/" + "/".join(parts[: i + 1]) for i in range(len(parts))]


def plain_active(url, day, entries):
    out = []
    if url is None or day is None:
        return out
    for key in plain_keys(url):
        for name in {e[0] for e in entries if e[2] == key and e[0] is not None}:
            own = [e for e in entries if e[0] == name and e[2] == key and e[3] is not None and e[3] <= day and e[4] in ("add", "remove")]
            if own:
                last = max(e[3] for e in own)
                if any(e[4] == "add" for e in own if e[3] == last):
                    out.append((key, name))
    return sorted(out)


def test_lists_as_of_the_fetch_day(spark):
    d = lambda n: dt.date(2021, 1, 1) + dt.timedelta(n)
    entries = [
        ("bad", "block", "example.com", d(0), "add"), ("bad", "block", "example.com", d(400), "remove"), ("bad", "block", "example.com", d(800), "add"),
        ("bad", "block", "example.com", d(800), "remove"), ("bad", "block", "example.com", d(0), "add"), ("ok", "allow", "a.example.com", d(100), "add"),
        ("bad", None, "a.example.com/x/y", d(50), "add"), ("bad", "block", "other.org", d(5), "remove"), ("bad", "block", "other.org", None, "add"),
        (None, "block", "other.org", d(1), "add"), ("bad", "block", None, d(1), "add"), ("bad", "block", "other.org", d(9), "pause"), ("x", "block", "localhost", d(-900), "add"),
    ]
    urls = ["http://example.com", "https://u@A.Example.com:8080/x/y/z?q=/w#f", "http://a.example.com./x", "ftp://other.org/", "nonsense", None, "", "http://localhost/", "http://notexample.com/", "http://a.example.com/x//y"]
    captures = [(i, u, None if n is None else d(n)) for i, (u, n) in enumerate((u, n) for u in urls for n in (-1, 0, 60, 399, 400, 799, 800, 1200, None))]
    table = spark.createDataFrame(captures + captures[:3], "page_id int, url string, fetched date").withColumns({"key": F.lit(1), "year": F.lit(2), "active": F.lit("clash")})
    rows = url_lists.active_entries(table, spark.createDataFrame(entries, "list string, effect string, key string, day date, action string")).collect()
    assert len(rows) == len(captures) + 3
    for r in rows:
        assert [(a["key"], a["list"]) for a in r["active"]] == plain_active(r["url"], r["fetched"], entries) and r["n_active"] == len(r["active"])
    verdict = {(r["url"], r["fetched"]): r["blocked"] for r in rows}
    assert verdict[urls[1], d(60)] and verdict[urls[2], d(60)] and not verdict[urls[2], d(399)] and verdict[urls[9], d(399)]
    nothing = url_lists.active_entries(table, spark.createDataFrame([], "list string, effect string, key string, day date, action string"))
    assert nothing.where("blocked OR n_active > 0").count() == 0 and url_lists.active_entries(table.limit(0), nothing.select(
        F.lit("l").alias("list"), F.lit("block").alias("effect"), F.col("url").alias("key"), F.col("fetched").alias("day"), F.lit("add").alias("action"))).count() == 0


def test_captures_after_today(spark):
    day = dt.date
    entries = spark.createDataFrame(
        [("l", "block", "a.com", day(2020, 1, 1), "add"), ("l", "block", "b.com", day(2020, 1, 1), "add"), ("l", "block", "b.com", day(2150, 1, 1), "remove"),
         ("l", "block", "c.com", day(2500, 5, 1), "add")],
        "list string, effect string, key string, day date, action string",
    )
    days = {"a.com": [day(2019, 12, 31), day(2020, 1, 1), day(2100, 6, 1), day(9999, 12, 31)], "b.com": [day(2149, 12, 31), day(2150, 1, 1)], "c.com": [day(2500, 4, 30), day(2500, 5, 1)]}
    captures = spark.createDataFrame([(f"http://{h}/", d) for h, ds in days.items() for d in ds], "url string, fetched date")
    got = sorted((r["url"][7:12], r["fetched"]) for r in url_lists.active_entries(captures, entries).collect() if r["blocked"])
    assert got == sorted((h, d) for h, d in [*(("a.com", d) for d in days["a.com"][1:]), ("b.com", days["b.com"][0]), ("c.com", days["c.com"][1])])


def test_pipeline_stages(spark, sf_dir):
    """Each stage on its predecessor's rows, against plain versions; then the whole run."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_duplicates", "decontamination", "secrets", "packing"]
    odd = spark.createDataFrame([(900_001, None, "xx", None, None), (900_002, "", None, "s", 0), (None, "no id", "en", "s", 5)], docs.schema)
    docs = docs.unionByName(odd).unionByName(docs.where("doc_id = 3"))
    rows = {(r["doc_id"], r["text"]) for r in docs.collect()}

    calm = stages["toxicity"](spark, docs, sf_dir)
    scores = toxicity.fit(docs, labels).score(docs).collect()
    assert calm.schema == docs.schema
    assert {(r["doc_id"], r["text"]) for r in calm.collect()} == {(r["doc_id"], r["text"]) for r in scores if r["score"] < toxicity.DECISION} < rows

    single = stages["near_duplicates"](spark, docs, sf_dir)
    component = plain_components(list(rows))
    got = [(r["doc_id"], r["text"]) for r in single.collect()]
    assert single.schema == docs.schema and len(got) == len(set(got))
    assert set(got) == {(d, t) for d, t in rows if d is None or component[d] == d} < rows

    clean = stages["decontamination"](spark, docs, sf_dir)
    report = decontaminate.overlap_report(decontaminate.find_overlap(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))
    hit = {r["doc_id"] for r in report.where("contaminated").collect()}
    assert clean.schema == docs.schema and hit and {r["doc_id"] for r in clean.collect()} == {d for d, _ in rows} - hit

    safe = stages["secrets"](spark, docs, sf_dir)
    found = {(r["doc_id"], r["text"]): r for r in secret_scan.redact(secret_scan.find_secrets(docs)).collect()}
    assert safe.schema == docs.schema and {(r["doc_id"], r["text"]) for r in safe.collect()} == set(found)
    assert safe.where("n_chars <> length(text)").count() == docs.where("n_chars <> length(text)").count()
    assert safe.where(F.col("text").rlike("token = \"[0-9a-f]{40}")).count() == 0

    whole = corpus_pipeline.run(spark, sf_dir)
    chained = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for stage in list(stages.values())[:-1]:
        chained = stage(spark, chained, sf_dir)
    assert {r["doc_id"] for r in whole.select("doc_id").distinct().collect()} == {r["doc_id"] for r in chained.select("doc_id").collect()}


def test_pipeline_on_an_empty_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        assert out.count() == 0


def test_hosts_and_keys_of_odd_urls(spark):
    urls = {
        "http://[2001:db8::1]:80/a/b": ("[2001:db8::1]", ["[2001:db8::1]", "[2001:db8::1]/a", "[2001:db8::1]/a/b"]),
        "http://user:p@ss@Ex.Co.uk./x?q=@y": ("ex.co.uk", ["ex.co.uk", "co.uk", "ex.co.uk/x"]),
        "https://10.0.0.1:8080/a": ("10.0.0.1", ["10.0.0.1", "10.0.0.1/a"]),
        "ftp://a.b.c.d.com": ("a.b.c.d.com", ["a.b.c.d.com", "b.c.d.com", "c.d.com", "d.com"]),
        "http://localhost/": ("localhost", ["localhost"]),
        "http://?x": ("", []), "mailto:me@ex.com": ("", []), "": ("", []),
    }
    rows = spark.createDataFrame([(u,) for u in urls], "url string").select("url", url_lists.url_host().alias("host"), url_lists.url_keys().alias("keys"))
    for r in rows.collect():
        assert (r["host"], sorted(r["keys"])) == (urls[r["url"]][0], sorted(urls[r["url"]][1])), r["url"]
