"""Scans, classifier, overlap and extraction against plain versions, and on odd rows."""

import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from flowcairn.llm import decontaminate, secret_scan, tag_paths, toxicity
from flowcairn.llm.catalog import QUERIES

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
RANDOM = random.Random(5)


def drawn(n, alphabet=LETTERS):
    return "".join(RANDOM.choice(alphabet) for _ in range(n))


SECRETS = [
    (1, f"k {drawn(40)} end"), (2, "é😀 " + drawn(31, LETTERS[52:] + "abcdef") + " x"), (3, None), (4, ""), (None, "token=" + drawn(12)),
    (5, "theveryverylongidentifierofsomethingthatisnotrandom abcdefghijklmnopqrstuvwxyz aaaaaaaaaaaaaaaaaaaaaaaaaaaaaa"),
    (6, "AKIA" + drawn(16, LETTERS[:26]) + " tOken: passwd:longlonglong password='short' api_key==abcdefgh12"),
    (7, "x" * 300_000 + " secret: " + "y" * 9), (7, "x" * 300_000 + " secret: " + "y" * 9), (8, "AKIAAKIA1 AKIA" + "Z" * 11 + " " + "0" * 31),
    (9, f"secret={drawn(24)} {drawn(64, LETTERS[52:] + 'abcdef')} {drawn(64, LETTERS + '+/')}=="),
]


def plain_base(text):
    found = []
    for number, (pattern, least, group) in enumerate([(secret_scan.ASSIGN, 8, 2), ("AKIA[A-Z0-9]+", 16, 0), ("[0-9a-f]+", 32, 0)]):
        found += [(m.start(), number, m.end()) for m in re.finditer(pattern, text or "") if len(m[group]) >= least]
    return sorted(found)


def log_tail(z):
    return math.log(max(math.erfc(z / math.sqrt(2)) / 2, 1e-320))


def plain_battery(token):
    for kind, (_, alphabet, pattern) in enumerate(secret_scan.ALPHABETS):
        if re.match(pattern, token):
            break
    else:
        return None
    n, k = len(token), len(alphabet)
    squares = sum(token.count(c) ** 2 for c in alphabet)
    at = [alphabet.index(c) for c in token]
    chi = (k / n * squares - n - (k - 1)) / math.sqrt(2 * (k - 1) * (n - 1) / n)
    bits = [a >= k // 2 for a in at]
    ones, runs = sum(bits), 1 + sum(a != b for a, b in zip(bits, bits[1:]))
    m = 2 * ones * (n - ones)
    spread = math.sqrt(abs(m * (m - n) / (n * n * (n - 1))))
    z_runs = (runs - m / n - 1) / spread if spread else 40.0
    mean = sum(a + 1 for a in at) / n
    var = sum((a + 1 - mean) ** 2 for a in at)
    serial = math.sqrt(n) * (1 / n + sum((a + 1 - mean) * (b + 1 - mean) for a, b in zip(at, at[1:])) / var) if var else 40.0
    p2, p3 = secret_scan.PAIR_AGREES, secret_scan.TRIPLE_AGREES
    text = (p2 * n * (n - 1) / 2 - (squares - n) / 2) / math.sqrt(n * (n - 1) / 2 * p2 * (1 - p2) + n * (n - 1) * (n - 2) * (p3 - p2**2))
    random_p = min(0.0, math.log(3) + min(log_tail(chi), math.log(2) + log_tail(abs(z_runs)), math.log(2) + log_tail(abs(serial))))
    stays = n * math.log(secret_scan.A_TO_F) if kind <= 1 else 0.0
    return min(secret_scan.MOST_BAND, int(math.log2(n))), random_p, max(secret_scan.LEAST_LOG, stays + log_tail(text))


def plain_scan(texts):
    tested = []
    for i, text in enumerate(texts):
        for m in re.finditer(secret_scan.CANDIDATE, text or ""):
            if (r := plain_battery(m[0])) is not None:
                tested.append((i, m.start(), m.end(), *r))
    out = [plain_base(t) for t in texts]
    base = [list(b) for b in out]
    for band in {t[3] for t in tested}:
        bins = sorted(math.floor(t[5] / secret_scan.BIN) for t in tested if t[3] == band)
        ok = [b for b in bins if (b + 1) * secret_scan.BIN <= math.log(secret_scan.Q) + math.log(sum(x <= b for x in bins) / len(bins))]
        for i, a, e, _, random_p, text_p in (t for t in tested if t[3] == band):
            if ok and math.floor(text_p / secret_scan.BIN) <= max(ok) and random_p >= math.log(secret_scan.ALPHA):
                if not any(x <= a and y >= e for x, _, y in base[i]):
                    out[i].append((a, 3, e))
    return [sorted(o) for o in out]


def test_secret_scan(spark):
    docs = spark.createDataFrame(SECRETS, "doc_id long, text string").withColumns({"spans": F.lit("clash"), "kind": F.lit(1), "x": F.lit(2)})
    found = secret_scan.find_secrets(docs)
    rows = found.collect()
    want = dict(zip([t for _, t in SECRETS], plain_scan([t for _, t in SECRETS])))
    for r in rows:
        assert [tuple(s) for s in r["spans"]] == want[r["text"]] and r["x"] == 2
        assert [tuple(s) for s in r["base_spans"]] == plain_base(r["text"])
    by_id = {r["doc_id"]: r for r in rows}
    assert [s["kind"] for s in by_id[1]["spans"]] == [3] and by_id[5]["spans"] == []
    clean = {r["doc_id"]: r["text"] for r in secret_scan.redact(found).collect()}
    assert clean[1] == "k [secret] end" and clean[3] is None and clean[7].endswith("x [secret]")
    assert len(rows) == len(SECRETS) and secret_scan.find_secrets(docs.limit(0)).count() == 0


def test_secret_query(spark, sf_dir):
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = {d: s for (d, _), s in zip(texts, plain_scan([t for _, t in texts]))}
    name = secret_scan.KINDS
    for r in QUERIES["op1_secret_battery"](spark, sf_dir).collect():
        spans = want[r["doc_id"]]
        assert r["spans"] == ",".join(f"{name[k]}:{a}:{e}" for a, k, e in spans)
        base = ",".join(f"{name[k]}:{a}:{e}" for a, k, e in spans if k < 3)
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == x for _, k, _ in spans) for x in range(3))


def test_secrets_in_mixed_runs(spark):
    key, dashed = drawn(32), drawn(14) + "-" + drawn(11) + "_" + drawn(12)
    slashed = drawn(15) + "/" + drawn(12) + "+" + drawn(13)
    texts = [
        f"see /services/my-team/{key} now", f"see /a/b/c/d/{dashed} now", f"see my-own_long-name-of-it_{slashed} now", f"{key}-_/+{key[::-1]}",
        "see /services/of-the-team/that-has_no/secret-in_the/path-at-all now", "é" * 9 + f" /x-y/{key}", *[f"/only-words/in_this-text/{w}" for w in "abcdefgh"],
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = sorted(secret_scan.find_secrets(docs).collect(), key=lambda r: r["doc_id"])
    for r, secret in zip(rows, [key, dashed, slashed, None, None, key]):
        if secret:
            at = r["text"].index(secret)
            assert any(s["start"] <= at and s["end"] >= at + len(secret) and s["kind"] == 3 for s in r["spans"]), r["text"]
    assert len(rows[3]["spans"]) == 2 and not any(r["spans"] for r in [rows[4], *rows[6:]])
    for r in rows:  # none inside another
        assert not any(a != b and a["start"] <= b["start"] and a["end"] >= b["end"] for a in r["spans"] for b in r["spans"])
    clean = {r["doc_id"]: r["text"] for r in secret_scan.redact(secret_scan.find_secrets(docs)).collect()}
    assert all(x not in clean[i] for i, x in ((0, key), (1, dashed), (2, slashed), (5, key))) and clean[4] == texts[4]


def test_toxicity(spark):
    words = ["river", "stone", "cloud", "garden", "window", "letter", "candle", "harbor", "meadow", "silver"]
    rows = []
    for i in range(400):
        text = [RANDOM.choice(words) for _ in range(40)]
        if i % 4 == 0:
            text[RANDOM.randrange(40)] = RANDOM.choice(["blockhead", "numbskull"])
        rows.append((i, " ".join(text), int(i % 4 == 0)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").withColumns({"score": F.lit("clash"), "label": F.lit(9)})
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (3, None), (1, 0)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    scored = {r["doc_id"]: r for r in model.score(docs).collect()}
    assert len(scored) == 400 and scored[0]["label"] == 9
    assert sum((scored[i]["score"] >= toxicity.DECISION) == bool(y) for i, _, y in rows) >= 396
    odd = spark.createDataFrame([(None, None), (1, ""), (1, ""), (2, "river " * 100_000), (3, "numbskull")], "doc_id long, text string")
    found = model.score(odd).collect()
    assert len(found) == 5 and all(0 <= r["score"] <= 1 for r in found)
    assert {r["doc_id"] for r in found if r["score"] >= toxicity.DECISION} == {3}
    assert model.score(odd.limit(0)).count() == 0
    nothing = toxicity.fit(docs, labels.limit(0))
    assert {r["score"] for r in nothing.score(odd).collect()} == {0.0}


def test_toxicity_ignores_held_out_labels(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.withColumn("toxic", F.when(toxicity.learnable(), F.col("toxic")).otherwise(1 - F.col("toxic")))
    first, second = toxicity.fit(docs, labels), toxicity.fit(docs, flipped)
    assert (first.codes == second.codes).all() and abs(first.weights - second.weights).max() < 1e-6


def test_toxic_query_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    rows = QUERIES["op2_toxic_ngrams"](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out").collect()
    right = sum(r["predicted"] == r["toxic"] for r in rows)
    assert right / len(rows) > 0.93 and not any(r["predicted"] and not r["toxic"] for r in rows)


def plain_overlap(text, items, size=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    own, hit, found = words(text), set(), set()
    for item, t in items:
        w = words(t)
        n = min(size, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            for j in range(len(own) - n + 1):
                if own[j : j + n] == w[i : i + n]:
                    hit |= set(range(j, j + n))
                    found.add(str(item))
    return len(own), len(hit), ",".join(sorted(found))


OVERLAP_ITEMS = [(1, "one two three Four five six seven eight nine ten eleven twelve"), (10, "só CURTO"), (2, None), (3, "..."), (9, "two three"), (None, "no id here")]
OVERLAP_DOCS = [
    (1, "x One, two-three four FIVE six seven eight nine ten y"), (2, "só curto. só-curto"), (None, "two three two three"), (3, None), (4, ""),
    (5, "one two three four five six seven eight nine zero"), (6, ("pad " * 20_000) + "two\nthree"), (6, "SÓ curto"), (7, "two threes ttwo three"),
]


@pytest.mark.parametrize("most_bytes", [1 << 20, 40])
def test_overlap(spark, most_bytes):
    docs = spark.createDataFrame(OVERLAP_DOCS, "doc_id long, text string").withColumns({"items": F.lit("clash"), "item": F.lit(0)})
    bench = spark.createDataFrame(OVERLAP_ITEMS, "item_id long, text string").withColumn("doc_id", F.lit(1))
    found = decontaminate.find_overlap(docs, bench, most_bytes=most_bytes)
    got = sorted((r["text"] or "", r["n_words"], sum(s["end"] - s["first"] for s in r["spans"]), ",".join(r["items"])) for r in found.collect())
    items = [x for x in OVERLAP_ITEMS if x[0] is not None]
    assert got == sorted((t or "", *plain_overlap(t, items)) for _, t in OVERLAP_DOCS)
    clean = {(r["doc_id"], r["text"]) for r in decontaminate.remove_spans(found).collect()}
    assert (1, "x  y") in clean and (5, "one  four five six seven eight nine zero") in clean and (3, None) in clean
    assert decontaminate.find_overlap(docs.limit(0), bench).count() == 0
    assert {r["n_hit"] for r in decontaminate.overlap_report(decontaminate.find_overlap(docs, bench.limit(0))).collect()} == {0}


def test_overlap_without_item_ids(spark):
    docs = spark.createDataFrame([(1, "x no id here y"), (2, "two three no ID here"), (3, "nothing")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, "no id here"), (None, "No id"), (9, "two three")], "item_id long, text string")
    for most_bytes in (1 << 20, 8):
        found = decontaminate.find_overlap(docs, bench, most_bytes=most_bytes)
        got = {r["doc_id"]: ([tuple(s) for s in r["spans"]], r["items"]) for r in found.collect()}
        assert got == {1: ([(1, 4)], []), 2: ([(0, 5)], ["9"]), 3: ([], [])}
        report = {r["doc_id"]: (r["n_hit"], r["n_items"], r["contaminated"]) for r in decontaminate.overlap_report(found).collect()}
        assert report == {1: (3, 1, True), 2: (5, 2, True), 3: (0, 0, False)}  # as the query's SQL counts


PAGE = """<html><head><title>T</title></head><body><header id=top><h1>Site</h1><ul><li><a>x</a></ul></header>
<div class="cookie-notice">We use cookies, ok? Yes.</div><div id="content"><div class=post><h2>Title &amp; more</h2>
<p>First para, with text.<p>Second &#8212; para <b>bold</b>text; it goes on
and on, really.<script>var a = "<p>no</p>";</script></div><div class="sidebar"><p>Side text, which is long. And long.</p></div>
<div class="comments"><p>Nice article! I liked it, truly.</p></div></div><form><p>Sign up</p></form><footer>(c)</footer></body></html>"""


def test_main_text(spark, sf_dir):
    rows = [(1, "u", PAGE), (2, None, None), (3, "v", ""), (3, "v", "plain text"), (None, "w", "<p>a<p>b</b></i>" + "<div>" * 3000), (4, "x", "<p>" + "long, text. " * 50_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit("clash"), "n_chars": F.lit(-1)})
    found = tag_paths.extract_text(pages).collect()
    texts = {(r["page_id"], r["url"], r["n_chars"]): r["text"] for r in found}
    want = "Title & more\nFirst para, with text.\nSecond — para boldtext; it goes on and on, really."
    assert texts[1, "u", len(want)] == want and texts[3, "v", 10] == "plain text" and texts[2, None, 0] == "" and texts[3, "v", 0] == ""
    assert texts[None, "w", 3] == "a\nb" and (4, "x", 599_999) in texts
    assert tag_paths.extract_text(pages.limit(0)).count() == 0


def test_articles_of_the_pages(spark, sf_dir):
    import html

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in QUERIES["op6_tag_path_ratios"](spark, sf_dir).collect():
        article = re.search(r"<article>(.*?)</article>", pages[r["page_id"]], re.S)[1]
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " ")))).strip() for b in re.split(r"</?(?:p|h1)>", article)]
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


LONG = "A long sentence of the page, with words; and more of them, as pages have. " * 12
PLAIN_LAYOUTS = [
    (f"<body><div><h1>Title</h1><div class=text><p>{LONG}<p>{LONG}</div></div></body>", ["Title", LONG, LONG]),
    (f"<body><div><div><h1><b>Title</b></h1></div><div class=text><p>{LONG}<p>{LONG}</div></div></body>", ["Title", LONG, LONG]),
    (f"<body><div><p>{LONG * 6}</p></div><h2>More</h2><div><p>{LONG[:74]}</p></div></body>", [LONG * 6, "More", LONG[:74]]),
    (f"<body><div><p>What follows</p><ul><li>{LONG}<li>{LONG}</ul></div></body>", ["What follows", LONG, LONG]),
    (f"<body><div>What follows<blockquote><p>{LONG}<p>{LONG}</blockquote><p>So said</div></body>", ["What follows", LONG, LONG, "So said"]),
    (f"<body><p>What follows</p><table><tr><th>Head<tr><td>Short<tr><td>{LONG * 6}</table></body>", ["What follows", "Head", "Short", LONG * 6]),
    (f"<body><main><h1>Title</h1><article><p>{LONG}</article></main></body>", ["Title", LONG]),
    (f"<body><h1>Site</h1><article><p>{LONG}</article></body>", [LONG]),
]


def test_main_text_without_article():
    for page, want in PLAIN_LAYOUTS:
        assert tag_paths.content_blocks(page) == [w.strip() for w in want], page[:80]
    links = "<div><a>Home</a></div>" * 8
    assert tag_paths.content_blocks(f"<body>{links}<div class=text><p>{LONG}<p>{LONG}<p>{LONG}</div></body>")[-3:] == [LONG.strip()] * 3


def test_main_text_without_head_end():
    body = f"<body><p>{LONG}</body>"
    for head in ("<head><title>T</title>", "<head><meta charset=utf-8><title>T <b> x</title><script>1</script>", "<head><noscript><img src=x></noscript><title>T"):
        assert tag_paths.content_blocks(f"<html>{head}{body}</html>") == [LONG.strip()], head
    assert tag_paths.content_blocks(f"<head><title>T</title><p>{LONG}") == [LONG.strip()]
    assert tag_paths.content_blocks(f"<head><title>T</title>\n{LONG}") == [LONG.strip()]
    assert tag_paths.content_blocks("<head><title>T</title></head><body></body>") == []


def test_many_matches_in_one_text(spark):
    """Positions of many matches take time in proportion: runs of sums, not one growing list."""
    import time

    n = 16_000
    text = "".join(f"é token={'x' * 8}{i:06d};" for i in range(n))
    rows = spark.createDataFrame([(1, text)], "doc_id long, text string")
    start = time.perf_counter()
    spans = rows.select(F.expr(f"size({secret_scan._matches('text', secret_scan.ASSIGN, 2)})"), F.expr(secret_scan._matches("text", secret_scan.ASSIGN, 2)).alias("s")).first()
    assert spans[0] == n and time.perf_counter() - start < 8
    size = len(text) // n
    assert [(x["start"], x["end"]) for x in spans["s"]] == [(i * size + 2, (i + 1) * size - 1) for i in range(n)]


def plain_ngrams(text):
    """All n-grams of a text in order, by size."""
    line = " ".join("".join(c if ord(c) > 127 or c.isalnum() else " " for c in text.lower()).split(" ")).strip(" ")
    while "  " in line:
        line = line.replace("  ", " ")
    line = f" {line} " if line else " "
    return {n: [line[i : i + n] for i in range(len(line) - n + 1)] for n in toxicity.SIZES}


def test_toxicity_equals_a_plain_version(spark, sf_dir):
    """Counts, chosen n-grams and scores by dictionaries of strings."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels, features=500)
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    code_of, grams = {}, {}
    for i, text in texts.items():
        own = set()
        for n, some in plain_ngrams(text).items():
            codes = toxicity.ngram_codes(text, sizes=(n,)).tolist()
            assert len(codes) == len(some)
            for gram, code in zip(some, codes):
                assert code_of.setdefault(gram, code) == code
            own |= set(some)
        grams[i] = own
    assert len(set(code_of.values())) == len(code_of)
    import zlib

    known = {}
    for r in labels.where("toxic IS NOT NULL").collect():
        if zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1 and r["doc_id"] in texts:
            known[r["doc_id"]] = max(known.get(r["doc_id"], 0), r["toxic"])
    p, q = {}, {}
    for i, toxic in known.items():
        held = p if toxic else q
        for gram in grams[i]:
            held[gram] = held.get(gram, 0) + 1
    n_p, n_q = sum(known.values()), len(known) - sum(known.values())
    assert model.rows == n_p + n_q
    chi = {}
    for gram in {*p, *q}:
        a, b = p.get(gram, 0), q.get(gram, 0)
        if a + b >= toxicity.LEAST_DOCS:
            cross = a * (n_q - b) - b * (n_p - a)
            chi[code_of[gram]] = cross * cross * (n_p + n_q) / max((a + b) * (n_p + n_q - a - b) * n_p * n_q, 1)
    last = sorted(chi.values(), reverse=True)[499]
    chosen = set(model.codes.tolist())
    assert len(chosen) == 500 and all((c in chosen) == (v > last) for c, v in chi.items() if abs(v - last) > 1e-9 * last)
    weight = dict(zip(model.codes.tolist(), model.weights.tolist()))
    scores = {r["doc_id"]: r["score"] for r in model.score(docs).collect()}
    for i, own in grams.items():
        margin = model.intercept + sum(weight.get(code_of[g], 0.0) for g in own)
        assert scores[i] == pytest.approx(1 / (1 + math.exp(-margin)), rel=1e-9)
