"""Registered queries of the corpus operators, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op10_concat_and_cut")
def concat_and_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 ids, one row per piece."""
    from flowcairn.llm.packing import pack

    pieces = pack(table(spark, sf_dir, "documents"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


@query("op3_simple8b_tokens")
def simple8b_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents, written and read back."""
    from flowcairn.llm.simple8b import read_tokens, write_tokens

    folder, manifest = write_tokens(table(spark, sf_dir, "documents"))
    return read_tokens(folder, manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op9_warc_chunks")
def warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of all pages, written and read back as chunk rows; the last chunk has the whole payload's digest."""
    from flowcairn.llm.warc_chunks import read_archives, write_archives

    folder, files = write_archives(table(spark, sf_dir, "pages"))
    last = read_archives(folder, files, keep_data=False).where("is_last")
    return last.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLES["op9_warc_chunks"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest AS d, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first IS NOT NULL AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON d = payload_digest AND payload_bytes >= 100
"""


@query("op7_benchmark_ngrams")
def benchmark_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap of every whole document with windows of ten benchmark words."""
    from flowcairn.llm.decontaminate import find_overlap, overlap_report

    return overlap_report(find_overlap(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


@query("op1_secret_battery")
def secret_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole document: base patterns and random strings."""
    from flowcairn.llm.secret_scan import find_secrets, span_text

    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    of_kind = [
        F.expr(f"CAST(size(filter(base_spans, x -> x.kind = {i})) AS BIGINT)").alias(f"n_{kind}")
        for i, kind in enumerate(["assign", "access", "hex"])
    ]
    return found.select(
        "doc_id", *of_kind, F.sha2(span_text("base_spans"), 256).alias("base_sha256"), span_text("spans").alias("spans")
    )


@query("op2_toxic_ngrams")
def toxic_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole document, from a classifier fitted outside the held-out third."""
    from flowcairn.llm.toxicity import fit, learnable

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = fit(docs, table(spark, sf_dir, "labels")).score(docs)
    return scored.select(
        "doc_id", (F.col("doc_id").isNotNull() & ~learnable()).alias("held_out"), "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


@query("op8_token_group_matrix")
def token_group_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose five-word shingles are at least 80 % alike."""
    from flowcairn.llm.jaccard_groups import similarity_components

    return similarity_components(table(spark, sf_dir, "documents"))


@query("op5_prefix_forest")
def prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of every twentieth vector."""
    from flowcairn.llm.prefix_forest import search

    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(rows, rows.where(F.col("vec_id") % 20 == 0))


@query("op6_tag_path_ratios")
def tag_path_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    from flowcairn.llm.tag_paths import extract_text

    return extract_text(table(spark, sf_dir, "pages"))


FIRST_DAY, DAYS = "2020-01-01", 1461


def listed_entries(pages: DataFrame) -> DataFrame:
    """Dated entries made from the pages' own hosts and paths by their md5: they grow with the pages."""
    from flowcairn.llm.url_lists import url_host

    number = lambda c: F.conv(F.substring(F.md5(c), 1, 4), 16, 10).cast("int")
    day = lambda v: F.date_add(F.lit(FIRST_DAY).cast("date"), v.cast("int"))
    part = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)", 1)
    hosts = pages.where("url IS NOT NULL").select(url_host("url").alias("host"), part.alias("part")).where("host <> ''").distinct()
    v = F.col("v")
    single = hosts.select("host").distinct().withColumn("v", number(F.col("host"))).where(v % 3 == 0)
    steps = F.array(*[F.struct(F.lit(k).alias("after"), F.lit(a).alias("action")) for k, a in ((0, "add"), (200, "remove"), (500, "add"))])
    malware = single.select(F.lit("malware").alias("list"), F.lit("block").alias("effect"), F.col("host").alias("key"), "v", F.explode(steps).alias("s"))
    malware = malware.select("list", "effect", "key", day(v % DAYS + F.col("s.after")).alias("day"), F.col("s.action").alias("action"))
    domain = hosts.select(F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1).alias("key")).where("key <> ''").distinct()
    policy = domain.select(F.lit("policy").alias("list"), F.lit("block").alias("effect"), "key", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("i"))
    policy = policy.select("list", "effect", "key", day(F.col("i") * 60).alias("day"), F.when(F.col("i") % 2 == 0, "add").otherwise("remove").alias("action"))
    allow = hosts.where("part <> ''").select(F.concat_ws("/", "host", "part").alias("key")).distinct().withColumn("v", number(F.col("key"))).where(v % 2 == 0)
    allow = allow.select(F.lit("allow").alias("list"), F.lit("allow").alias("effect"), "key", day(v % DAYS).alias("day"), F.lit("add").alias("action"))
    return malware.unionByName(policy).unionByName(allow)


@query("op4_temporal_lists")
def temporal_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as of its fetch day against dated lists; days come from the md5 of the URL."""
    from flowcairn.llm.url_lists import active_entries

    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    fetched = F.date_add(F.lit(FIRST_DAY).cast("date"), (F.conv(F.substring(F.md5("url"), 1, 6), 16, 10).cast("int") % DAYS).cast("int"))
    found = active_entries(pages.withColumn("fetched", fetched), listed_entries(pages))
    active = F.array_join(F.transform("active", lambda x: F.concat_ws(":", x["key"], x["list"], x["effect"])), ",")
    return found.select("page_id", "url", F.col("fetched").cast("string").alias("fetched"), "n_active", active.alias("active"), "blocked")


ORACLES["op4_temporal_lists"] = r"""
WITH h AS (
  SELECT page_id, url, DATE '2020-01-01' + (('0x' || substr(md5(url), 1, 6))::INT % 1461)::INT AS fetched,
         regexp_replace(lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?(\[[^\]/?#@]*\]|[^/:?#@\[\]]+)', 1)), '\.+$', '') AS host,
         [x FOR x IN string_split(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1), '/') IF x <> ''] AS parts,
         regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)', 1) AS part
  FROM pages),
l AS (SELECT *, string_split(host, '.') AS labels FROM h),
hosts AS (SELECT DISTINCT host, part FROM h WHERE host <> '' AND url IS NOT NULL),
entries AS (
  SELECT 'malware' AS list, 'block' AS effect, host AS key, DATE '2020-01-01' + (v % 1461 + after)::INT AS day, action FROM
    (SELECT DISTINCT host, ('0x' || substr(md5(host), 1, 4))::INT AS v FROM hosts),
    (VALUES (0, 'add'), (200, 'remove'), (500, 'add')) s(after, action) WHERE v % 3 = 0
  UNION ALL
  SELECT 'policy', 'block', key, DATE '2020-01-01' + (i * 60)::INT, CASE WHEN i % 2 = 0 THEN 'add' ELSE 'remove' END FROM
    (SELECT DISTINCT regexp_extract(host, '([^.]+\.[^.]+)$', 1) AS key FROM hosts), range(24) r(i) WHERE key <> ''
  UNION ALL
  SELECT 'allow', 'allow', key, DATE '2020-01-01' + (v % 1461)::INT, 'add' FROM
    (SELECT key, ('0x' || substr(md5(key), 1, 4))::INT AS v FROM (SELECT DISTINCT host || '/' || part AS key FROM hosts WHERE part <> '')) WHERE v % 2 = 0),
spans AS (SELECT list, effect, key, action, day AS since, lead(day) OVER (PARTITION BY list, key ORDER BY day) AS until FROM entries),
keys AS (
  SELECT DISTINCT url, fetched, unnest(CASE WHEN host = '' THEN [] ELSE list_concat(
      CASE WHEN len(labels) <= 2 OR regexp_matches(host, '^(\[.*\]|[0-9]+(\.[0-9]+){3})$') THEN [host] ELSE [array_to_string(labels[i:], '.') FOR i IN range(1, len(labels))] END,
      [host || '/' || array_to_string(parts[1:i], '/') FOR i IN range(1, len(parts) + 1)]) END) AS key
  FROM l WHERE url IS NOT NULL),
met AS (
  SELECT url, fetched, count(*) AS n_active, string_agg(key || ':' || list || ':' || effect, ',' ORDER BY key, list, effect) AS active,
         arg_max(effect = 'block', length(key) * 2 + CAST(effect = 'block' AS INT)) AS blocked
  FROM keys JOIN spans USING (key) WHERE action = 'add' AND since <= fetched AND (until IS NULL OR fetched < until) GROUP BY url, fetched)
SELECT h.page_id, h.url, CAST(h.fetched AS VARCHAR) AS fetched, coalesce(n_active, 0) AS n_active, coalesce(active, '') AS active, coalesce(blocked, false) AS blocked
FROM h LEFT JOIN met ON h.url = met.url
"""


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLES["op7_benchmark_ngrams"] = rf"""
WITH items AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
grams AS (SELECT DISTINCT item_id, n, unnest([array_to_string(w[i:i + n - 1], ' ') FOR i IN range(1, len(w) - n + 2)]) AS g
          FROM (SELECT item_id, w, least(10, len(w)) AS n FROM items WHERE len(w) > 0)),
docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
starts AS (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM grams)),
hits AS (SELECT doc_id, i, s.n, item_id FROM (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM starts) s JOIN grams USING (n, g)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(listed, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)
"""

ORACLES["op8_token_group_matrix"] = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]
                                          WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
r AS (SELECT a AS node, b AS other FROM l UNION SELECT r.node, l.b FROM r JOIN l ON r.other = l.a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(first, doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT node AS doc_id, min(other) AS first FROM r GROUP BY node) USING (doc_id)
"""


@query("op11_fingerprint_collocations", rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, m, unnest([array_to_string(w[i:i + m - 1], ' ') FOR i IN range(1, len(w) - m + 2)]) AS phrase FROM w, (SELECT unnest([1, 2, 3, 4]) AS m)),
f AS (SELECT lang, m, phrase, count(*) AS f, string_split(phrase, ' ') AS w FROM g GROUP BY lang, m, phrase HAVING count(*) >= 30),
cuts AS (SELECT lang, m, phrase, f AS a, w, k, array_to_string(w[1:k], ' ') AS x, array_to_string(w[k + 1:], ' ') AS y FROM f, range(1, 4) r(k) WHERE k < m),
scored AS (SELECT c.lang, c.m, c.phrase, c.a, min({{'score': CAST(2000000 * CAST(c.a AS HUGEINT) // (l.f + r.f) AS BIGINT), 'k': k, 'l': l.f, 'r': r.f}}) AS cut
           FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = x JOIN f r ON r.lang = c.lang AND r.phrase = y GROUP BY ALL),
inside AS (SELECT lang, sub, max(f) AS outer_f FROM (
             SELECT lang, f, unnest([array_to_string(w[i:i + s - 1], ' ') FOR i IN range(1, m - s + 2)]) AS sub FROM f, range(2, 4) r(s) WHERE s < m) GROUP BY lang, sub),
kept AS (SELECT s.lang, phrase, a, cut.l AS l, cut.r AS r, cut.score AS score FROM scored s LEFT JOIN inside i ON i.lang = s.lang AND sub = phrase
         WHERE outer_f IS NULL OR 100 * CAST(outer_f AS HUGEINT) < 80 * CAST(a AS HUGEINT)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
""")
def fingerprint_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases of two to four words whose parts go together, of every language."""
    from flowcairn.llm.collocations import collocations

    return collocations(table(spark, sf_dir, "documents"))


@query("op12_pareto_mix", r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                  (CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(source, '') || '|' || coalesce(text, '') || '|12'), 1, 12) AS BIGINT) AS DOUBLE)
                   + 0.5::DOUBLE) / 281474976710656::DOUBLE AS random FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS s, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS w FROM d GROUP BY source),
o AS (SELECT *, 3 * s AS most, row_number() OVER (ORDER BY 3 * s / w, source NULLS LAST) AS i FROM s),
c AS (SELECT *, sum(s) OVER () AS words, sum(most) OVER (ORDER BY i) - most AS full_words, sum(w) OVER () - (sum(w) OVER (ORDER BY i) - w) AS rest FROM o),
k AS (SELECT min(i) AS first_open FROM c WHERE CAST(words - full_words AS DOUBLE) * w / rest <= most),
l AS (SELECT words - full_words AS left_words, rest FROM c, k WHERE i = first_open),
t AS (SELECT source AS t_source, s, CASE WHEN i < first_open THEN CAST(most AS DOUBLE) ELSE CAST(left_words AS DOUBLE) * w / rest END AS target FROM o, k, l),
e AS (SELECT d.*, s AS source_size, target, CASE WHEN s > 0 THEN least(3.0::DOUBLE, target * 1.0::DOUBLE / CAST(s AS DOUBLE)) ELSE 0.0::DOUBLE END AS expected
      FROM d JOIN t ON source IS NOT DISTINCT FROM t_source),
f AS (SELECT *, floor(expected) AS sure, expected - floor(expected) AS chance FROM e),
q AS (SELECT *, (random / (1 - random)) / (chance / (1 - chance)) AS odds FROM f WHERE chance > 0 AND size > 0),
r AS (SELECT *, floor(odds / (1 + odds) * 281474976710656::DOUBLE) AS rank FROM q),
n AS (SELECT source AS n_source, (sum(CAST(floor(size * chance * 1048576::DOUBLE) AS HUGEINT)) + 524288) // 1048576 AS lack FROM r GROUP BY source),
u AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY rank, doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM r),
x AS (SELECT u.*, CASE WHEN upto < lack THEN 1 WHEN upto - size < lack AND 2 * (lack - (upto - size)) >= size THEN 1 ELSE 0 END AS extra
      FROM u JOIN n ON source IS NOT DISTINCT FROM n_source)
SELECT doc_id, size, source_size, target, CAST((sure + extra) * size AS BIGINT) AS taken FROM x
UNION ALL SELECT doc_id, size, source_size, target, CAST(sure * size AS BIGINT) FROM f WHERE NOT (chance > 0 AND size > 0)
""")
def pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document go into a mix of all sources."""
    from flowcairn.llm.pareto_mix import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op13_token_alignment")
def token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links between two tokenizers' tokens for every document."""
    from flowcairn.llm.alignment import align

    return align(table(spark, sf_dir, "documents"))
