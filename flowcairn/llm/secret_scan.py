"""Secret scans: fixed patterns plus a randomness test battery with false-discovery control.

Everything runs as built-in expressions over whole texts. Candidates are runs of at least 20 letters,
digits and ``+ / _ -``. No alphabet has both ``+ /`` and ``_ -``; a run that mixes them is cut at the one
pair and at the other, and its parts of at least 20 are candidates in its place, so that a key behind a
path is tested whichever pair the path or the key has. Of parts found inside each other the longest
counts. Each candidate is read in the smallest alphabet that has all its characters and tested:

* chi-squared uniformity over the alphabet, one-sided;
* the runs test on lower and upper half of the alphabet, two-sided;
* lag-one serial correlation of alphabet positions, two-sided.

A candidate counts as random unless the three, with Bonferroni's correction, reject it at ``ALPHA``.
Ordinary text is the null hypothesis of a discovery: its p-value is the chance that a text of the same
length stays in the alphabet and repeats its characters as rarely. Benjamini-Hochberg control at level
``Q`` runs over all candidates of the corpus, for each doubling of length apart, since long strings are
far easier to tell from text than short ones. P-values are binned, so the control is one small
aggregate and its result a dozen numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Fixed by the contract: the three base kinds.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"  # runs are maximal, so shorter matches are those that would be dropped
HEX = r"[0-9a-f]{32,}"
KINDS = ["assign", "access", "hex", "random"]

CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
# Parts of a run that mixes both pairs of signs.
PARTS = [r"[A-Za-z0-9_-]{20,}", r"[A-Za-z0-9+/]{20,}"]
# Alphabets from small to large; a candidate is read in the first that holds it.
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ALPHABETS = [
    ("hex", DIGITS + "abcdef", "^(?=.*[a-f])[0-9a-f]+$"),
    ("upper hex", DIGITS + "ABCDEF", "^(?=.*[A-F])[0-9A-F]+$"),
    ("base32", UPPER + "234567", "^[A-Z2-7]*[A-Z][A-Z2-7]*$"),
    ("base36", DIGITS + LOWER, "^[0-9a-z]*[a-z][0-9a-z]*$"),
    ("upper base36", DIGITS + UPPER, "^[0-9A-Z]*[A-Z][0-9A-Z]*$"),
    ("base62", DIGITS + UPPER + LOWER, "^[0-9A-Za-z]*[A-Za-z][0-9A-Za-z]*$"),
    ("base64", UPPER + LOWER + DIGITS + "+/", "^[0-9A-Za-z+/]*[A-Za-z][0-9A-Za-z+/]*$"),
    ("base64url", UPPER + LOWER + DIGITS + "-_", "^[0-9A-Za-z_-]*[A-Za-z][0-9A-Za-z_-]*$"),
]
# Ordinary text: the chance that two, and three, of its letters agree, and that a letter is one of a to f.
PAIR_AGREES, TRIPLE_AGREES, A_TO_F = 0.066, 0.0054, 0.3
ALPHA, Q = 0.001, 0.01
BIN, LEAST_LOG = 0.05, -200.0
MOST_BAND = 12

SPAN = "array<struct<start:bigint,end:bigint,token:string>>"


def _literal(pattern: str) -> str:
    return "r'" + pattern.replace("'", r"\x27") + "'"


RUN = 128  # numbers added up one after another; a longer list is added up run by run


def _with(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` standing for ``value``, computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _running(numbers: str) -> str:
    """Running sums of an array of numbers. A sum that appends to its own result copies it every time, so
    only short runs are added up that way; what lies before a run is added afterwards."""
    runs = f"transform(sequence(0, CAST((size(n_) - 1) DIV {RUN} AS INT)), r_ -> slice(n_, r_ * {RUN} + 1, {RUN}))"
    add = "aggregate({0}, CAST({1} AS array<bigint>), (s_, v_) -> array_append(s_, coalesce(try_element_at(s_, -1), 0L) + {2}))"
    inside = f"transform({runs}, x_ -> {add.format('x_', 'array()', 'v_')})"
    before = add.format("w_", "array(0L)", "element_at(v_, -1)")
    whole = f"flatten(zip_with(w_, slice({before}, 1, size(w_)), (x_, o_) -> transform(x_, v_ -> v_ + o_)))"
    return _with(numbers, "n_", _with(inside, "w_", whole))


def _matches(text: str, pattern: str, group: int = 0) -> str:
    """Spans of leftmost non-overlapping matches: positions from the lengths of matches and of what is between."""
    p = _literal(pattern)
    pieces, found = f"split({text}, {p}, -1)", f"regexp_extract_all({text}, {p}, 0)"
    own, tokens = "transform(f_, x_ -> CAST(length(x_) AS BIGINT))", "f_" if group == 0 else f"regexp_extract_all({text}, {p}, {group})"
    steps = f"zip_with(slice({pieces}, 1, size(f_)), f_, (a_, b_) -> CAST(length(a_) + length(b_) AS BIGINT))"
    placed = f"zip_with({_running(steps)}, {own}, (e_, l_) -> named_struct('start', e_ - l_, 'end', e_))"
    spans = f"zip_with({placed}, {tokens}, (x_, t_) -> named_struct('start', x_.start, 'end', x_.end, 'token', t_))"
    return f"CASE WHEN {text} RLIKE {p} THEN {_with(found, 'f_', spans)} ELSE CAST(array() AS {SPAN}) END"


def _parts(found: str) -> str:
    """The runs, with those that no alphabet holds replaced by their parts."""
    parts = [
        f"transform({_matches('w.token', p)}, v -> named_struct('start', w.start + v.start, 'end', w.start + v.end, 'token', v.token))"
        for p in PARTS
    ]
    return f"""flatten(transform({found}, w -> CASE WHEN w.token RLIKE '[+/]' AND w.token RLIKE '[_-]' THEN concat({', '.join(parts)})
      ELSE array(w) END))"""


def _log_tail(z: str) -> str:
    """Logarithm of the upper tail of the normal distribution, to seven digits anywhere."""
    # Coefficients of the rational Chebyshev fit of erfc.
    terms = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]
    t = f"(1D / (1D + 0.5D * abs({z}) / sqrt(2D)))"
    poly = "0D"
    for c in reversed(terms):
        poly = f"({c}D + {t} * {poly})"
    log_erfc = f"(ln({t}) - {z} * {z} / 2D + {poly})"
    return f"(CASE WHEN {z} >= 0 THEN ln(0.5D) + {log_erfc} ELSE ln(1D - 0.5D * exp({log_erfc})) END)"


def _battery(found: Column | str = "__found") -> Column:
    """Candidates with their alphabet and the logarithms of the two p-values."""
    case = " ".join(f"WHEN x.token RLIKE '{pattern}' THEN {i}" for i, (_, _, pattern) in enumerate(ALPHABETS))
    names = "array(" + ", ".join(f"'{alphabet}'" for _, alphabet, _ in ALPHABETS) + ")"
    known = f"""filter(transform({found}, x -> named_struct('start', x.start, 'end', x.end, 'token', x.token,
      'n', CAST(length(x.token) AS DOUBLE), 'kind', CASE {case} END)), x -> x.kind IS NOT NULL)"""
    read = f"transform({known}, x -> named_struct('x', x, 'a', {names}[x.kind], 'k', CAST(length({names}[x.kind]) AS DOUBLE)))"
    half = "translate(y.x.token, y.a, concat(repeat('0', CAST(y.k / 2 AS INT)), repeat('1', CAST(y.k - floor(y.k / 2) AS INT))))"
    counted = f"""transform({read}, y -> named_struct('x', y.x, 'k', y.k,
      'squares', aggregate(sequence(1, CAST(y.k AS INT)), 0D, (s, i) -> s + pow(y.x.n - length(replace(y.x.token, substr(y.a, i, 1), '')), 2)),
      'ones', CAST(length(replace({half}, '0', '')) AS DOUBLE),
      'runs', CAST(length(regexp_replace({half}, '0+|1+', 'x')) AS DOUBLE),
      'at', transform(split(y.x.token, ''), c -> CAST(instr(y.a, c) AS DOUBLE))))"""
    centred = f"transform({counted}, y -> named_struct('y', y, 'mean', aggregate(y.at, 0D, (s, v) -> s + v) / y.x.n, 'm', 2 * y.ones * (y.x.n - y.ones)))"
    scores = f"""transform({centred}, c -> named_struct('x', c.y.x,
      'chi', (c.y.k / c.y.x.n * c.y.squares - c.y.x.n - (c.y.k - 1)) / sqrt(2 * (c.y.k - 1) * (c.y.x.n - 1) / c.y.x.n),
      'runs', coalesce((c.y.runs - c.m / c.y.x.n - 1) / nullif(sqrt(abs(c.m * (c.m - c.y.x.n) / (c.y.x.n * c.y.x.n * (c.y.x.n - 1)))), 0D), 40D),
      'serial', coalesce(sqrt(c.y.x.n) * (1 / c.y.x.n
        + aggregate(zip_with(slice(c.y.at, 1, size(c.y.at) - 1), slice(c.y.at, 2, size(c.y.at) - 1), (p, q) -> (p - c.mean) * (q - c.mean)), 0D, (s, v) -> s + v)
        / nullif(aggregate(c.y.at, 0D, (s, v) -> s + (v - c.mean) * (v - c.mean)), 0D)), 40D),
      'text', ({PAIR_AGREES}D * c.y.x.n * (c.y.x.n - 1) / 2 - (c.y.squares - c.y.x.n) / 2)
        / sqrt(c.y.x.n * (c.y.x.n - 1) / 2 * {PAIR_AGREES * (1 - PAIR_AGREES)}D + c.y.x.n * (c.y.x.n - 1) * (c.y.x.n - 2) * {TRIPLE_AGREES - PAIR_AGREES**2}D),
      'stays', CASE WHEN c.y.x.kind <= 1 THEN c.y.x.n * ln({A_TO_F}D) ELSE 0D END))"""
    least = f"least({_log_tail('s.chi')}, ln(2D) + {_log_tail('abs(s.runs)')}, ln(2D) + {_log_tail('abs(s.serial)')})"
    return F.expr(f"""transform({scores}, s -> named_struct('start', s.x.start, 'end', s.x.end, 'token', s.x.token, 'encoding', s.x.kind,
      'band', least({MOST_BAND}, CAST(floor(log2(s.x.n)) AS INT)),
      'random', least(0D, ln(3D) + {least}),
      'text', greatest({LEAST_LOG}D, s.stays + {_log_tail('s.text')})))""")


def with_candidates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows with ``__base`` (kind, start, end) and ``__found`` (tested candidates) added."""
    rows = docs.withColumn("__text", F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    kinds = []
    for number, (pattern, group) in enumerate([(ASSIGN, 2), (ACCESS, 0), (HEX, 0)]):
        keep = "x -> length(x.token) >= 8" if group else "x -> true"
        kinds.append(f"transform(filter({_matches('__text', pattern, group)}, {keep}), x -> named_struct('start', x.start, 'kind', {number}, 'end', x.end))")
    rows = rows.withColumn("__base", F.expr(f"array_sort(concat({', '.join(kinds)}))"))
    return rows.withColumn("__found", F.expr(_parts(_matches("__text", CANDIDATE)))).withColumn("__found", _battery())


def discovery_limits(candidates: DataFrame, q: float = Q) -> dict[int, int]:
    """For each length band, the last p-value bin that Benjamini-Hochberg accepts over all candidates."""
    tested = candidates.where("size(__found) > 0").select(F.explode("__found").alias("x"))
    bins = tested.groupBy(F.col("x.band").alias("band"), F.floor(F.col("x.text") / BIN).cast("int").alias("bin")).count()
    upto = W.partitionBy("band").orderBy("bin")  # at most 4,000 bins a band
    ranked = bins.select("band", "bin", F.sum("count").over(upto).alias("k"), F.sum("count").over(W.partitionBy("band")).alias("m"))
    accepted = ranked.where((F.col("bin") + 1) * BIN <= F.log(F.lit(q)) + F.log(F.col("k") / F.col("m")))
    return {r["band"]: r["limit"] for r in accepted.groupBy("band").agg(F.max("bin").alias("limit")).collect()}


def find_secrets(docs: DataFrame, text_col: str = "text", alpha: float = ALPHA, q: float = Q, prefix: str = "") -> DataFrame:
    """The rows with ``base_spans`` and ``spans`` (after ``prefix``) added: arrays of (start, kind, end) in code points.

    ``kind`` numbers ``KINDS``. Base spans are those of the three patterns; ``spans`` adds discoveries
    that lie in no base span, as kind ``random``. Two passes read the texts: the first counts p-values
    for the false-discovery limits, the second applies them.

    Null texts are empty and have no spans; a text of any length is scanned whole; repeated rows count
    once each; an empty table gives no rows. Columns of the added names are replaced, all others stay;
    __text, __base and __found are reserved.
    """
    rows = with_candidates(docs, text_col)
    limits = discovery_limits(with_candidates(docs.select(text_col), text_col), q)
    if not limits:
        added = F.expr("CAST(array() AS array<struct<start:bigint,kind:int,end:bigint>>)")
    else:
        limit = "CASE x.band " + " ".join(f"WHEN {b} THEN {v}" for b, v in sorted(limits.items())) + " END"
        new = f"""filter(__found, x -> x.random >= ln({alpha}D) AND floor(x.text / {BIN}D) <= {limit}
          AND NOT exists(__base, b -> b.start <= x.start AND b.end >= x.end))"""
        # By start, the longer first: what ends no further than an earlier one lies inside it.
        placed = f"array_sort(transform({new}, x -> named_struct('start', x.start, 'back', -x.end)))"
        state = "struct<reach:bigint,out:array<struct<start:bigint,kind:int,end:bigint>>>"
        added = F.expr(f"""aggregate({placed}, CAST(named_struct('reach', 0L, 'out', array()) AS {state}), (s, x) -> CAST(
          CASE WHEN -x.back <= s.reach THEN s ELSE named_struct('reach', -x.back, 'out', array_append(s.out,
            named_struct('start', x.start, 'kind', 3, 'end', -x.back))) END AS {state}), s -> s.out)""")
    spans = rows.withColumn(f"{prefix}base_spans", F.col("__base")).withColumn(f"{prefix}spans", F.array_sort(F.concat("__base", added)))
    return spans.drop("__text", "__base", "__found")


def span_text(spans: str) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return F.expr(f"array_join(transform({spans}, x -> concat({names}[x.kind], ':', x.start, ':', x.end)), ',')")


def redact(found: DataFrame, text_col: str = "text", mark: str = "[secret]", prefix: str = "") -> DataFrame:
    """``find_secrets`` rows with every span, or union of overlapping spans, replaced by ``mark``."""
    state = "struct<pos:bigint,out:string>"
    text = f"`{text_col}`"
    rebuilt = f"""aggregate(`{prefix}spans`, CAST(named_struct('pos', 0L, 'out', '') AS {state}), (s, x) -> CAST(
        CASE WHEN x.end <= s.pos THEN s
             WHEN x.start < s.pos THEN named_struct('pos', x.end, 'out', s.out)
             ELSE named_struct('pos', x.end, 'out', concat(s.out, substring({text}, CAST(s.pos + 1 AS INT), CAST(x.start - s.pos AS INT)), '{mark}')) END
        AS {state}), s -> concat(s.out, substring({text}, CAST(s.pos + 1 AS INT))))"""
    return found.withColumn(text_col, F.when(F.size(f"{prefix}spans") > 0, F.expr(rebuilt)).otherwise(F.col(text_col))).drop(f"{prefix}base_spans", f"{prefix}spans")
