"""Cleaning, scaling, encoding, selection, splits, folds and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowcairn.catalog.bindings import FEATURES, event_features, lineitem, wide_vectors
from flowcairn.catalog.registry import query, rounded, sql_round, table
from flowcairn.functions.numeric import quoted
from flowcairn.operators import splits
from flowcairn.operators.balancing import resample
from flowcairn.operators.cleaning import Cleaner, Encoder, RobustScaler, StandardScaler, narrow_types
from flowcairn.operators.information import mutual_information, select_top_k
from flowcairn.operators.neighbor_information import neighbor_information
from flowcairn.operators.preparation import PrepareConfig, prepare, stateless
from flowcairn.plans.phases import with_key

_R = sql_round
KEYS = ["l_orderkey", "l_linenumber"]


def _with_gaps(spark, sf_dir):
    """Line items with infinities and gaps: price per discount and per tax are undefined at zero."""
    price = F.col("l_extendedprice")
    return table(spark, sf_dir, "lineitem").select(
        *KEYS,
        "l_extendedprice",
        F.when(F.col("l_discount") == 0, F.lit(float("inf")))
        .otherwise(F.try_divide(price, F.col("l_discount")))
        .alias("per_discount"),
        F.try_divide(price, F.col("l_tax")).alias("per_tax"),
        F.lit(None).cast("double").alias("empty"),
    )


_GAPS_SQL = """
  SELECT l_orderkey, l_linenumber, l_extendedprice,
         CASE WHEN l_discount = 0 THEN 'infinity'::DOUBLE ELSE l_extendedprice / l_discount END AS per_discount,
         CASE WHEN l_tax = 0 THEN NULL ELSE l_extendedprice / l_tax END AS per_tax
  FROM lineitem
"""
_GAP_COLUMNS = ["l_extendedprice", "per_discount", "per_tax"]


@query(
    "sanitize_clip",
    f"""WITH g AS ({_GAPS_SQL}),
        f AS (SELECT l_orderkey, l_linenumber, l_extendedprice,
                     CASE WHEN isinf(per_discount) THEN NULL ELSE per_discount END AS per_discount, per_tax FROM g),
        b AS (SELECT """
    + ", ".join(
        f"quantile_cont({c}, 0.001) AS {c}_lo, quantile_cont({c}, 0.999) AS {c}_hi" for c in _GAP_COLUMNS
    )
    + " FROM f) SELECT l_orderkey, l_linenumber, "
    + ", ".join(
        f"{_R(f'CASE WHEN {c} IS NULL THEN NULL ELSE least(greatest({c}, {c}_lo), {c}_hi) END', 4)} AS {c}"
        for c in _GAP_COLUMNS
    )
    + " FROM f, b",
)
def sanitize_clip(spark, sf_dir):
    """Infinity to missing, then clip to the 0.1 % and 99.9 % quantiles."""
    df = _with_gaps(spark, sf_dir)
    model = Cleaner(impute=False).fit(df, [*_GAP_COLUMNS, "empty"])
    out = model.transform(df, outliers=True)
    return out.select(*KEYS, *[rounded(c, 4).alias(c) for c in _GAP_COLUMNS])


@query(
    "sanitize_extremes",
    f"""WITH g AS ({_GAPS_SQL})
        SELECT l_orderkey, l_linenumber, {_R('''CASE WHEN isinf(per_discount) THEN
               (SELECT max(per_discount) FILTER (WHERE isfinite(per_discount)) FROM g) ELSE per_discount END''', 4)} AS per_discount
        FROM g""",
)
def sanitize_extremes(spark, sf_dir):
    """Infinity to the largest finite value."""
    df = _with_gaps(spark, sf_dir)
    model = Cleaner(inf_as_extreme=True, clip_quantiles=None, impute=False).fit(df, ["per_discount"])
    return model.transform(df).select(*KEYS, rounded("per_discount", 4).alias("per_discount"))


@query(
    "median_impute",
    f"""WITH g AS (SELECT l_orderkey, l_linenumber, l_extendedprice,
                          CASE WHEN isinf(per_discount) THEN NULL ELSE per_discount END AS per_discount, per_tax
                   FROM ({_GAPS_SQL}) x)
        SELECT l_orderkey, l_linenumber, """
    + ", ".join(f"{_R(f'coalesce({c}, (SELECT median({c}) FROM g))', 4)} AS {c}" for c in _GAP_COLUMNS)
    + " FROM g",
)
def median_impute(spark, sf_dir):
    """Medians of the present values for the missing ones; the empty column is dropped."""
    df = _with_gaps(spark, sf_dir)
    model = Cleaner(clip_quantiles=None).fit(df, [*_GAP_COLUMNS, "empty"])
    return model.transform(df).select(*KEYS, *[rounded(c, 4).alias(c) for c in _GAP_COLUMNS])


@query(
    "robust_scale",
    "WITH q AS (SELECT "
    + ", ".join(
        f"median({c}) AS {c}_m, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS {c}_i" for c in FEATURES
    )
    + " FROM lineitem) SELECT l_orderkey, l_linenumber, "
    + ", ".join(f"{_R(f'({c} - {c}_m) / CASE WHEN {c}_i = 0 THEN 1 ELSE {c}_i END')} AS {c}" for c in FEATURES)
    + " FROM lineitem, q",
)
def robust_scale(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(*KEYS, *FEATURES)
    out = RobustScaler().fit(df, FEATURES).transform(df)
    return out.select(*KEYS, *[rounded(c).alias(c) for c in FEATURES])


@query(
    "standard_scale",
    "WITH q AS (SELECT "
    + ", ".join(f"avg({c}) AS {c}_m, stddev_pop({c}) AS {c}_s" for c in FEATURES)
    + " FROM lineitem) SELECT l_orderkey, l_linenumber, "
    + ", ".join(f"{_R(f'({c} - {c}_m) / CASE WHEN {c}_s = 0 THEN 1 ELSE {c}_s END')} AS {c}" for c in FEATURES)
    + " FROM lineitem, q",
)
def standard_scale(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(*KEYS, *FEATURES)
    out = StandardScaler().fit(df, FEATURES).transform(df)
    return out.select(*KEYS, *[rounded(c).alias(c) for c in FEATURES])


@query(
    "label_encode",
    """SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS DOUBLE) AS priority_code,
              CAST(dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS DOUBLE) AS status_code FROM orders""",
)
def label_encode(spark, sf_dir):
    """Codes in sorted order of the values."""
    df = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_orderpriority").alias("priority_code"), F.col("o_orderstatus").alias("status_code")
    )
    return Encoder().fit(df, ["priority_code", "status_code"]).transform(df)


@query(
    "label_encode_wide",
    """SELECT c_custkey, CAST(dense_rank() OVER (ORDER BY c_name) - 1 AS DOUBLE) AS name_code FROM customer""",
)
def label_encode_wide(spark, sf_dir):
    """Codes of a column with a distinct value per row: by a joined table, not by literals."""
    df = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("name_code"))
    return Encoder(literal_values=10).fit(df, ["name_code"]).transform(df)


_TOKEN_SQL = "md5(concat_ws('|', CAST(event_id AS VARCHAR), '42'))"
_RANK_SQL = f"""
  SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY {_TOKEN_SQL}, event_id) AS rk,
         count(*) OVER (PARTITION BY event_type) AS n FROM events
"""


@query(
    "stratified_split",
    f"""SELECT event_id, event_type, CASE WHEN rk <= floor(n * 0.7::DOUBLE + 0.5) THEN 'train'
           WHEN rk <= floor(n * 0.85::DOUBLE + 0.5) THEN 'val' ELSE 'test' END AS split FROM ({_RANK_SQL}) r""",
)
def stratified_split(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("event_id", "event_type")
    return splits.stratified_split(df, "event_type", ["event_id"])


@query("stratified_kfold", f"SELECT event_id, event_type, CAST((rk - 1) % 5 AS INT) AS fold FROM ({_RANK_SQL}) r")
def stratified_kfold(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("event_id", "event_type")
    return splits.stratified_folds(df, "event_type", ["event_id"])


@query(
    "random_split",
    f"""SELECT event_id, CASE WHEN p < 0.8 THEN 'train' WHEN p < 0.9 THEN 'val' ELSE 'test' END AS split
        FROM (SELECT event_id, ('0x' || substr({_TOKEN_SQL}, 1, 13))::BIGINT / 4503599627370496.0 AS p FROM events)""",
)
def random_split(spark, sf_dir):
    """80/10/10 by hash of the key."""
    df = table(spark, sf_dir, "events").select("event_id")
    return splits.random_split(df, ["event_id"])


@query(
    "sample_exact",
    f"""SELECT event_id, value FROM events ORDER BY {_TOKEN_SQL}, event_id
        LIMIT (SELECT greatest(1, CAST(floor(count(*) * 0.1::DOUBLE) AS BIGINT)) FROM events)""",
)
def sample_exact(spark, sf_dir):
    """A tenth of the events, exact to the row: the sampling operator."""
    return splits.sample_exact(table(spark, sf_dir, "events"), ["event_id"], ratio=0.1).select("event_id", "value")


@query(
    "file_row_cap",
    f"""SELECT event_id, event_type FROM ({_RANK_SQL}) r WHERE rk <= 250""",
)
def file_row_cap(spark, sf_dir):
    """At most 250 rows per source: the row-cap operator."""
    df = table(spark, sf_dir, "events").select("event_id", "event_type")
    return splits.cap_per_source(df, "event_type", ["event_id"], 250)


def _mi_sql(columns: list[str], bins: int = 10) -> str:
    parts = []
    for c in columns:
        edges = ", ".join(f"quantile_cont({c}, {i / bins}::DOUBLE) AS e{i}" for i in range(1, bins))
        number = " + ".join(f"CAST({c} >= e{i} AS INT)" for i in range(1, bins))
        parts.append(
            f"""SELECT '{c}' AS feature, {number} AS bin, CAST(l_returnflag <> 'N' AS INT) AS label
                FROM lineitem, (SELECT {edges} FROM lineitem) q"""
        )
    return f"""
      SELECT feature, greatest(sum(k / n * ln(k * n / (b * l))), 0.0) AS mi FROM (
        SELECT feature, CAST(k AS DOUBLE) AS k, CAST(sum(k) OVER (PARTITION BY feature) AS DOUBLE) AS n,
               CAST(sum(k) OVER (PARTITION BY feature, bin) AS DOUBLE) AS b,
               CAST(sum(k) OVER (PARTITION BY feature, label) AS DOUBLE) AS l
        FROM (SELECT feature, bin, label, count(*) AS k FROM ({" UNION ALL ".join(parts)}) u GROUP BY ALL) t) w
      GROUP BY feature"""


@query("mutual_information", f"SELECT feature, {_R('mi', 8)} AS mutual_information FROM ({_mi_sql(FEATURES)}) m")
def mutual_information_of_features(spark, sf_dir):
    out = mutual_information(lineitem(spark, sf_dir), FEATURES, "label")
    return out.withColumn("mutual_information", rounded("mutual_information", 8))


@query(
    "select_top_k",
    f"""SELECT feature, count(*) AS rows FROM (SELECT feature FROM ({_mi_sql(FEATURES)}) m ORDER BY mi DESC LIMIT 2) k,
        lineitem GROUP BY feature""",
)
def select_features(spark, sf_dir):
    """The two most informative features, with the number of rows they are kept for."""
    df = lineitem(spark, sf_dir)
    kept = select_top_k(df, FEATURES, "label", 2)
    return df.select(*kept).unpivot([], kept, "feature", "v").groupBy("feature").agg(F.count(F.lit(1)).alias("rows"))


_NEIGHBOR_FEATURES = {"value": "value", "user": "CAST(user_id AS DOUBLE)", "hour": "fmod(epoch_us(CAST(ts AS TIMESTAMP)) / 1e6, 86400.0) / 3600.0"}


def _neighbor_information_sql(features: dict[str, str], k: int = 3) -> str:
    """The estimator by brute force: every row against every row of its feature."""
    columns = " UNION ALL ".join(f"SELECT '{name}' AS feature, event_type AS label, event_id, CAST({x} AS DOUBLE) AS x, u FROM e" for name, x in features.items())
    beside = ", ".join(f"x - lag(x, {i}) OVER c, lead(x, {i}) OVER c - x" for i in range(1, k + 1))
    return f"""
      WITH e AS (SELECT *, CAST(CAST('0x' || substr(md5(CAST(event_id AS VARCHAR) || '|42'), 1, 12) AS BIGINT) AS DOUBLE) / 140737488355328.0::DOUBLE - 1.0::DOUBLE AS u FROM events),
      long AS (SELECT * FROM ({columns}) t WHERE x IS NOT NULL AND label IS NOT NULL),
      scale AS (SELECT feature AS f, pow(2, floor(log2(greatest(stddev_pop(x), avg(abs(x)))))) AS scale FROM long GROUP BY feature),
      p AS (SELECT feature, label, event_id, x + u * (1e-10::DOUBLE * scale) AS x, count(*) OVER (PARTITION BY feature, label) AS nc FROM long JOIN scale ON f = feature),
      w AS (SELECT *, list_sort([{beside}], 'ASC', 'NULLS LAST')[least({k}, nc - 1)] AS r FROM p WHERE nc > 1
            WINDOW c AS (PARTITION BY feature, label ORDER BY x)),
      m AS (SELECT a.feature, a.event_id, a.nc, count(*) AS m, CASE WHEN a.r > 0 THEN least({k}, a.nc - 1) ELSE count(*) FILTER (WHERE a.label = b.label) END AS k
            FROM w a JOIN w b ON a.feature = b.feature AND abs(b.x - a.x) < CASE WHEN a.r > 0 THEN a.r ELSE 1e-300 END GROUP BY a.feature, a.event_id, a.nc, a.label, a.r),
      psi AS (SELECT n, sum(CASE WHEN n > 1 THEN 1.0::DOUBLE / (n - 1) ELSE 0 END) OVER (ORDER BY n) - 0.5772156649015329 AS psi FROM range(1, (SELECT count(*) + 1 FROM events)) r(n)),
      total AS (SELECT feature, count(*) AS n FROM m GROUP BY feature)
      SELECT t.feature, greatest(pn.psi + avg(pk.psi) - avg(pc.psi) - avg(pm.psi), 0.0) AS mi
      FROM m JOIN total t ON t.feature = m.feature JOIN psi pn ON pn.n = t.n JOIN psi pk ON pk.n = m.k JOIN psi pc ON pc.n = m.nc JOIN psi pm ON pm.n = m.m
      GROUP BY t.feature, pn.psi"""


def _typed_events(spark, sf_dir):
    df, _ = event_features(spark, sf_dir)
    kinds = table(spark, sf_dir, "events").select("event_id", "event_type")
    return df.drop("label").join(kinds, "event_id")


@query("neighbor_information", f"SELECT feature, {_R('mi', 6)} AS mutual_information FROM ({_neighbor_information_sql(_NEIGHBOR_FEATURES)}) m")
def neighbor_information_of_features(spark, sf_dir):
    """Information of three event features about the event type, by nearest neighbours inside each type."""
    out = neighbor_information(_typed_events(spark, sf_dir), list(_NEIGHBOR_FEATURES), "event_type", ["event_id"])
    return out.withColumn("mutual_information", rounded("mutual_information", 6))


@query(
    "select_top_k_neighbors",
    f"""SELECT feature, count(*) AS rows, {_R('sum(x)', 3)} AS total FROM (
          SELECT 'value' AS feature, value AS x FROM events UNION ALL SELECT 'user', CAST(user_id AS DOUBLE) FROM events
          UNION ALL SELECT 'hour', {_NEIGHBOR_FEATURES['hour']} FROM events) v
        WHERE feature IN (SELECT feature FROM ({_neighbor_information_sql(_NEIGHBOR_FEATURES)}) m ORDER BY mi DESC, CASE feature WHEN 'value' THEN 0 WHEN 'user' THEN 1 ELSE 2 END LIMIT 2)
        GROUP BY feature""",
)
def select_features_by_neighbors(spark, sf_dir):
    """The two most informative of three event features by the neighbour estimate, with their sums over all rows."""
    df = _typed_events(spark, sf_dir)
    kept = select_top_k(df, list(_NEIGHBOR_FEATURES), "event_type", 2, keys=["event_id"])
    long = df.select(*kept).unpivot([], kept, "feature", "v")
    return long.groupBy("feature").agg(F.count(F.lit(1)).alias("rows"), rounded(F.sum("v"), 3).alias("total"))


def _survives(column: str) -> str:
    return f"CASE WHEN count(*) FILTER (WHERE CAST(CAST({column} AS FLOAT) AS DOUBLE) <> {column}) = 0 THEN '{column}' END"


@query(
    "narrow_types",
    f"""SELECT count(*) AS rows, count(DISTINCT l_orderkey) AS orders, sum(l_linenumber) AS line_sum,
              concat_ws(',', {', '.join(_survives(c) for c in ('l_discount', 'l_extendedprice', 'l_quantity', 'l_tax'))}) AS narrowed,
              {_R('sum(l_extendedprice)', 2)} AS price_sum, {_R('max(l_tax)', 12)} AS top_tax, 2 AS text_columns FROM lineitem""",
)
def narrowed(spark, sf_dir):
    """Smaller types where every value survives; the sums show that values stay equal."""
    df = table(spark, sf_dir, "lineitem")
    small, few = narrow_types(df)
    before, after = dict(df.dtypes), dict(small.dtypes)
    names = sorted(c for c in df.columns if (before[c], after[c]) == ("double", "float"))
    return small.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct("l_orderkey").alias("orders"),
        F.sum("l_linenumber").alias("line_sum"),
        F.lit(",".join(names)).alias("narrowed"),
        rounded(F.sum("l_extendedprice"), 2).alias("price_sum"),
        rounded(F.max("l_tax"), 12).alias("top_tax"),
        F.lit(len(few)).alias("text_columns"),
    )


@query("prepared_parts")
def prepared_parts(spark, sf_dir):
    """Split, clean, select, scale and balance the events; class counts per part."""
    df, names = event_features(spark, sf_dir)
    cfg = PrepareConfig(apply_feature_selection=True, feature_selection_k=3, apply_resampling=True)
    fitted, parts = prepare(df, names, "label", ["event_id"], cfg)
    out = None
    for name, part in parts.items():
        counts = part.groupBy("label").agg(
            F.count(F.lit(1)).alias("n"), *[F.avg(quoted(c)).alias(f"avg_{i}") for i, c in enumerate(fitted.features)]
        ).withColumn("part", F.lit(name))
        out = counts if out is None else out.unionByName(counts)
    return out


@query(
    "prepared_counts",
    """WITH c AS (SELECT CAST(event_type = 'error' AS INT) AS label, count(*) AS n FROM events GROUP BY 1),
            s AS (SELECT label, CAST(floor(n * 0.7::DOUBLE + 0.5) AS BIGINT) AS train, CAST(floor(n * 0.85::DOUBLE + 0.5) AS BIGINT) AS upto, n FROM c)
       SELECT 'train' AS part, label, (SELECT max(train) FROM s) AS n, 3 AS features, true AS finite FROM s
       UNION ALL SELECT 'val', label, upto - train, 3, true FROM s UNION ALL SELECT 'test', label, n - upto, 3, true FROM s""",
)
def prepared_counts(spark, sf_dir):
    """Rows per part and class after preparation: training classes are level, the others as they were split; all values finite."""
    df, names = event_features(spark, sf_dir)
    cfg = PrepareConfig(apply_feature_selection=True, feature_selection_k=3, apply_resampling=True)
    fitted, parts = prepare(df, names, "label", ["event_id"], cfg)
    out = None
    for name, part in parts.items():
        finite = F.coalesce(F.bool_and(F.expr(" AND ".join(f"abs({quoted(c)}) < double('Infinity')" for c in fitted.features))), F.lit(False))
        counts = part.groupBy("label").agg(F.count(F.lit(1)).alias("n"), finite.alias("finite")).select(
            F.lit(name).alias("part"), "label", "n", F.lit(len(fitted.features)).alias("features"), "finite"
        )
        out = counts if out is None else out.unionByName(counts)
    return out


_DIMENSIONS = 64
_VECTORS_SQL = "SELECT vec_id, CAST(label < 3 AS INT) AS label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings"
# Synthetic rows lie between rows of their class, so a class keeps the bounds of every feature.
_BOUNDS_SQL = f"""
  SELECT label, {_R('sum(low)', 4)} AS low_sum, {_R('sum(high)', 4)} AS high_sum FROM (
    SELECT label, i, min(x[i]) AS low, max(x[i]) AS high FROM ({_VECTORS_SQL}), range(1, {_DIMENSIONS + 1}) r(i) GROUP BY label, i) GROUP BY label
"""


def _balanced(df, names):
    """Rows per class and the sums of the lower and upper bounds of its features."""
    low = [F.min(quoted(c)).alias(f"l{i}") for i, c in enumerate(names)]
    high = [F.max(quoted(c)).alias(f"h{i}") for i, c in enumerate(names)]
    out = df.groupBy("label").agg(F.count(F.lit(1)).alias("n"), *low, *high)
    total = lambda side: rounded(sum((F.col(f"{side}{i}") for i in range(len(names))), F.lit(0.0)), 4)
    return out.select("label", "n", total("l").alias("low_sum"), total("h").alias("high_sum"))


@query(
    "smote",
    f"""SELECT label, (SELECT max(n) FROM (SELECT count(*) AS n FROM ({_VECTORS_SQL}) GROUP BY label)) AS n, low_sum, high_sum
        FROM ({_BOUNDS_SQL})""",
)
def smote(spark, sf_dir):
    """Balance the embedding classes below 3 against the others; every class keeps its feature bounds."""
    df, names = wide_vectors(spark, sf_dir)
    return _balanced(resample(df, names, "label", ["vec_id"]), names)


@query(
    "adasyn",
    f"""WITH v AS ({_VECTORS_SQL}), c AS (SELECT label, count(*) AS n FROM v GROUP BY label), m AS (SELECT max(n) AS n FROM c),
        near AS (SELECT q, own, other, row_number() OVER (PARTITION BY q ORDER BY distance, CAST(n AS VARCHAR)) AS rank FROM (
          SELECT a.vec_id AS q, b.vec_id AS n, a.label AS own, b.label AS other, list_distance(a.x, b.x) AS distance
          FROM v a JOIN v b ON a.vec_id <> b.vec_id JOIN c ON c.label = a.label WHERE c.n < (SELECT n FROM m))),
        far AS (SELECT q, own, avg(CAST(own <> other AS INT)) AS f FROM near WHERE rank <= 5 GROUP BY q, own),
        made AS (SELECT own, sum(round_even(f / t * need, 0)) AS n FROM (
          SELECT own, f, sum(f) OVER (PARTITION BY own) AS t, (SELECT n FROM m) - c.n AS need FROM far JOIN c ON c.label = own) GROUP BY own)
        SELECT label, CAST(c.n + coalesce(made.n, 0) AS BIGINT) AS n, low_sum, high_sum
        FROM c JOIN ({_BOUNDS_SQL}) USING (label) LEFT JOIN made ON own = label""",
)
def adasyn(spark, sf_dir):
    """Density-weighted balancing of the same classes."""
    df, names = wide_vectors(spark, sf_dir)
    return _balanced(resample(df, names, "label", ["vec_id"], "ADASYN"), names)


@query(
    "smote_duplicates",
    f"""SELECT label, max(n) OVER () AS n, low_sum, high_sum FROM (
          SELECT CAST(l_returnflag <> 'N' AS INT) AS label, count(*) AS n,
                 {_R(' + '.join(f'min({c})' for c in FEATURES), 4)} AS low_sum, {_R(' + '.join(f'max({c})' for c in FEATURES), 4)} AS high_sum
          FROM lineitem GROUP BY 1)""",
)
def smote_duplicates(spark, sf_dir):
    """Balance line items seen through four features alone, where many rows are equal."""
    keyed = with_key(lineitem(spark, sf_dir).select(*FEATURES, "label"))
    return _balanced(resample(keyed, list(FEATURES), "label", ["row_key"]), list(FEATURES))


@query(
    "stateless_profile",
    f"""WITH g AS ({_GAPS_SQL})
        SELECT count(*) AS rows, count(per_discount) AS discounts, count(per_tax) AS taxes,
               {_R("quantile_cont(coalesce(CASE WHEN isinf(per_discount) THEN (SELECT max(per_discount) FILTER (WHERE isfinite(per_discount)) FROM g) ELSE per_discount END, 0), 0.999)", 3)} AS discount_max
        FROM g""",
)
def stateless_profile(spark, sf_dir):
    """Clean and encode for storage: infinities become the largest value, gaps stay."""
    df = _with_gaps(spark, sf_dir).withColumn("label", F.lit(1))
    out = stateless(df, [*_GAP_COLUMNS, "empty"])
    return out.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count("per_discount").alias("discounts"),
        F.count("per_tax").alias("taxes"),
        rounded(F.max("per_discount"), 3).alias("discount_max"),
    )
