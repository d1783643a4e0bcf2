"""Counts, column statistics, correlations and timelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowcairn.catalog.bindings import FEATURES, MULTI_FILE_SQL, SCORED_EVENTS_SQL, lineitem, multi_file_feed, scored_events, wide_vectors
from flowcairn.catalog.registry import query, rounded, sql_round, table
from flowcairn.functions.numeric import as_number
from flowcairn.functions.ratios import MULTI_FILE, RATIO_COLUMNS, with_flow_ratios
from flowcairn.operators import stats
from flowcairn.operators.metrics import classification_by_group
from flowcairn.operators.splits import class_weights

_R = sql_round
_RATIOS_SQL = f"""
  SELECT *, (fwd_bytes + bwd_bytes) / greatest(duration, 1e-8) AS "Flow_Bytes_s",
         (fwd_packets + bwd_packets) / greatest(duration, 1e-8) AS "Flow_Packets_s",
         (fwd_bytes + bwd_bytes) / greatest(fwd_packets + bwd_packets, 1e-8) AS "Avg_Packet_Size",
         fwd_bytes / (bwd_bytes + 1e-8) AS "Traffic_Direction_Ratio", 0 AS dataset_source
  FROM ({MULTI_FILE_SQL}) f
"""


@query(
    "flow_ratios",
    "SELECT l_orderkey, l_linenumber, "
    + ", ".join(f'"{c}"' for c in RATIO_COLUMNS)
    + f", dataset_source FROM ({_RATIOS_SQL}) r",
)
def flow_ratios(spark, sf_dir):
    """Ratios of the multi-file feed."""
    df = with_flow_ratios(multi_file_feed(spark, sf_dir), MULTI_FILE)
    return df.select("l_orderkey", "l_linenumber", *RATIO_COLUMNS, "dataset_source")


@query(
    "ratio_validation",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, true AS present, count(*) AS total,
              count(*) FILTER (WHERE NOT coalesce(isfinite("{c}"), false)) AS non_finite,
              count(*) FILTER (WHERE isfinite("{c}") AND "{c}" <= 0) AS non_positive,
              {_R(f'count(*) FILTER (WHERE isfinite("{c}") AND "{c}" > 0) / CAST(count(*) AS DOUBLE)')} AS valid_ratio
            FROM ({_RATIOS_SQL}) r"""
        for c in RATIO_COLUMNS
    )
    + " UNION ALL SELECT 'Missing_Ratio', false, 0, 0, 0, 0.0",
)
def ratio_validation(spark, sf_dir):
    """Finite and positive share of every ratio, with one ratio that is absent."""
    df = with_flow_ratios(multi_file_feed(spark, sf_dir), MULTI_FILE)
    out = stats.ratio_validation(df, [*RATIO_COLUMNS, "Missing_Ratio"])
    return out.withColumn("valid_ratio", rounded("valid_ratio"))


@query(
    "class_distribution",
    f"""SELECT l_returnflag, l_linestatus, count(*) AS n,
           {_R('count(*) * 100.0 / (SELECT count(*) FROM lineitem)', 4)} AS pct
        FROM lineitem GROUP BY ALL""",
)
def class_distribution(spark, sf_dir):
    return stats.class_counts(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"]).withColumn(
        "pct", rounded("pct", 4)
    )


@query("attack_types", "SELECT DISTINCT event_type AS attack_type FROM events WHERE event_type IS NOT NULL")
def attack_types(spark, sf_dir):
    return stats.attack_types(table(spark, sf_dir, "events"), "event_type")


@query(
    "table_info",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, {i} AS position, count(*) AS rows,
                   count(*) - count({e}) AS missing FROM events"""
        for i, (c, e) in enumerate(
            [
                ("event_id", "event_id"),
                ("ts", "ts"),
                ("user_id", "user_id"),
                ("event_type", "event_type"),
                ("value", "value"),
                ("props", "try_cast(props AS DOUBLE)"),
            ]
        )
    ),
)
def table_info(spark, sf_dir):
    """Missing values per column; the JSON text is read as a number, so all of it is missing."""
    df = table(spark, sf_dir, "events").withColumn("props", as_number("props"))
    return stats.null_counts(df).select("column_name", "position", "rows", "missing")


@query(
    "column_stats",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, count({c}) AS n, min({c}) AS min, max({c}) AS max, {_R(f'avg({c})')} AS mean,
                   {_R(f'stddev_samp({c})')} AS std, {_R(f'max({c}) - min({c})')} AS range FROM lineitem"""
        for c in FEATURES
    ),
)
def column_stats(spark, sf_dir):
    out = stats.column_stats(table(spark, sf_dir, "lineitem"), FEATURES)
    return out.withColumns({c: rounded(c) for c in ("mean", "std", "range")})


@query(
    "corr_pairs",
    " UNION ALL ".join(
        f"SELECT '{a}' AS x, '{b}' AS y, {_R(f'corr({a}, {b})')} AS corr FROM lineitem"
        for i, a in enumerate(FEATURES)
        for b in FEATURES[i + 1 :]
    ),
)
def corr_pairs(spark, sf_dir):
    return stats.correlation(table(spark, sf_dir, "lineitem"), FEATURES).withColumn("corr", rounded("corr"))


@query(
    "gram_correlation",
    f"""WITH v AS (SELECT vec_id, unnest(range(0, 64)) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)
        SELECT 'x' || a.i AS x, 'x' || b.i AS y, {_R('corr(a.v, b.v)')} AS corr FROM v a JOIN v b ON a.vec_id = b.vec_id AND a.i < b.i GROUP BY a.i, b.i""",
)
def gram_correlation(spark, sf_dir):
    """All 2,016 pairs of 64 columns in one pass."""
    df, names = wide_vectors(spark, sf_dir)
    return stats.gram_correlation(df, names).withColumn("corr", rounded("corr"))


@query(
    "phase_timeline",
    f"""SELECT event_type AS phase, min(ts) AS start, max(ts) AS "end",
           CAST(epoch_us(max(ts)) - epoch_us(min(ts)) AS BIGINT) AS duration_us, {_R('avg(value)')} AS avg_value
        FROM events GROUP BY event_type""",
)
def phase_timeline(spark, sf_dir):
    out = stats.phase_timeline(table(spark, sf_dir, "events"), "event_type", "ts", ["value"])
    return out.withColumn("avg_value", rounded("avg_value"))


_FOLD_SQL = f"""
  SELECT algo, fold, tp, fp, fn, tn, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / CAST(tp + fp AS DOUBLE) END AS "precision",
         CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / CAST(tp + fn AS DOUBLE) END AS recall,
         CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2.0 * tp / (2 * tp + fp + fn) END AS f1,
         (tp + tn) / CAST(tp + fp + fn + tn AS DOUBLE) AS accuracy
  FROM (SELECT algo, fold, count(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp,
               count(*) FILTER (WHERE label = 0 AND prediction = 1) AS fp,
               count(*) FILTER (WHERE label = 1 AND prediction = 0) AS fn,
               count(*) FILTER (WHERE label = 0 AND prediction = 0) AS tn
        FROM ({SCORED_EVENTS_SQL}) s GROUP BY algo, fold) c
"""


@query(
    "fold_metrics",
    f"""SELECT algo, fold, tp, fp, fn, tn, {_R('"precision"')} AS "precision", {_R('recall')} AS recall,
               {_R('f1')} AS f1, {_R('accuracy')} AS accuracy FROM ({_FOLD_SQL}) m""",
)
def fold_metrics(spark, sf_dir):
    """Binary metrics per algorithm and fold in one pass over the predictions."""
    out = classification_by_group(scored_events(spark, sf_dir), ["algo", "fold"])
    return out.withColumns({c: rounded(c) for c in ("precision", "recall", "f1", "accuracy")})


@query(
    "fold_aggregation",
    "SELECT algo, count(*) AS folds, "
    + ", ".join(
        f'{_R(f"avg({chr(34)}{m}{chr(34)})")} AS {m}_mean, {_R(f"stddev_samp({chr(34)}{m}{chr(34)})")} AS {m}_std'
        for m in ("f1", "precision", "recall", "accuracy")
    )
    + f" FROM ({_FOLD_SQL}) m GROUP BY algo",
)
def fold_aggregation(spark, sf_dir):
    out = stats.fold_summary(classification_by_group(scored_events(spark, sf_dir), ["algo", "fold"]))
    return out.withColumns({c: rounded(c) for c in out.columns if c.endswith(("_mean", "_std"))})


_LONG_FOLDS_SQL = " UNION ALL ".join(
    f"""SELECT algo, '{m}' AS metric, "{m}" AS v FROM ({_FOLD_SQL}) m""" for m in ("f1", "precision", "recall", "accuracy")
)


@query(
    "fold_boxplot",
    "SELECT algo, metric, "
    + ", ".join(
        f"{_R(f'quantile_cont(v, {q}::DOUBLE)')} AS {n}"
        for q, n in ((0, "low"), (0.25, "q1"), (0.5, "median"), (0.75, "q3"), (1, "high"))
    )
    + f" FROM ({_LONG_FOLDS_SQL}) l GROUP BY algo, metric",
)
def fold_boxplot(spark, sf_dir):
    """Quartiles of the metrics over folds: the data of a box plot."""
    out = stats.box_stats(classification_by_group(scored_events(spark, sf_dir), ["algo", "fold"]))
    return out.withColumns({c: rounded(c) for c in ("low", "q1", "median", "q3", "high")})


@query(
    "best_fold",
    f"""SELECT algo, fold, {_R('f1')} AS f1 FROM ({_FOLD_SQL}) m
        QUALIFY row_number() OVER (PARTITION BY algo ORDER BY f1 DESC, fold) = 1""",
)
def best_fold(spark, sf_dir):
    """Best fold per algorithm by F1, ties to the smaller fold."""
    by_fold = classification_by_group(scored_events(spark, sf_dir), ["algo", "fold"]).select("algo", "fold", "f1")
    return stats.best_per_group(by_fold, ["algo"], "f1", "fold").withColumn("f1", rounded("f1"))


@query(
    "unpivot_metrics",
    "UNPIVOT (SELECT algo, fold, "
    + ", ".join(f'{_R(chr(34) + m + chr(34))} AS "{m}"' for m in ("f1", "precision", "recall", "accuracy"))
    + f' FROM ({_FOLD_SQL}) m) ON f1, "precision", recall, accuracy INTO NAME metric VALUE score',
)
def unpivot_metrics(spark, sf_dir):
    by_fold = classification_by_group(scored_events(spark, sf_dir), ["algo", "fold"])
    names = ["f1", "precision", "recall", "accuracy"]
    return by_fold.unpivot(["algo", "fold"], names, "metric", "score").withColumn("score", rounded("score"))


@query(
    "top_k_per_group",
    """SELECT l_returnflag, l_orderkey, l_linenumber, l_extendedprice, rank FROM (
         SELECT l_returnflag, l_orderkey, l_linenumber, l_extendedprice,
                row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, l_orderkey) AS rank
         FROM lineitem) t WHERE rank <= 15""",
)
def top_k_per_group(spark, sf_dir):
    """Fifteen dearest line items per flag: a top-k report."""
    return stats.top_k(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", "l_orderkey", 15).select(
        "l_returnflag", "l_orderkey", "l_linenumber", "l_extendedprice", "rank"
    )


@query(
    "class_weights",
    f"""SELECT l_returnflag, count(*) AS n,
          {_R('(SELECT count(*) FROM lineitem) / CAST((SELECT count(DISTINCT l_returnflag) FROM lineitem) * count(*) AS DOUBLE)')} AS weight
        FROM lineitem GROUP BY l_returnflag""",
)
def class_weight_table(spark, sf_dir):
    return class_weights(table(spark, sf_dir, "lineitem"), "l_returnflag").withColumn("weight", rounded("weight"))


@query(
    "coerce_profile",
    """SELECT count(*) AS rows, count(try_cast(event_type AS DOUBLE)) AS numeric_type,
              count(try_cast(json_extract_string(props, '$.k') AS DOUBLE)) AS numeric_k,
              max(try_cast(json_extract_string(props, '$.k') AS DOUBLE)) AS max_k FROM events""",
)
def coerce_profile(spark, sf_dir):
    """Coercion to numbers: text without a number becomes NULL."""
    df = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k"))
    numbers = df.select(as_number("event_type").alias("t"), as_number("k").alias("k"))
    return numbers.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count("t").alias("numeric_type"),
        F.count("k").alias("numeric_k"),
        F.max("k").alias("max_k"),
    )


@query("numeric_projection", f"SELECT l_orderkey, l_linenumber, {', '.join(FEATURES)}, CAST(l_returnflag <> 'N' AS INT) AS label FROM lineitem")
def numeric_projection(spark, sf_dir):
    """Numeric columns only, gaps as 0."""
    from flowcairn.functions.numeric import numeric_only

    df = lineitem(spark, sf_dir).drop("l_partkey", "l_suppkey")
    return numeric_only(df)
