"""Ranks and running sums over whole tables without a single-task window.

Both primitives work on two levels. Rows fall into buckets that follow the sort order; one small
aggregate gives the total per bucket, a window over those totals gives each bucket its offset, and
the row-level window then runs inside (group, bucket). A label that holds most of the rows is
therefore spread over as many tasks as there are buckets.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowcairn.functions.numeric import INF, finite_sql, is_finite, quoted


def row_token(keys: list[str], seed: int) -> Column:
    """Seeded, engine-independent shuffle order: md5 of the key columns and the seed."""
    parts = [F.coalesce(F.col(quoted(k)).cast("string"), F.lit("")) for k in keys]
    return F.md5(F.concat_ws("|", *parts, F.lit(str(seed))))


def _hex_digits(df: DataFrame) -> int:
    """Digits of the token used as bucket: a few buckets per shuffle partition."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(32, math.ceil(math.log(max(4 * partitions, 2), 16))))


def shuffled_rank(
    df: DataFrame,
    keys: list[str],
    seed: int = 42,
    group: list[str] | None = None,
    rank: str = "rank",
    size: str | None = "size",
) -> DataFrame:
    """Number rows 1..n inside each group in seeded random order; ``size`` is the group's row count.

    ``keys`` must identify a row. Tokens are uniform, so buckets of equal token prefix are even.
    """
    group = group or []
    digits = _hex_digits(df)
    token = df.withColumn("_token", row_token(keys, seed)).withColumns(
        {"_bucket": F.substring("_token", 1, digits), "_token": F.unhex("_token")}  # 16 bytes in the same order
    )
    grouped = [F.col(quoted(g)) for g in group]
    counts = token.groupBy(*grouped, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    ahead = W.partitionBy(*grouped) if group else W.partitionBy(F.lit(0))
    counts = counts.select(
        *[c.alias(f"_g{i}") for i, c in enumerate(grouped)],
        F.col("_bucket").alias("_b"),
        F.coalesce(
            F.sum("_n").over(ahead.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
        ).alias("_offset"),
        F.sum("_n").over(ahead).alias("_size"),
    )
    match = F.col("_bucket") == F.col("_b")
    for i, c in enumerate(grouped):
        match = match & c.eqNullSafe(F.col(f"_g{i}"))
    inside = W.partitionBy(*grouped, "_bucket").orderBy("_token", *[F.col(quoted(k)) for k in keys])
    numbered = token.join(counts, match).withColumn(
        rank, (F.col("_offset") + F.row_number().over(inside)).cast("long")
    )
    out = [F.col(quoted(c)) for c in df.columns] + [F.col(rank)]
    if size:
        out.append(F.col("_size").alias(size))
    return numbered.select(*out)


def bucket_edges(df: DataFrame, columns: list[str], buckets: int) -> dict[str, list[float]]:
    """Inner bucket edges per column from approximate quantiles: one aggregate, bounded result."""
    shares = ", ".join(f"{i / buckets!r}D" for i in range(1, buckets))
    accuracy = max(10_000, 10 * buckets)
    row = df.agg(
        *[
            F.expr(
                f"percentile_approx(CASE WHEN {finite_sql(c)} THEN {quoted(c)} END, array({shares}), {accuracy}) AS e{i}"
            )
            for i, c in enumerate(columns)
        ]
    ).first()
    return {c: sorted(set(row[f"e{i}"] or [])) for i, c in enumerate(columns)}


def with_buckets(
    df: DataFrame, edges: dict[str, list[float]], suffix: str = "_bucket"
) -> DataFrame:
    """Add the bucket number of each column; a value equal to an edge opens the next bucket.

    Missing values get the number after the last one.
    """
    cols = list(edges)
    splits = [[-INF, *e, INF] if e else [-INF, 0.0, INF] for e in edges.values()]
    stage = Bucketizer(
        splitsArray=splits,
        inputCols=cols,
        outputCols=[c + suffix for c in cols],
        handleInvalid="keep",
    )
    typed = df.withColumns({c: F.expr(f"CAST({quoted(c)} AS DOUBLE)") for c in cols})
    return stage.transform(typed).withColumns({c + suffix: F.expr(f"CAST({quoted(c + suffix)} AS INT)") for c in cols})


def bucket_count(df: DataFrame) -> int:
    """Buckets for value-ordered work: follows the configured shuffle width."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(16, 2 * partitions)


def running_sums(
    df: DataFrame, group: list[str], bucket: str, order: str, sums: dict[str, str], prefix: bool = True
) -> DataFrame:
    """Inclusive running sums in ``order`` inside each group.

    ``bucket`` must be monotone in ``order``, and ``order`` unique inside a group.
    ``sums`` maps the output column to the summed column. ``prefix=False`` runs from the far end.
    """
    far = F.asc if prefix else F.desc
    keys = [*group, bucket]
    totals = df.groupBy(*keys).agg(*[F.sum(c).alias(f"_t{i}") for i, c in enumerate(sums.values())])
    before = (W.partitionBy(*group) if group else W.partitionBy(F.lit(0))).orderBy(far(bucket)).rowsBetween(
        W.unboundedPreceding, -1
    )
    offsets = totals.select(
        *keys,
        *[F.coalesce(F.sum(f"_t{i}").over(before), F.lit(0)).alias(f"_o{i}") for i in range(len(sums))],
    )
    inside = W.partitionBy(*keys).orderBy(far(order)).rowsBetween(W.unboundedPreceding, 0)
    out = df.join(offsets, keys)
    return out.select(
        *df.columns,
        *[
            (F.col(f"_o{i}") + F.sum(source).over(inside)).alias(name)
            for i, (name, source) in enumerate(sums.items())
        ],
    )


def global_rank(df: DataFrame, score: str, name: str, rank: str = "rank", seed: int = 42) -> DataFrame:
    """Rank 1..n by descending score over the whole table; equal scores in seeded order of ``name``.

    Distinct scores get their offset from two-level running sums, rows of one score are numbered by
    token buckets, so neither a long table nor one frequent score ends up in a single task.
    Rows without a finite score come last, in seeded order. Fitting the score buckets is one aggregate.
    """
    valued = df.where(F.coalesce(is_finite(score), F.lit(False))).withColumn("_score", -F.col(quoted(score)).cast("double"))
    edges = bucket_edges(valued, ["_score"], bucket_count(df))
    counts = with_buckets(valued.select("_score"), edges).groupBy("_score_bucket", "_score").agg(
        F.count(F.lit(1)).alias("_n")
    )
    offsets = running_sums(counts, [], "_score_bucket", "_score", {"_upto": "_n"}).select(
        "_score", (F.col("_upto") - F.col("_n")).alias("_before")
    )
    numbered = shuffled_rank(valued, [name], seed, ["_score"], "_inside", None)
    ranked = numbered.join(offsets, "_score").select(
        *[F.col(quoted(c)) for c in df.columns], (F.col("_before") + F.col("_inside")).alias(rank)
    )
    rest = shuffled_rank(df.where(~F.coalesce(is_finite(score), F.lit(False))), [name], seed, None, rank, None)
    return ranked.unionByName(rest.withColumn(rank, F.col(rank) + F.lit(valued.count())))
