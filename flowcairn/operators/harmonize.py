"""Harmonize two feeds to one numeric schema, and fuse them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowcairn.functions.labels import attack_label, ddos_label, keep_binary_types
from flowcairn.functions.numeric import as_number, numeric_columns, quoted
from flowcairn.operators.matching import match_columns, required_features
from flowcairn.operators.quantiles import medians
from flowcairn.operators.stats import column_stats

NUMERIC_SHARE = 0.8


def _numbers(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    types = dict(df.dtypes)
    return df.select(*[as_number(source, text=types[source] == "string").alias(name) for name, source in pairs])


def _numeric_shares(df: DataFrame, names: list[str]) -> tuple[int, dict[str, int]]:
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(quoted(c)).alias(f"k{i}") for i, c in enumerate(names)]).first()
    return row["n"], {c: row[f"k{i}"] for i, c in enumerate(names)}


def harmonize(
    multi: DataFrame,
    single: DataFrame,
    label_multi: str | None = None,
    label_single: str | None = None,
    mapping: DataFrame | None = None,
    only_binary_types: bool = True,
    impute: bool = True,
    mode: str = "exact",
) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both feeds with the same numeric features and a binary ``label``, and the feature names.

    A mapped feature is kept when more than 80 % of the rows are numeric in *both* feeds. ``impute``
    fills gaps with the feed's own median over all rows; leave it off when a later stage imputes from
    training rows. Costs one count aggregate and one quantile pass per feed.
    """
    if only_binary_types and "type" in single.columns:
        single = keep_binary_types(single, require_rows=True)
    if mapping is None:
        mapping = match_columns(single, multi)
    rows = required_features(mapping).select("unified_name", "multi_name", "single_name").collect()  # schema-sized
    pairs: dict[str, tuple[str, str]] = {}
    for r in rows:
        if r["multi_name"] in multi.columns and r["single_name"] in single.columns:
            pairs[r["unified_name"]] = (r["multi_name"], r["single_name"])
    names = list(pairs)
    parts = []
    for df, side in ((multi, 0), (single, 1)):
        parts.append(_numbers(df, [(n, pairs[n][side]) for n in names]))
    shares = [_numeric_shares(p, names) for p in parts]
    kept = [n for n in names if all(k[n] > NUMERIC_SHARE * total for total, k in shares)]
    out = []
    for df, side, label in (
        (multi, 0, attack_label(multi, label_multi)),
        (single, 1, ddos_label(single, label_single)),
    ):
        types = dict(df.dtypes)
        columns = {n: as_number(pairs[n][side], text=types[pairs[n][side]] == "string") for n in kept}
        if impute and kept:
            middle = medians(_numbers(df, [(n, pairs[n][side]) for n in kept]), kept, mode, finite=False)
            columns = {n: F.coalesce(c, F.lit(middle[n])) for n, c in columns.items()}
        out.append(df.select(*[c.alias(n) for n, c in columns.items()], label.alias("label")))
    return out[0], out[1], kept


def fuse(multi: DataFrame, single: DataFrame) -> DataFrame:
    """UNION ALL of the shared columns in name order, tagged with ``dataset_source`` 0 and 1."""
    shared = sorted(set(multi.columns) & set(single.columns) - {"dataset_source"})
    tagged = [
        df.select(*[quoted(c) for c in shared], F.lit(tag).alias("dataset_source")) for df, tag in ((multi, 0), (single, 1))
    ]
    return tagged[0].unionByName(tagged[1])


def fused_features(fused: DataFrame) -> list[str]:
    """Numeric features of a fused table."""
    return numeric_columns(fused, exclude=("label", "dataset_source"))


def concat(tables: list[DataFrame]) -> DataFrame:
    """UNION ALL by name; columns a table lacks are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def feature_ranges(multi: DataFrame, single: DataFrame, features: list[str]) -> DataFrame:
    """Statistics of every feature in both feeds, for a look at the scales."""
    tagged = [
        column_stats(df, features).withColumn("dataset_source", F.lit(tag)) for df, tag in ((multi, 0), (single, 1))
    ]
    return tagged[0].unionByName(tagged[1])


def shared_values(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Set algebra on a column of two tables: every value with its presence on either side."""
    marked = a.select(quoted(column)).distinct().withColumn("in_a", F.lit(1)).unionByName(
        b.select(quoted(column)).distinct().withColumn("in_b", F.lit(1)), allowMissingColumns=True
    )
    return marked.groupBy(quoted(column)).agg(
        F.max(F.coalesce("in_a", F.lit(0))).alias("in_a"), F.max(F.coalesce("in_b", F.lit(0))).alias("in_b")
    ).withColumn(
        "kind",
        F.when((F.col("in_a") == 1) & (F.col("in_b") == 1), "both").when(F.col("in_a") == 1, "only_a").otherwise("only_b"),
    )
