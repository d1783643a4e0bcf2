"""Class balancing by synthetic rows between near neighbours of the same class."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowcairn.functions.numeric import quoted
from flowcairn.operators.neighbors import NeighborSearch, knn_join, vector_of
from flowcairn.operators.ordering import shuffled_rank
from flowcairn.operators.splits import uniform
from flowcairn.session import cut_lineage, scratch

NEIGHBORS = 5
PASS_ROWS, MOST_PASSES = 1 << 21, 8  # base rows whose neighbours are looked for at a time; every pass deals all references


def resample(
    df: DataFrame,
    features: list[str],
    label: str,
    keys: list[str],
    method: str = "SMOTE",
    seed: int = 42,
    neighbors: int = NEIGHBORS,
    **join_options,
) -> DataFrame:
    """Raise every class to the size of the largest one; for training rows only.

    SMOTE spreads the missing rows evenly over the rows of a class in seeded order; ADASYN gives more
    to rows whose neighbourhood holds other classes. With fewer than ``neighbors + 1`` rows in the
    smallest class the table is returned unchanged. Synthetic rows carry NULL outside features and
    label. Counting the classes is an action.
    """
    if method not in ("SMOTE", "ADASYN"):
        raise ValueError(f"unknown resampling method {method!r}")
    counts = {r[0]: r[1] for r in df.groupBy(quoted(label)).count().collect()}  # one row per class
    if len(counts) < 2 or min(counts.values()) < neighbors + 1:
        return df
    target = max(counts.values())
    rows = df.withColumn("_id", F.concat_ws("|", *[F.col(quoted(c)).cast("string") for c in keys])).select(
        "_id", F.col(quoted(label)).alias("_label"), vector_of(features).alias("_x")
    )
    out = df
    for name, count in counts.items():
        need = target - count
        if need == 0:
            continue
        with scratch(df.sparkSession) as keep:
            for made in _synthetic(df, rows, features, label, name, (need, count), method, seed, neighbors, join_options, keep):
                out = out.unionByName(made, allowMissingColumns=True)
    return out


def _synthetic(df, rows, features, label, name, sizes, method, seed, neighbors, join_options, keep):
    """The new rows of one class, as tables: one up to ``PASS_ROWS`` base rows, beyond it several of equal shares of them.

    A pass finds the neighbours of its bases, draws the rows and drops what it wrote for that.
    """
    need, count = sizes
    members = rows.where(F.col("_label").eqNullSafe(F.lit(name)))
    if method == "ADASYN":
        shares = _adasyn_copies(members, rows, name, need, neighbors, join_options)
        bases = shares if shares is not None else _even_copies(members, need, count, seed)
    else:
        bases = _even_copies(members, need, count, seed)
    bases = cut_lineage(bases.where(F.col("_copies") > 0))  # read by every step of the join, and again for the draws
    search = NeighborSearch(members, neighbors, "_id", "_x", skip_self=True, **join_options)
    passes = min(MOST_PASSES, -(-count // PASS_ROWS))
    types = dict(df.dtypes)

    def drawn(some: DataFrame) -> DataFrame:
        draws = (
            some.join(search.lists(some, "_id", "_x"), F.col("_id") == F.col("query_id"))
            .select("_id", "_x", "near", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))).alias("_copy"))
            .withColumn("_u", uniform(["_id"], seed, F.col("_copy")))
            .withColumn("_pick", F.pmod(F.xxhash64("_id", "_copy", F.lit(seed + 1)), F.size("near")).cast("int"))
            .select("_x", "_u", F.col("near")[F.col("_pick")]["neighbor_id"].alias("_other"))
            .join(members.select(F.col("_id").alias("_other"), F.col("_x").alias("_y")), "_other")
        )
        return draws.select(
            *[F.expr(f"_x[{i}] + _u * (_y[{i}] - _x[{i}]) AS {quoted(c)}") for i, c in enumerate(features)],
            F.lit(name).cast(types[label]).alias(label),
        )

    for number in range(passes):
        with scratch(df.sparkSession):  # nothing here holds the plan of a pass, so its shuffles go with it
            yield keep(drawn(bases if passes == 1 else bases.where(F.pmod(F.xxhash64("_id", F.lit(seed + 2)), F.lit(passes)) == number)))


def _even_copies(members: DataFrame, need: int, count: int, seed: int) -> DataFrame:
    ranked = shuffled_rank(members, ["_id"], seed, None, "_rank", None)
    extra = (F.col("_rank") <= need % count).cast("int")
    return ranked.withColumn("_copies", F.lit(need // count) + extra).drop("_rank")


def _adasyn_copies(members, rows, name, need, neighbors, join_options):
    """Copies in proportion to the share of foreign neighbours; None when no row has one."""
    near = knn_join(members, rows, neighbors, "_id", "_id", "_x", ("_label",), skip_self=True, **join_options)
    foreign = near.groupBy("query_id").agg(
        F.avg((~F.col("_label").eqNullSafe(F.lit(name))).cast("double")).alias("_foreign")
    )
    foreign = cut_lineage(foreign)  # a number per row, read for the sum and for the copies; the search is the dear part
    total = foreign.agg(F.sum("_foreign")).first()[0]
    if not total:
        return None
    return members.join(foreign, members["_id"] == foreign["query_id"]).select(
        "_id", "_label", "_x", F.rint(F.col("_foreign") / F.lit(total) * need).alias("_copies")
    )
