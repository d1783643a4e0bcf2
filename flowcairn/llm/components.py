"""Connected components of a table of links: stars inside tasks first, then repeated contraction."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowcairn.llm.shared import materialise

LOCAL_LINKS = 500_000  # links that a task joins at once


def _stars(batches):
    """Links of a task become links of each node to the smallest one it reaches there."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while (up := root.setdefault(top, top)) != top:
            top = up
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    def found() -> pd.DataFrame:
        pairs = [(x, top) for x in list(root) if (top := find(x)) != x]
        root.clear()
        return pd.DataFrame(pairs, columns=["a", "b"], dtype="int64")

    n = 0
    for batch in batches:
        for a, b in zip(batch["a"].tolist(), batch["b"].tolist()):
            x, y = find(a), find(b)
            if x != y:
                root[max(x, y)] = min(x, y)
        n += len(batch)
        if n >= LOCAL_LINKS:
            yield found()
            n = 0
    yield found()


def _unfinished(stars: DataFrame) -> bool:
    """Whether a node has two centres, or a centre has one itself."""
    ends = stars.selectExpr("a AS x", "b AS centre").union(stars.selectExpr("b", "CAST(NULL AS BIGINT)"))
    seen = ends.groupBy("x").agg(F.min("centre").alias("low"), F.max("centre").alias("high"), F.count_if(F.col("centre").isNull()).alias("leaves"))
    return not seen.where("low <> high OR (low IS NOT NULL AND leaves > 0)").isEmpty()


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for every node that has a link to another.

    Tasks turn the links they hold, a bounded number at a time, into stars; few links are done then. What
    is left goes through rounds of contraction. In every round each node moves to the neighbour, or itself,
    that comes first in a hashed order of that round; links inside a new node vanish. Rounds grow with the
    logarithm of the longest chain, since the order is another one each time. Moves are tables in the
    shared folder and are followed for all nodes at the end.
    """
    edges = links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b").distinct()
    edges = materialise(edges, "edges")
    tasks = edges.count() // LOCAL_LINKS + 1
    edges = materialise(edges.coalesce(tasks).mapInPandas(_stars, "a long, b long"), "stars")
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("at")).union(edges.select("b", "b")).distinct()
    if not _unfinished(edges):
        return nodes.select("node", F.col("at").alias("component"))
    nodes = materialise(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("at", F.col("node")), "nodes")
    turn, followed = 0, []
    while not edges.isEmpty():
        turn += 1
        both = edges.union(edges.select("b", "a"))
        order = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("h"), F.col(c).alias("v"))
        first = both.groupBy("a").agg(F.min(order("b")).alias("other")).withColumn("own", order("a"))
        moves = materialise(first.select(F.col("a").alias("old"), F.least("other", "own")["v"].alias("new")), "moves")
        followed.append(moves)
        moved = edges.join(moves.withColumnsRenamed({"old": "a", "new": "na"}), "a").join(moves.withColumnsRenamed({"old": "b", "new": "nb"}), "b")
        edges = materialise(moved.where("na <> nb").select(F.col("na").alias("a"), F.col("nb").alias("b")).distinct(), "edges")
    for moves in followed:
        nodes = nodes.join(moves.withColumnRenamed("old", "at"), "at", "left").select("node", F.coalesce("new", "at").alias("at"))
    nodes = materialise(nodes, "nodes")
    least = nodes.groupBy("at").agg(F.min("node").alias("component"))
    return nodes.join(least, "at").select("node", "component")
