"""Quantiles of many columns: exact with linear interpolation, or approximate from a sketch.

One aggregate counts all columns and sketches all wanted ranks. Short tables then take a second exact one.
On longer ones no task ever holds a column: the sketch brackets every rank, and a second aggregate counts
below each bracket and picks the value among the few inside. Where those would be too many for one
aggregate, or the sketch misplaced a rank, the bracket is narrowed round by round until its distinct
values are few. Each round shrinks a bracket about 2500-fold, so one or two rounds serve any table.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowcairn.functions.numeric import INF, quoted, sql_literal

SINGLE_PASS_ROWS = 50_000
COLUMNS_PER_AGGREGATE = 200
ACCURACY = 10_000  # rank error of the sketch: rows / ACCURACY
BRACKET_ROWS = 200_000
PICKED_VALUES = 20_000_000  # values inside all brackets that are gathered, in a group per bracket


def quantiles(
    df: DataFrame,
    columns: list[str],
    probs: list[float],
    mode: str = "exact",
    single_pass_rows: int = SINGLE_PASS_ROWS,
    finite: bool = True,
    bracket_rows: int = BRACKET_ROWS,
) -> dict[str, list[float | None]]:
    """Quantiles of the present values per column (an action); all-missing columns give None.

    ``finite`` leaves infinities out.
    """
    if not columns:
        return {}
    if mode not in ("exact", "approx"):
        raise ValueError(f"unknown quantile mode {mode!r}")
    test = "abs({0}) < double('Infinity')" if finite else "NOT isnan({0})"
    values = df.selectExpr(
        *[f"CASE WHEN {test.format(quoted(c))} THEN CAST({quoted(c)} AS DOUBLE) END AS {quoted(c)}" for c in columns]
    )
    if mode == "approx":
        return _one_aggregate(values, columns, probs, "percentile_approx")
    out: dict[str, list[float | None]] = {}
    for start in range(0, len(columns), COLUMNS_PER_AGGREGATE):
        part = columns[start : start + COLUMNS_PER_AGGREGATE]
        some = values.select(*[quoted(c) for c in part])
        n, rows, brackets = _sketched(some, part, probs)
        if n <= single_pass_rows:
            out.update(_one_aggregate(some, part, probs, "percentile"))
            continue
        found = _picked(some, brackets) if n * (6 / ACCURACY) * len(brackets) <= PICKED_VALUES and bracket_rows >= n * (6 / ACCURACY) else {}
        out.update({c: [_interpolated(found.get((c, p)), rows[c], p) for p in probs] for c in part})
        rest = [c for c in part if any(rows[c] and (c, p) not in found for p in probs)]
        if rest:
            out.update(_by_narrowing(some.select(*[quoted(c) for c in rest]), rest, probs, bracket_rows))
    return out


def _sketched(df: DataFrame, columns: list[str], probs: list[float]):
    """Row count, present values per column, and a bracket around the wanted ranks of each column and probability."""
    shares = ", ".join(sql_literal(x) for p in probs for x in (max(0.0, p - 2 / ACCURACY), min(1.0, p + 2 / ACCURACY)))
    aggregates = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(columns):
        aggregates += [F.expr(f"count({quoted(c)}) AS n{i}"), F.expr(f"percentile_approx({quoted(c)}, array({shares}), {ACCURACY}) AS s{i}")]
    row = df.agg(*aggregates).first()
    rows = {c: row[f"n{i}"] for i, c in enumerate(columns)}
    brackets = {}
    for i, c in enumerate(columns):
        for j, p in enumerate(probs):
            if rows[c]:
                at = p * (rows[c] - 1)
                brackets[c, p] = _Bracket(c, math.floor(at), math.ceil(at), row[f"s{i}"][2 * j], row[f"s{i}"][2 * j + 1], 0, rows[c])
    return row["n"], rows, brackets


def _picked(df: DataFrame, brackets: dict) -> dict:
    """The values at both ranks of every bracket that holds them, in one aggregate.

    Every task sorts its batches, counts below and at each bound and keeps the values inside. Values equal
    to a bound are only counted, so a frequent value is never gathered.
    """
    if not brackets:
        return {}
    asked: dict[str, list[tuple]] = {}
    for i, b in enumerate(brackets.values()):
        asked.setdefault(b.column, []).append((i, b.low, b.high, b.first, b.last))
    wanted, size = list(asked.values()), len(brackets)

    def counted(batches):
        counts, held = np.zeros((size, 3), dtype=np.int64), [[] for _ in range(size)]
        for batch in batches:
            for column, bounds in zip(batch.columns, wanted):
                x = np.sort(column.drop_null().to_numpy(zero_copy_only=False))
                for i, low, high, _, _ in bounds:
                    under, upto = np.searchsorted(x, low), np.searchsorted(x, low, "right")
                    before, over = np.searchsorted(x, high), np.searchsorted(x, high, "right")
                    counts[i] += under, upto, over
                    if before > upto:
                        held[i].append(x[upto:before].copy())
        rows = sorted(b for bounds in wanted for b in bounds)
        values = [np.concatenate(v) if v else np.zeros(0) for v in held]
        fixed = [pa.array(list(c)) for c in zip(*rows)]
        yield pa.RecordBatch.from_arrays(
            [fixed[0].cast(pa.int32()), *fixed[1:], *[pa.array(c) for c in counts.T], pa.array(values, pa.list_(pa.float64()))],
            names=["no", "low", "high", "a", "b", "u", "e", "o", "v"],
        )

    schema = "no int, low double, high double, a long, b long, u long, e long, o long, v array<double>"
    some = df.select(*[quoted(c) for c in asked]).mapInArrow(counted, schema)
    sums = some.groupBy("no", "low", "high", "a", "b").agg(
        *[F.sum(c).alias(c) for c in "ueo"], F.array_sort(F.flatten(F.collect_list("v"))).alias("v")
    )
    inside = "CASE WHEN {0} < e + size(v) THEN try_element_at(v, CAST({0} - e + 1 AS INT)) WHEN {0} < o THEN high END"
    pick = "CASE WHEN {0} < u THEN NULL WHEN {0} < e THEN low ELSE " + inside + " END"
    keys = list(brackets)
    found = sums.select("no", F.expr(pick.format("a")).alias("first"), F.expr(pick.format("b")).alias("last")).collect()  # two numbers per bracket
    return {keys[r["no"]]: (r["first"], r["last"]) for r in found if r["first"] is not None and r["last"] is not None}


def _interpolated(pair: tuple[float, float] | None, rows: int, p: float) -> float | None:
    if pair is None:
        return None
    low, high = pair
    part = p * (rows - 1) - math.floor(p * (rows - 1))
    return low if low == high or part == 0 else low + (high - low) * part


def _one_aggregate(df, columns, probs, function):
    out = {}
    shares = ", ".join(sql_literal(p) for p in probs)
    for start in range(0, len(columns), COLUMNS_PER_AGGREGATE):
        part = columns[start : start + COLUMNS_PER_AGGREGATE]
        row = df.agg(*[F.expr(f"{function}({quoted(c)}, array({shares})) AS q{i}") for i, c in enumerate(part)]).first()
        out.update({c: list(row[f"q{i}"]) if row[f"q{i}"] else [None] * len(probs) for i, c in enumerate(part)})
    return out


@dataclass
class _Bracket:
    """Values in [low, high] hold the ranks first..last; ``below`` rows lie under low."""

    column: str
    first: int
    last: int
    low: float
    high: float
    below: int
    inside: int

    def test(self) -> str:
        q = quoted(self.column)
        return f"({q} >= {sql_literal(self.low)} AND {q} <= {sql_literal(self.high)})"

    def settled(self, bracket_rows: int) -> bool:
        return self.low == self.high or self.inside <= bracket_rows


def _by_narrowing(df, columns, probs, bracket_rows):
    counts = df.agg(*[F.expr(f"count({quoted(c)}) AS n{i}") for i, c in enumerate(columns)]).first()
    rows = {c: counts[f"n{i}"] for i, c in enumerate(columns)}
    brackets = {}
    for c in columns:
        for p in probs:
            if rows[c]:
                at = p * (rows[c] - 1)
                brackets[c, p] = _Bracket(c, math.floor(at), math.ceil(at), -INF, INF, 0, rows[c])
    while wide := [b for b in brackets.values() if not b.settled(bracket_rows)]:
        before = [(b.low, b.high) for b in wide]
        _narrow(df, wide)
        if before == [(b.low, b.high) for b in wide]:
            break  # the bounds are values of neighbouring sketch ranks: few distinct values lie between

    found = {(b.column, p): (b.low, b.low) for (_, p), b in brackets.items() if b.low == b.high}
    open_ = [(k, b) for k, b in brackets.items() if b.low != b.high]
    if open_:
        hits = ", ".join(
            f"named_struct('no', {i}, 'v', CASE WHEN {b.test()} THEN {quoted(b.column)} END)" for i, (_, b) in enumerate(open_)
        )
        # No row filter ahead of this: pushed through projections, it would repeat their text per bracket.
        near = df.selectExpr(f"explode(filter(array({hits}), h -> h.v IS NOT NULL)) AS h").groupBy("h.no", "h.v").count()
        ranks = df.sparkSession.createDataFrame(
            [(i, b.below, b.first, b.last) for i, (_, b) in enumerate(open_)], "no int, below long, first long, last long"
        )  # a row per column and probability
        upto = F.sum("count").over(W.partitionBy("no").orderBy("v")) + F.col("below")
        placed = near.join(F.broadcast(ranks), "no").withColumn("upto", upto)
        picked = placed.groupBy("no").agg(
            F.min(F.when(F.col("upto") > F.col("first"), F.col("v"))).alias("low"),
            F.min(F.when(F.col("upto") > F.col("last"), F.col("v"))).alias("high"),
        )
        for r in picked.collect():  # two numbers per bracket
            found[open_[r["no"]][0]] = (r["low"], r["high"])

    return {c: [_interpolated(found.get((c, p)), rows[c], p) for p in probs] for c in columns}


def _narrow(df: DataFrame, wide: list[_Bracket]) -> None:
    """One sketch pass over the brackets and one counting pass over the proposed new ones."""
    groups: dict[tuple[str, float, float], list[_Bracket]] = {}
    for b in wide:
        groups.setdefault((b.column, b.low, b.high), []).append(b)
    sketches = []
    for i, ((c, low, high), members) in enumerate(groups.items()):
        shares = []
        for b in members:
            under, over = (b.first - b.below) / b.inside, (b.last - b.below + 1) / b.inside
            shares += [max(0.0, under - 2 / ACCURACY), min(1.0, over + 2 / ACCURACY)]
        value = f"CASE WHEN {members[0].test()} THEN {quoted(c)} END"
        asked = ", ".join(sql_literal(s) for s in shares)
        sketches.append(F.expr(f"percentile_approx({value}, array({asked}), {ACCURACY}) AS s{i}"))
    row = df.agg(*sketches).first()
    proposed: list[tuple[_Bracket, float, float]] = []
    for i, members in enumerate(groups.values()):
        for j, b in enumerate(members):
            proposed.append((b, row[f"s{i}"][2 * j], row[f"s{i}"][2 * j + 1]))
    counters = []
    for i, (b, low, high) in enumerate(proposed):
        q = quoted(b.column)
        counters += [
            F.expr(f"count_if({q} < {sql_literal(low)}) AS u{i}"), F.expr(f"count_if({q} <= {sql_literal(high)}) AS o{i}")
        ]
    row = df.agg(*counters).first()
    for i, (b, low, high) in enumerate(proposed):
        under, upto = row[f"u{i}"], row[f"o{i}"]
        above = b.below + b.inside
        if under <= b.first:  # a side the sketch misplaced keeps its old bound
            b.low, b.below = low, under
        if upto > b.last:
            b.high, above = high, upto
        b.inside = above - b.below


def medians(df: DataFrame, columns: list[str], mode: str = "exact", finite: bool = True) -> dict[str, float | None]:
    """Median of the present values per column (an action)."""
    return {c: q[0] for c, q in quantiles(df, columns, [0.5], mode, finite=finite).items()}
