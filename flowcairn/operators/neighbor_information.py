"""Mutual information of continuous features with a discrete label, by nearest neighbours.

For every row the radius is the distance to the k-th neighbour of its class in one feature; what counts
is how many rows of any class lie inside. With psi the digamma function, N rows and N_c of a class:

    I = psi(N) + mean(psi(k)) - mean(psi(N_c)) - mean(psi(m))

All columns go through the same jobs. A column is cut at its quantiles into slices of sorted values. The
k values of a class next to a slice come from the borders of the other slices; counts beyond a slice are
asked from the slices that hold the ends of the interval, whole slices between them count by their size.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowcairn.functions.numeric import as_number, quoted
from flowcairn.operators.ordering import bucket_edges, with_buckets
from flowcairn.session import cut_lineage

NEIGHBORS = 3
SLICE_ROWS = 200_000
MOST_SLICES = 4096  # of a column; bounds the edges that travel with tasks, slices grow beyond it
NOISE = 1e-10
SEED = 42
_TINY = 5e-324  # a radius that only holds equal values


def digamma(n: np.ndarray) -> np.ndarray:
    """psi of positive whole numbers: harmonic numbers first, the asymptotic series beyond."""
    n = np.asarray(n, dtype=np.float64)
    table = np.concatenate([[-np.inf], np.concatenate([[0.0], np.cumsum(1.0 / np.arange(1, 63))]) - np.euler_gamma])
    small = np.minimum(n, 63).astype(np.int64)
    x = np.maximum(n, 32.0)
    series = np.log(x) - 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4) - 1 / (252 * x**6)
    return np.where(n < 63, table[small], series)


def _first_true(low: np.ndarray, high: np.ndarray, holds) -> np.ndarray:
    """Smallest place in [low, high) at which a predicate that stays true holds, else ``high``; all rows at once."""
    low, high = low.copy(), high.copy()
    while (open_ := low < high).any():
        middle = (low + high) // 2
        yes = np.zeros(len(low), dtype=bool)
        yes[open_] = holds(middle[open_], open_)
        high = np.where(open_ & yes, middle, high)
        low = np.where(open_ & ~yes, middle + 1, low)
    return low


def _inside(xs: np.ndarray, x: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last-but-one place of the sorted values with ``abs(value - x) < r``, by the rounded difference."""
    at = np.searchsorted(xs, x)
    zero, full = np.zeros(len(x), dtype=np.int64), np.full(len(x), len(xs), dtype=np.int64)
    first = _first_true(zero, at, lambda i, rows: x[rows] - xs[i] < r[rows])
    end = _first_true(at, full, lambda i, rows: ~(xs[i] - x[rows] < r[rows]))
    return first, end


def _kth(own: np.ndarray, left: np.ndarray, right: np.ndarray, k: int) -> np.ndarray:
    """Distance of each sorted value to its k-th neighbour; ``left`` and ``right`` are what lies beside."""
    every = np.concatenate([left, own, right])
    at = np.arange(len(left), len(left) + len(own))
    best = np.full(len(own), np.inf)
    for below in range(k + 1):  # so many of the k neighbours lie below
        a, b = at - below, at + (k - below)
        fits = (a >= 0) & (b < len(every))
        far = np.maximum(own - every[np.maximum(a, 0)], every[np.minimum(b, len(every) - 1)] - own)
        best = np.where(fits, np.minimum(best, far), best)
    return best


def _pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("x", kind="stable")
    codes, labels = pd.factorize(rows["label"], sort=True)
    return pd.DataFrame({
        "feature": [key[0]], "slice": [key[1]], "n": [len(rows)], "labels": [list(labels)],
        "xs": [rows["x"].to_numpy(dtype="<f8").tobytes()], "codes": [codes.astype("<i4").tobytes()],
    })


def _borders(k: int):
    def run(batches):
        for batch in batches:
            for feature, name, labels, xs, codes in batch[["feature", "slice", "labels", "xs", "codes"]].itertuples(index=False):
                x, c = np.frombuffer(xs, dtype="<f8"), np.frombuffer(codes, dtype="<i4")
                order = np.argsort(c, kind="stable")
                parts = np.split(x[order], np.cumsum(np.bincount(c, minlength=len(labels)))[:-1])
                yield pd.DataFrame({
                    "feature": feature, "slice": name, "label": labels, "n": [len(p) for p in parts],
                    "low": [p[:k].tolist() for p in parts], "high": [p[-k:].tolist() for p in parts],
                })

    return run


def _beside(k: int):
    """For one class of a column: the k values before and after each slice, and the size of the class."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("slice")
        left, right, before, after = [], [], [], []
        for high in rows["high"]:
            left.append(before)
            before = [*before, *high][-k:]
        for low in rows["low"][::-1]:
            right.append(after)
            after = [*low, *after][:k]
        return pd.DataFrame({
            "feature": key[0], "slice": rows["slice"], "label": key[1], "total": rows["n"].sum(), "left": left, "right": right[::-1],
        })

    return run


COUNTED = "feature int, slice int, home int, row int, x double, r double, side int, part long, n long, psi_k double, psi_m double"
_COLUMNS = [c.split(" ")[0] for c in COUNTED.split(", ")]


def _count(shared, k: int):
    """Sums over the rows of a slice whose interval ends in it, and questions of the other rows."""

    def run(key: tuple, slices: pd.DataFrame, beside: pd.DataFrame) -> pd.DataFrame:
        if not len(slices):
            return pd.DataFrame([], columns=_COLUMNS)
        feature, home = int(key[0]), int(key[1])
        edges, upto = shared.value[feature]
        row = slices.iloc[0]
        xs, codes = np.frombuffer(row["xs"], dtype="<f8"), np.frombuffer(row["codes"], dtype="<i4")
        near = {b.label: b for b in beside.itertuples(index=False)}
        r, neighbors = np.empty(len(xs)), np.empty(len(xs), dtype=np.int64)
        for code, label in enumerate(row["labels"]):
            at = np.flatnonzero(codes == code)
            own, b = xs[at], near[label]
            wanted = min(k, int(b.total) - 1)
            r[at] = _kth(own, np.asarray(b.left, dtype=float), np.asarray(b.right, dtype=float), wanted)
            # Equal values at distance 0: all of the class count, as all rows do.
            ties = np.searchsorted(own, own, "right") - np.searchsorted(own, own, "left")
            neighbors[at] = np.where(r[at] > 0, wanted, ties)
        r = np.where(r > 0, r, _TINY)
        first, end = _inside(xs, xs, r)
        sides = [np.zeros(len(xs), dtype=np.int64), np.zeros(len(xs), dtype=np.int64)]
        asked, last = [], len(upto) - 2
        for side, (crosses, bound) in enumerate([((first == 0) & (home > 0), xs - r), ((end == len(xs)) & (home < last), xs + r)]):
            rows = np.flatnonzero(crosses)
            ulp = np.spacing(np.maximum(np.abs(bound[rows]), np.abs(xs[rows])))
            low = np.searchsorted(edges, bound[rows] - 4 * ulp, "right")
            high = np.searchsorted(edges, bound[rows] + 4 * ulp, "right")
            # Slices near the end of the interval are asked, those between them and this one are inside.
            low, high = (np.minimum(low, home), np.minimum(high, home - 1)) if side == 0 else (np.maximum(low, home + 1), np.maximum(high, home))
            sides[side][rows] = upto[home] - upto[high + 1] if side == 0 else upto[low] - upto[home + 1]
            for step in range(int((high - low).max()) + 1 if len(rows) else 0):
                some = low + step <= high
                asked.append(pd.DataFrame({"slice": (low + step)[some], "row": rows[some], "x": xs[rows[some]], "r": r[rows[some]], "side": side}))
        m = end - first + sides[0] + sides[1]
        open_ = np.zeros(len(xs), dtype=bool)
        asked = pd.concat(asked) if asked else pd.DataFrame({"slice": [], "row": [], "x": [], "r": [], "side": []})
        open_[asked["row"].to_numpy(dtype=np.int64)] = True
        done = ~open_
        own = pd.DataFrame({"slice": -1, "row": np.flatnonzero(open_), "part": m[open_]})
        total = pd.DataFrame({"slice": [-2], "row": [-1], "n": [len(xs)], "psi_k": [digamma(neighbors).sum()], "psi_m": [digamma(m[done]).sum()]})
        out = pd.concat([x for x in (asked, own, total) if len(x)])
        return out.assign(feature=feature, home=home).reindex(columns=_COLUMNS)

    return run


def _answer(key: tuple, slices: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
    if not len(slices) or not len(asked):
        return pd.DataFrame([], columns=["feature", "home", "row", "part"])
    xs = np.frombuffer(slices.iloc[0]["xs"], dtype="<f8")
    first, end = _inside(xs, asked["x"].to_numpy(), asked["r"].to_numpy())
    return pd.DataFrame({"feature": asked["feature"], "home": asked["home"], "row": asked["row"], "part": end - first})


def _psi_sums(batches):
    for batch in batches:
        yield pd.DataFrame({"feature": batch["feature"], "psi_m": digamma(batch["m"].to_numpy())})


def row_noise(keys: list[str], seed: int = SEED):
    """A number in [-1, 1) from the md5 of the columns that identify a row."""
    parts = [F.coalesce(F.col(quoted(k)).cast("string"), F.lit("")) for k in keys]
    digits = F.substring(F.md5(F.concat_ws("|", *parts, F.lit(str(seed)))), 1, 12)
    return F.conv(digits, 16, 10).cast("long").cast("double") / float(1 << 47) - 1.0


def neighbor_information(
    df: DataFrame, columns: list[str], label: str, keys: list[str], k: int = NEIGHBORS, slice_rows: int = SLICE_ROWS, seed: int = SEED
) -> DataFrame:
    """(feature, mutual_information) in nats by the mixed nearest-neighbour estimator.

    Ties are broken by a tiny noise drawn from ``keys``; values it cannot part count as one point. Rows
    without a label or a finite value are left out of a column, and so are classes of one row. A column
    without rows, or with one class, has 0. Everything is counted over all rows.
    """
    numbers = [as_number(c, text=False) for c in columns]
    finite = [F.when(F.abs(x) < float("inf"), x) for x in numbers]
    base = df.where(F.col(quoted(label)).isNotNull()).select(
        F.col(quoted(label)).cast("string").alias("_label"), row_noise(keys, seed).alias("_u"), *[x.alias(f"x{i}") for i, x in enumerate(finite)]
    )
    names = [f"x{i}" for i in range(len(columns))]
    size = lambda x: F.greatest(F.stddev_pop(x), F.avg(F.abs(x)))
    stats = base.agg(F.count(F.lit(1)).alias("n"), *[size(F.col(x)).alias(x) for x in names]).first()
    # Powers of two: the noise does not change with the last digits of a sum.
    steps = {x: NOISE * 2.0 ** math.floor(math.log2(stats[x])) if stats[x] else NOISE for x in names}
    noisy = base.select("_label", *[(F.col(x) + F.col("_u") * F.lit(steps[x])).alias(x) for x in names])
    slices = min(MOST_SLICES, -(-stats["n"] // slice_rows))
    edges = bucket_edges(noisy, names, slices) if slices > 1 else {x: [] for x in names}
    several = {x: e for x, e in edges.items() if e}
    cut = with_buckets(noisy, several) if several else noisy
    cells = ", ".join(f"named_struct('feature', {i}, 'slice', {x + '_bucket' if x in several else 0}, 'x', {x})" for i, x in enumerate(names))
    rows = cut.selectExpr("_label AS label", f"explode(array({cells})) AS e").select("label", "e.*").where("x IS NOT NULL")
    held = noisy.groupBy("_label").agg(*[F.count(x).alias(x) for x in names])
    single = held.selectExpr("_label AS label", f"explode(array({', '.join(f'IF({x} = 1, {i}, NULL)' for i, x in enumerate(names))})) AS feature")
    rows = rows.join(single.where("feature IS NOT NULL"), ["feature", "label"], "left_anti")
    packed = rows.groupBy("feature", "slice").applyInPandas(_pack, "feature int, slice int, n long, labels array<string>, xs binary, codes binary")
    packed = cut_lineage(packed)
    counts = packed.select("feature", "slice", "n").collect()  # a row per slice, at most MOST_SLICES a column
    sizes = {i: np.zeros(len(edges[x]) + 2, dtype=np.int64) for i, x in enumerate(names)}
    for r in counts:
        sizes[r["feature"]][r["slice"] + 1] = r["n"]
    places = {i: (np.array(edges[x]), np.cumsum(sizes[i])) for i, x in enumerate(names)}
    shared = df.sparkSession.sparkContext.broadcast(places)
    borders = packed.mapInPandas(_borders(k), "feature int, slice int, label string, n long, low array<double>, high array<double>")
    beside = borders.groupBy("feature", "label").applyInPandas(
        _beside(k), "feature int, slice int, label string, total long, left array<double>, right array<double>"
    )
    beside = cut_lineage(beside)
    counted = packed.groupBy("feature", "slice").cogroup(beside.groupBy("feature", "slice")).applyInPandas(_count(shared, k), COUNTED)
    counted = cut_lineage(counted)
    shared.destroy()
    asked = counted.where("slice >= 0").select("feature", "slice", "home", "row", "x", "r")
    answers = packed.select("feature", "slice", "xs").groupBy("feature", "slice").cogroup(asked.groupBy("feature", "slice")).applyInPandas(
        _answer, "feature int, home int, row int, part long"
    )
    parts = counted.where("slice = -1").select("feature", "home", "row", "part").unionByName(answers)
    open_ = parts.groupBy("feature", "home", "row").agg(F.sum("part").alias("m")).select("feature", "m")
    psi = open_.mapInPandas(_psi_sums, "feature int, psi_m double").select("feature", F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("psi_k"), "psi_m")
    totals = counted.where("slice = -2").select("feature", "n", "psi_k", "psi_m").unionByName(psi)
    totals = totals.groupBy("feature").agg(F.sum("n").alias("n"), F.sum("psi_k").alias("psi_k"), F.sum("psi_m").alias("psi_m"))
    classes = beside.groupBy("feature", "label").agg(F.max("total").alias("n"))
    of_class = classes.mapInPandas(_class_sums, "feature int, psi_c double").groupBy("feature").agg(F.sum("psi_c").alias("psi_c"))
    sums = totals.join(of_class, "feature").collect()  # a row per column
    found = {r["feature"]: (r["n"], (r["psi_k"] - r["psi_m"] - r["psi_c"]) / r["n"]) for r in sums}
    out = [(c, max(0.0, float(digamma([found[i][0]])[0]) + found[i][1]) if i in found else 0.0) for i, c in enumerate(columns)]
    return df.sparkSession.createDataFrame(out, "feature string, mutual_information double")


def _class_sums(batches):
    for batch in batches:
        n = batch["n"].to_numpy()
        yield pd.DataFrame({"feature": batch["feature"], "psi_c": n * digamma(n)})
