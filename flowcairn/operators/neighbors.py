"""Exact nearest neighbours between two tables, and the k-NN classifier built on them.

If the reference vectors fit under a checked size they are broadcast and every query batch is matched
with numpy, unless vectors are short and pairs too many. Beyond it both sides are cut into cells: the leaves of a tree of balls around pivots, about
the square root of the rows of them. A first pass searches the home cell of each query and yields a
distance bound; a second pass walks down the tree and leaves out every ball which the triangle inequality
puts beyond that bound. Cells are cut into slices of bounded row count on both sides, so a cell that holds
most of the rows is worked on by many tasks, and each task returns k rows per query, never all pairs.
Inside a task with few dimensions, both sides are sorted by the widest one: a few queries at a time meet
only the references between their outermost bounds, so work per query does not grow with the cell.

Vectors of many dimensions without clusters leave out next to no ball, and a copy of each query per ball
would be n·√n rows. A trial on the pivots tells, and such tables are dealt into packed blocks of bounded
bytes instead: every pair of blocks is one task's matrix product, in single precision with a bound of its
rounding; exact differences in double precision decide. Of equal references only the k + 1
smallest ids can be among the nearest, so more of them never meet a query; payload follows at the end.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowcairn.functions.numeric import quoted
from flowcairn.session import cut_lineage, let_go, open_blocks, owned_by

BROADCAST_BYTES = 16 * 1024 * 1024
BROADCAST_PAIRS = 4_000_000_000  # of queries and references; beyond it cells spare more than they cost in few dimensions
SLICE_ROWS = 20_000
BLOCK_BYTES, BLOCK_ROWS = 32 * 1024 * 1024, 65_536  # of one side of a pair of blocks
PRODUCT_PAIRS = 2_000_000  # whose products are held at a time
SINGLE_SQUARES = 1e30  # squares below it leave room for sums in single precision
LEAST_TASKS = 48  # pairs of blocks of a table that one pair could hold
TRIAL = 256  # pivots that tell how many cells a query would visit
MANY_VISITS = 64  # cells a query may visit before blocks are compared
LEAST_PIVOTS, MOST_PIVOTS = 64, 4096  # leaves of the tree; between them about the square root of the rows
BRANCHES = 16
SWEEP_DIMENSIONS, SWEEP_ROWS = 16, 256  # most dimensions, fewest references
SWEEP_QUERIES, SWEEP_BESIDE = 64, 64  # queries at a time, references on either side that give a bound
CELL = ("_cell", T.IntegerType())


def vector_of(columns: list[str]) -> Column:
    """Feature columns as one array of doubles."""
    return F.expr("array(" + ", ".join(f"CAST({quoted(c)} AS DOUBLE)" for c in columns) + ")")


def _exact(q: np.ndarray, r: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Distances of pairs by exact differences, a bounded number of values at a time."""
    out, step = np.empty(len(rows)), max(1, 2_000_000 // max(1, q.shape[1]))
    for at in range(0, len(rows), step):
        here = slice(at, at + step)
        out[here] = np.sqrt(((r[cols[here]] - q[rows[here]]) ** 2).sum(axis=1))
    return out


def _single(q: np.ndarray, r: np.ndarray, p2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Both sides in single precision, with a bound of the product's rounding per query, or None.

    Vectors are taken from the middle of r. A product of d + 1 terms, each rounded, is off by less than
    (d + 4) · 2⁻²³ times the sum of their sizes; short vectors and those whose squares might overflow stay as they are.
    """
    if q.shape[1] <= SWEEP_DIMENSIONS or not p2.max(initial=0.0) < SINGLE_SQUARES or not (np.abs(r) < SINGLE_SQUARES**0.5).all():
        return None
    middle = r.mean(axis=0)
    left, right = np.ones((len(q), q.shape[1] + 1), dtype="f4"), np.empty((r.shape[1] + 1, len(r)), dtype="f4")
    moved = q - middle
    own = np.sqrt(np.einsum("ij,ij->i", moved, moved))
    left[:, :-1] = moved
    moved = r - middle
    r2 = np.einsum("ij,ij->i", moved, moved)
    moved *= -2.0
    right[:-1], right[-1] = moved.T, r2
    return left, right, (q.shape[1] + 4) * 2.0**-23 * (2.0 * own * np.sqrt(r2.max()) + r2.max())


def _nearest(q: np.ndarray, r: np.ndarray, same: np.ndarray | None, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and distances of the k nearest of ``r``; ties go to the smaller row number.

    A matrix product and a limit taken from every few rows of r leave few pairs, with room for its
    rounding; exact differences decide among them. The product is in single precision where its rounding
    leaves few pairs, too. Where squares overflow, all pairs are compared exactly. ``same[i]`` is a row of r
    to skip, or −1.
    """
    wanted = min(k, len(r))
    rows_out = np.full((len(q), wanted), -1)
    dist_out = np.full((len(q), wanted), np.inf)
    with np.errstate(over="ignore", invalid="ignore"):
        r2 = (r * r).sum(axis=1)
        huge = bool((~np.isfinite(r2) & np.isfinite(r).all(axis=1)).any())
        q2 = (q * q).sum(axis=1)
        folded = None
        step = max(1, PRODUCT_PAIRS // len(r))
        enough = min(len(r), wanted + 1)
        stride = max(1, min(8, len(r) // (32 * enough)))
        single = _single(q, r, q2) if enough < len(r) else None

        def within(approx: np.ndarray, slack) -> np.ndarray:
            limit = np.partition(approx[:, ::stride], enough - 1, axis=1)[:, enough - 1].astype(float)
            limit = np.where(np.isnan(limit), np.inf, limit + slack(limit))
            if approx.dtype == np.float32:  # a limit between two numbers of single precision goes up
                limit = np.nextafter(limit.astype("f4"), np.float32(np.inf))
            return approx <= limit[:, None]

        for at in range(0, len(q), step):
            part, p2 = q[at : at + step], q2[at : at + step]
            near = None
            if single is not None:
                left, right, error = single
                rounding = 2.0 * error[at : at + step]
                near = within(left[at : at + step] @ right, lambda limit: rounding + 1e-9 * (1.0 + np.abs(limit) + 2.0 * p2))
                if near.sum() > len(part) * max(64, 32 * enough):  # vectors are nearer to each other than the rounding
                    near = single = None
            if near is None:
                if folded is None:
                    folded = np.vstack([-2.0 * r.T, r2])
                approx = np.column_stack([part, np.ones(len(part))]) @ folded  # short of p2
                near = within(approx, lambda limit: 1e-9 * (1.0 + np.abs(limit) + 2.0 * p2))
            if enough == len(r):
                near[:] = True
            near[huge | (~np.isfinite(p2) & np.isfinite(part).all(axis=1))] = True
            if same is not None:
                skip = np.flatnonzero(same[at : at + step] >= 0)
                near[skip, same[at : at + step][skip]] = False
            row, col = np.divmod(np.flatnonzero(near), len(r))
            dist = _exact(part, r, row, col)
            finite = np.isfinite(dist)
            row, col, dist = row[finite], col[finite], dist[finite]
            order = np.lexsort((col, dist, row))
            row, col, dist = row[order], col[order], dist[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            best = place < wanted
            rows_out[at + row[best], place[best]] = col[best]
            dist_out[at + row[best], place[best]] = dist[best]
    return rows_out, dist_out


def _swept(q: np.ndarray, r: np.ndarray, same: np.ndarray | None, k: int, bound: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """The same as ``_nearest`` for finite vectors, as far as references lie within ``bound``.

    Queries go in the order of the widest dimension; the k-th distance to references beside them there is
    a bound where none is given, and only references which that dimension leaves within it are compared.
    """
    wanted = min(k, len(r))
    rows_out, dist_out = np.full((len(q), wanted), -1), np.full((len(q), wanted), np.inf)
    axis = int((r.max(axis=0) - r.min(axis=0)).argmax())
    by_axis = np.argsort(r[:, axis], kind="stable")
    sorted_r, q_order = r[by_axis], np.argsort(q[:, axis], kind="stable")
    x, columns = sorted_r[:, axis], np.ascontiguousarray(sorted_r.T)
    enough = wanted + (same is not None)  # the query itself may be among them

    def squares(part: np.ndarray, start: int, end: int) -> np.ndarray:
        out = np.zeros((len(part), end - start))
        for i in range(part.shape[1]):
            gap = columns[i, start:end] - part[:, i, None]
            out += gap * gap
        return out

    for at in range(0, len(q), SWEEP_QUERIES):
        some = q_order[at : at + SWEEP_QUERIES]
        part, here = q[some], q[some, axis]
        limit = np.full(len(some), np.inf) if bound is None else np.where(np.isnan(bound[some]), np.inf, bound[some])
        if enough <= len(r) and np.isinf(limit).any():
            low, high = np.searchsorted(x, here[[0, -1]])
            start, end = max(0, min(low - SWEEP_BESIDE, len(r) - enough)), min(len(r), max(high + SWEEP_BESIDE, enough))
            near = np.sqrt(np.partition(squares(part, start, end), enough - 1, axis=1)[:, enough - 1])
            limit = np.minimum(limit, near)
        reach = limit * (1 + 1e-9) + 1e-9 * (1e-9 + np.abs(here))
        start, end = np.searchsorted(x, (here - reach).min()), np.searchsorted(x, (here + reach).max(), "right")
        row, col = np.divmod(np.flatnonzero(squares(part, start, end) <= (reach * reach)[:, None]), max(1, end - start))
        col = by_axis[start + col]
        if same is not None:
            other = col != same[some][row]
            row, col = row[other], col[other]
        dist = _exact(part, r, row, col)
        order = np.lexsort((col, dist, row))
        row, col, dist = row[order], col[order], dist[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        best = place < wanted
        rows_out[some[row[best]], place[best]] = col[best]
        dist_out[some[row[best]], place[best]] = dist[best]
    return rows_out, dist_out


def _sweeps(q: np.ndarray, r: np.ndarray) -> bool:
    """Whether vectors are few-dimensional, and finite with room for their squares."""
    if len(r) <= SWEEP_ROWS or not 0 < r.shape[1] <= SWEEP_DIMENSIONS:
        return False
    return bool((np.abs(q) < 1e100).all() and (np.abs(r) < 1e100).all())


def _stacked(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(float)


def _matches(query_ids, q: np.ndarray, ids, r: np.ndarray, k: int, skip_self: bool, bound: np.ndarray | None = None) -> pd.DataFrame:
    """Top-k rows (query_id, neighbor_id, distance) within each query's bound; ``ids`` are sorted."""
    if not len(q) or not len(r):
        return pd.DataFrame({n: pd.Series([], dtype=object) for n in ("query_id", "neighbor_id", "distance")})
    same = pd.Index(ids).get_indexer(query_ids) if skip_self else None
    rows, dist = _swept(q, r, same, k, bound) if _sweeps(q, r) else _nearest(q, r, same, k)
    hit = rows >= 0
    if bound is not None:
        hit &= ~(dist > bound[:, None])  # an unknown bound is NaN
    return pd.DataFrame({
        "query_id": np.repeat(np.asarray(query_ids), rows.shape[1])[hit.ravel()],
        "neighbor_id": np.asarray(ids)[rows[hit]], "distance": dist[hit],
    })


def _require_unique(df: DataFrame, column: str) -> None:
    repeated = df.groupBy(column).count().where("count > 1").select(column).first()
    if repeated is not None:
        raise ValueError(f"{column} is not unique: {repeated[0]!r} occurs more than once")


class NeighborSearch:
    """References made ready once, by broadcast or as cells, for any number of query tables.

    Distances are Euclidean over ``vector`` (array of numbers); ties go to the smaller id.
    ``skip_self`` leaves out the reference whose id equals the query's. Ids must be unique on either
    side; repeated ones raise an error. Counting references and reading the vector length is an action.
    """

    def __init__(
        self, references: DataFrame, k: int, reference_id: str, vector: str, skip_self: bool = False,
        broadcast_bytes: int = BROADCAST_BYTES, slice_rows: int = SLICE_ROWS, pivots: int | None = None,
    ):
        r = references.select(
            F.col(quoted(reference_id)).alias("neighbor_id"), F.col(quoted(vector)).cast("array<double>").alias("_vec")
        )
        self.r, self.k, self.skip_self, self.slice_rows, self.pivots = r, k, skip_self, slice_rows, pivots
        self.broadcast_bytes, self.level = broadcast_bytes, open_blocks()
        self.rows = self.shared = self.cells = None

    def _measure(self) -> None:
        if self.rows is None:
            _require_unique(self.r, "neighbor_id")
            size = self.r.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("_vec")).alias("d")).first()
            self.rows, self.width = size["n"], size["d"]

    def lists(self, queries: DataFrame, query_id: str, vector: str) -> DataFrame:
        """(query_id, near): per query its k nearest as an array of (distance, neighbor_id), nearest first."""
        q = _queries(queries, query_id, vector)
        _require_unique(q, "query_id")
        self._measure()
        best = F.slice(F.array_sort(F.collect_list(F.struct("distance", "neighbor_id"))), 1, self.k)  # k rows per task that met the query
        return self._candidates(q).groupBy("query_id").agg(best.alias("near"))

    def _candidates(self, q: DataFrame) -> DataFrame:
        schema = T.StructType(
            [
                T.StructField("query_id", q.schema["query_id"].dataType),
                T.StructField("neighbor_id", self.r.schema["neighbor_id"].dataType),
                T.StructField("distance", T.DoubleType()),
            ]
        )
        k, skip_self = self.k, self.skip_self
        fits = self.rows * ((self.width or 0) * 8 + 64) <= self.broadcast_bytes
        if fits and self.rows > SLICE_ROWS and self.width <= SWEEP_DIMENSIONS:
            fits = self.rows * q.count() <= BROADCAST_PAIRS
        if fits:
            if self.shared is None:
                table = self.r.toPandas().sort_values("neighbor_id", kind="stable")
                vectors = _stacked(table["_vec"]) if len(table) else np.zeros((0, 0))
                self.shared = q.sparkSession.sparkContext.broadcast((table["neighbor_id"].to_numpy(), vectors))
            shared = self.shared

            def match(batches):
                for batch in batches:
                    if len(batch):
                        yield _matches(batch["query_id"], _stacked(batch["_vec"]), *shared.value, k, skip_self)

            # Matching costs far more than its bytes tell, so the number of tasks is set, not derived.
            tasks = int(q.sparkSession.conf.get("spark.sql.shuffle.partitions"))
            return q.repartition(tasks, "query_id").mapInPandas(match, schema)
        if self.cells is None:
            order = W.partitionBy("_vec").orderBy("neighbor_id")
            few = self.r.withColumn("_copy", F.row_number().over(order)).where(F.col("_copy") <= k + int(skip_self)).drop("_copy")
            pivots = self.pivots or min(MOST_PIVOTS, max(LEAST_PIVOTS, math.isqrt(self.rows)))
            with owned_by(self.level):  # they serve later query tables, too
                self.cells = Cells(few, k, skip_self, pivots, self.width)
        return _by_cells(q, self.cells, k, skip_self, schema, self.slice_rows)


def _queries(queries: DataFrame, query_id: str, vector: str) -> DataFrame:
    return queries.select(
        F.col(quoted(query_id)).alias("query_id"), F.col(quoted(vector)).cast("array<double>").alias("_vec")
    )


def knn_join(
    queries: DataFrame,
    references: DataFrame,
    k: int,
    query_id: str,
    reference_id: str,
    vector: str,
    payload: tuple[str, ...] = (),
    skip_self: bool = False,
    broadcast_bytes: int = BROADCAST_BYTES,
    slice_rows: int = SLICE_ROWS,
    pivots: int | None = None,
) -> DataFrame:
    """The k nearest references of every query: (query_id, neighbor_id, distance, rank, payload…), as ``NeighborSearch`` finds them."""
    search = NeighborSearch(references, k, reference_id, vector, skip_self, broadcast_bytes, slice_rows, pivots)
    near = (
        search.lists(queries, query_id, vector)
        .select("query_id", F.posexplode("near").alias("_pos", "_n"))
        .select("query_id", "_n.neighbor_id", "_n.distance", (F.col("_pos") + 1).alias("rank"))
    )
    if not payload:
        return near
    more = references.select(F.col(quoted(reference_id)).alias("_r"), *[F.col(quoted(p)) for p in payload])
    return near.join(more, F.col("neighbor_id").eqNullSafe(F.col("_r"))).select(*near.columns, *[F.col(quoted(p)) for p in payload])


class PivotTree:
    """Balls within balls: every node has a centre, inner nodes up to ``BRANCHES`` children, leaves are cells."""

    def __init__(self, points: np.ndarray, branches: int = BRANCHES):
        self.centers, self.children, self.leaf = [np.zeros(points.shape[1])], [[]], [-1]
        self.leaves: list[list[int]] = []  # nodes on the way to each leaf, without the root
        self._grow(0, points, branches, [])
        self.centers = np.array(self.centers)
        self.radius = np.full(len(self.leaf), np.inf)
        self.starts = np.ones(len(self.leaf), dtype=bool)
        self.boxes: tuple[np.ndarray, np.ndarray] | None = None

    def _grow(self, node: int, points: np.ndarray, branches: int, way: list[int]) -> None:
        chosen = points[:branches]
        at = ((points[:, None, :] - chosen[None, :, :]) ** 2).sum(axis=2).argmin(axis=1)
        for i, center in enumerate(chosen):
            child, part = len(self.leaf), points[at == i]
            self.children[node].append(child)
            self.centers.append(center)
            self.children.append([])
            self.leaf.append(-1)
            if len(part) > 1:
                self._grow(child, part, branches, [*way, child])
            else:
                self.leaf[child] = len(self.leaves)
                self.leaves.append([*way, child])

    def measure(self, counts: dict[int, int], gaps: dict[int, list[float]], enough: int) -> None:
        """Set radii from each leaf's largest distances to the nodes on its way, and where a first search may start."""
        self.radius[:], self.starts[:] = -np.inf, False
        large = [c for c, n in counts.items() if n >= enough] or [max(counts, key=lambda c: (counts[c], -c))]
        for cell, far in gaps.items():
            for node, gap in zip(self.leaves[cell], far):
                self.radius[node] = max(self.radius[node], gap)
        for cell in large:
            self.starts[self.leaves[cell]] = True

    def bound(self, boxes: dict[int, tuple[list[float], list[float]]]) -> None:
        """Set the lowest and highest value of every dimension in each cell; cells without rows hold nothing."""
        low = np.full((len(self.leaves), self.centers.shape[1]), np.inf)
        self.boxes = low, -low
        for cell, sides in boxes.items():
            for box, side, wide in zip(self.boxes, sides, (-np.inf, np.inf)):
                values = np.array(side, dtype=float)
                box[cell] = np.where(np.isnan(values), wide, values)

    def _distances(self, v: np.ndarray, nodes: list[int]) -> np.ndarray:
        return np.sqrt(((v[:, None, :] - self.centers[nodes][None, :, :]) ** 2).sum(axis=2))

    def descend(self, v: np.ndarray, only_starts: bool = False) -> tuple[np.ndarray, list[list[float]]]:
        """The leaf that each vector comes to by the nearest child at every node, and the distances on its way."""
        leaf, at = np.array(self.leaf), np.zeros(len(v), dtype=np.int64)
        gaps, levels = np.zeros((len(v), max(map(len, self.leaves)))), np.zeros(len(v), dtype=np.int64)
        open_, level = np.arange(len(v)), 0
        while len(open_):
            order = np.argsort(at[open_], kind="stable")
            met, starts = np.unique(at[open_][order], return_index=True)
            for node, rows in zip(met.tolist(), np.split(open_[order], starts[1:])):
                nodes = [c for c in self.children[node] if self.starts[c] or not only_starts]
                d = self._distances(v[rows], nodes)
                best = d.argmin(axis=1)
                at[rows] = np.array(nodes)[best]
                gaps[rows, level] = d[np.arange(len(rows)), best]
            level += 1
            levels[open_] = level
            open_ = open_[leaf[at[open_]] < 0]
        return leaf[at], [row[:n] for row, n in zip(gaps, levels.tolist())]

    def visit(self, v: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) for every leaf that may hold something within the row's bound."""
        rows, cells, leaf = [], [], np.array(self.leaf)
        open_ = [(np.arange(len(v)), 0)]
        while open_:
            at, node = open_.pop()
            nodes = self.children[node]
            near = self._distances(v[at], nodes) - self.radius[nodes][None, :] <= bound[at, None] * (1 + 1e-9) + 1e-9
            for i, child in enumerate(nodes):
                some = at[near[:, i]]
                if not len(some):
                    continue
                if leaf[child] >= 0:
                    if self.boxes is not None:
                        low, high = (box[leaf[child]] for box in self.boxes)
                        outside = np.maximum(np.maximum(low - v[some], v[some] - high), 0.0)
                        some = some[(outside * outside).sum(axis=1) <= (bound[some] * (1 + 1e-9) + 1e-9) ** 2]
                    rows.append(some)
                    cells.append(np.full(len(some), leaf[child]))
                else:
                    open_.append((some, child))
        if not rows:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        return np.concatenate(rows), np.concatenate(cells)


def _visits(tree: PivotTree, points: np.ndarray, k: int, rows: int) -> float:
    """Cells that a row would visit, by some pivots; their distances are brought down to the table's density."""
    some = points[:: max(1, len(points) // TRIAL)]
    gaps = np.sort(np.sqrt(np.maximum((some**2).sum(axis=1)[:, None] + (points**2).sum(axis=1) - 2.0 * some @ points.T, 0.0)), axis=1)
    bound = gaps[:, min(k, len(points) - 1)] * (len(points) / max(rows, len(points))) ** (1.0 / max(1, points.shape[1]))
    return len(tree.visit(some, bound)[0]) / len(some)


def _with_fields(schema: T.StructType, *fields) -> T.StructType:
    return T.StructType([*schema.fields, *[T.StructField(*f) for f in fields]])


class Cells:
    """References placed in the leaves of a measured tree; ``packed`` where so many cells would be visited that blocks are compared."""

    def __init__(self, r: DataFrame, k: int, skip_self: bool, pivots: int, width: int):
        r = cut_lineage(r)
        chosen = r.orderBy(F.xxhash64("neighbor_id"), "neighbor_id").limit(pivots).select("_vec").collect()
        points = np.array([c["_vec"] for c in chosen], dtype=float)
        _, first_of = np.unique(points, axis=0, return_index=True)
        points = points[np.sort(first_of)]
        tree = PivotTree(points)
        shared = r.sparkSession.sparkContext.broadcast(tree)  # at most MOST_PIVOTS vectors

        def home(batches):
            for batch in batches:
                if batch.empty:
                    continue
                cell, gaps = shared.value.descend(_stacked(batch["_vec"]))
                yield batch.assign(_cell=cell.astype("int32"), _gap=gaps)

        few = width <= SWEEP_DIMENSIONS
        placed = r.mapInPandas(home, _with_fields(r.schema, CELL, ("_gap", T.ArrayType(T.DoubleType()))))
        if few:  # short vectors: cheaper kept than placed anew
            placed = cut_lineage(placed)
            let_go(r)
            r = placed.drop("_cell", "_gap")
        depth = max(map(len, tree.leaves))
        farthest = F.array(*[F.max(F.get("_gap", F.lit(i))) for i in range(depth)]).alias("far")
        sides = [F.array(*[f(F.get("_vec", F.lit(i))) for i in range(width)]).alias(n) for n, f in (("low", F.min), ("high", F.max))] if few else []
        found = placed.groupBy("_cell").agg(F.count(F.lit(1)).alias("n"), farthest, *sides).collect()  # at most one row per pivot
        counts = {c["_cell"]: c["n"] for c in found}
        # The first pass starts in the nearest cell with enough rows, or in the largest one.
        tree.measure(counts, {c["_cell"]: c["far"][: len(tree.leaves[c["_cell"]])] for c in found}, k + 1 if skip_self else k)
        if few:  # in few dimensions a box is much tighter than a ball
            tree.bound({c["_cell"]: (c["low"], c["high"]) for c in found})
        self.rows, self.width = sum(counts.values()), width
        self.block_rows = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * max(1, width))))
        self.packed = _visits(tree, points, k, self.rows) > max(MANY_VISITS, 4 * -(-self.rows // self.block_rows))
        self.r, self.placed, self.counts, self.tree = r, placed.drop("_gap"), counts, tree


def _by_cells(q, ready, k, skip_self, schema, slice_rows):
    if ready.packed:
        return _by_blocks(q, ready.r, k, skip_self, schema, ready.block_rows, ready.rows)
    placed, cells, width = ready.placed, ready.counts, ready.width
    measured = q.sparkSession.sparkContext.broadcast(ready.tree)

    def first_cell(batches):
        for batch in batches:
            if batch.empty:
                continue
            cell, _ = measured.value.descend(_stacked(batch["_vec"]), only_starts=True)
            yield batch.assign(_cell=cell.astype("int32"))

    first = q.mapInPandas(first_cell, _with_fields(q.schema, CELL))
    few = width <= SWEEP_DIMENSIONS
    first = cut_lineage(first) if few else first
    seeds = cut_lineage(_slice_join(first, placed, k, skip_self, schema, slice_rows, cells))
    if few:
        let_go(first)
    ranked = F.array_sort(F.collect_list("distance"))
    bounds = seeds.groupBy("query_id").agg(
        F.when(F.count(F.lit(1)) >= k, ranked[k - 1]).alias("_bound")
    )  # k rows per slice of the home cell

    def other_cells(batches):
        for batch in batches:
            if batch.empty:
                continue
            v = _stacked(batch["_vec"])
            done, _ = measured.value.descend(v, only_starts=True)
            bound = batch["_bound"].to_numpy(dtype=float)
            row, cell = measured.value.visit(v, np.where(np.isnan(bound), np.inf, bound))
            new = cell != done[row]
            yield batch.iloc[row[new]].assign(_cell=cell[new].astype("int32"))

    bounded = cut_lineage(q.join(bounds, "query_id", "left").select("query_id", "_vec", "_bound"))
    wider = bounded.mapInPandas(other_cells, _with_fields(bounded.schema, CELL))
    return seeds.unionByName(_slice_join(wider, placed, k, skip_self, schema, slice_rows, cells))


def _slice_join(q, placed, k, skip_self, schema, slice_rows, cells):
    """Meet queries and references of equal cell in slices of bounded row count on both sides."""
    q_counts = {c["_cell"]: c["count"] for c in q.groupBy("_cell").count().collect()}  # one per pivot

    def slices(counts):
        wide = {c: math.ceil(n / slice_rows) for c, n in counts.items() if n > slice_rows}
        pairs = [F.lit(x) for item in wide.items() for x in item]
        if not pairs:
            return F.lit(1)
        return F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("_cell")), F.lit(1))

    r_slices = slices(cells)
    q_slices = slices(q_counts)
    left = q.withColumn("_qs", F.pmod(F.xxhash64("query_id"), q_slices).cast("int")).withColumn(
        "_rs", F.explode(F.sequence(F.lit(0), r_slices - 1))
    )
    right = placed.withColumn("_rs", F.pmod(F.xxhash64("neighbor_id"), r_slices).cast("int")).withColumn(
        "_qs", F.explode(F.sequence(F.lit(0), q_slices - 1))
    )

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({n: pd.Series([], dtype=object) for n in ("query_id", "neighbor_id", "distance")})
        b = b.sort_values("neighbor_id", kind="stable")
        bound = a["_bound"].to_numpy(dtype=float) if "_bound" in a else None
        return _matches(a["query_id"], _stacked(a["_vec"]), b["neighbor_id"], _stacked(b["_vec"]), k, skip_self, bound)

    keys = ["_cell", "_qs", "_rs"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(meet, schema)


def _packed(df: DataFrame, row_id: str, blocks: int) -> DataFrame:
    """Rows dealt to blocks by their id, those of a block and batch as one row of ids and bytes."""
    dealt = df.select(F.col(row_id).alias("id"), "_vec", F.pmod(F.xxhash64(row_id), F.lit(blocks)).cast("int").alias("block"))
    schema = T.StructType([
        T.StructField("block", T.IntegerType()), T.StructField("ids", T.ArrayType(df.schema[row_id].dataType)),
        T.StructField("vectors", T.BinaryType()),
    ])

    def pack(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            lengths = batch.column("_vec").value_lengths()
            if lengths.null_count or len(lengths.unique()) > 1:
                raise ValueError("vectors must be present and of equal length")
            values = batch.column("_vec").flatten().to_numpy(zero_copy_only=False).astype("<f8").reshape(batch.num_rows, -1)
            block = batch.column("block").to_numpy(zero_copy_only=False)
            order = np.argsort(block, kind="stable")
            starts = np.flatnonzero(np.diff(block[order], prepend=-1))
            parts = np.split(order, starts[1:])
            ids = batch.column("id").take(pa.array(order))
            offsets = pa.array(np.append(starts, len(order)).astype("int32"))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(block[order][starts], pa.int32()), pa.ListArray.from_arrays(offsets, ids),
                    pa.array([values[p].tobytes() for p in parts], pa.binary()),
                ],
                names=["block", "ids", "vectors"],
            )

    return dealt.mapInArrow(pack, schema)


def _by_blocks(q, r, k, skip_self, schema, block_rows, rows):
    """Every query meets every reference: pairs of blocks of bounded size, k rows per query and pair."""
    least = math.ceil(math.sqrt(LEAST_TASKS))
    r_blocks = max(least, -(-rows // block_rows))
    q_blocks = max(least, -(-q.count() // block_rows))
    pairs = lambda packed, others: packed.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(others - 1))))
    queries = pairs(_packed(q, "query_id", q_blocks), r_blocks).withColumn("pair", F.col("block") * r_blocks + F.col("other"))
    references = pairs(_packed(r, "neighbor_id", r_blocks), q_blocks).withColumn("pair", F.col("other") * r_blocks + F.col("block"))
    queries, references = (side.select("pair", "ids", "vectors") for side in (queries, references))

    def opened(packed: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        ids = np.concatenate(packed["ids"].to_list())
        return ids, np.frombuffer(b"".join(packed["vectors"]), dtype="<f8").reshape(len(ids), -1)

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return _matches([], [], [], [], k, skip_self)
        (query_ids, v), (ids, w) = opened(a), opened(b)
        order = np.argsort(ids, kind="stable")
        return _matches(query_ids, v, ids[order], w[order], k, skip_self)

    # A pair costs far more than its bytes tell, so each has a partition of its own.
    dealt = q_blocks * r_blocks
    left, right = (side.repartition(dealt, "pair").groupBy("pair") for side in (queries, references))
    return left.cogroup(right).applyInPandas(meet, schema)


def knn_classify(
    train: DataFrame,
    test: DataFrame,
    vector: str,
    label: str,
    train_id: str,
    test_id: str,
    k: int = 5,
    weights: str = "uniform",
    skip_self: bool = False,
    **join_options,
) -> DataFrame:
    """Majority vote of the k nearest training rows: (id, prediction, votes share).

    ``distance`` weighs by inverse distance; rows at distance 0 then decide alone. Ties go to the
    smaller label.
    """
    near = knn_join(test, train, k, test_id, train_id, vector, (label,), skip_self, **join_options)
    if weights == "distance":
        nearest = near.groupBy("query_id").agg(F.min("distance").alias("_closest"))
        near = near.join(nearest, "query_id").withColumn(
            "_w",
            F.when(F.col("_closest") == 0, (F.col("distance") == 0).cast("double")).otherwise(
                F.try_divide(F.lit(1.0), F.col("distance"))
            ),
        )
    elif weights == "uniform":
        near = near.withColumn("_w", F.lit(1.0))
    else:
        raise ValueError(f"unknown weights {weights!r}")
    votes = near.groupBy("query_id", quoted(label)).agg(F.sum("_w").alias("_w"))
    return votes.groupBy(F.col("query_id").alias(test_id)).agg(
        F.min_by(quoted(label), F.struct((-F.col("_w")).alias("w"), F.col(quoted(label)).alias("l"))).alias("prediction"),
        (F.max("_w") / F.sum("_w")).alias("vote_share"),
    )
