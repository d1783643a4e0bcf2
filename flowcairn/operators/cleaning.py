"""Fit/transform stages for numeric and text features.

``fit`` runs aggregates over the training rows and keeps plain numbers; ``transform`` is a projection
of literals, so it works on batch and streaming tables alike and never looks at the rows it changes.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowcairn.functions.numeric import INF, as_number, clip_sql, finite_sql, quoted, raw_number_sql, sql_literal
from flowcairn.operators.ordering import bucket_count, running_sums
from flowcairn.operators.quantiles import COLUMNS_PER_AGGREGATE, quantiles
from flowcairn.session import cut_lineage

DEFAULT_CLIP = (0.001, 0.999)


def _replace(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """Replace columns in place, keeping the column order."""
    return df.select(*[new[c].alias(c) if c in new else F.col(quoted(c)) for c in df.columns])


def _in_chunks(columns: list[str]):
    for start in range(0, len(columns), COLUMNS_PER_AGGREGATE):
        yield columns[start : start + COLUMNS_PER_AGGREGATE]


@dataclass(frozen=True)
class CleanModel:
    """Fitted cleaning: kept columns, finite extremes, clip bounds and medians."""

    columns: list[str]
    dropped: list[str]
    inf_as_extreme: bool
    extremes: dict[str, tuple[float, float]]
    bounds: dict[str, tuple[float, float]]
    cap: float | None
    medians: dict[str, float] = field(default_factory=dict)

    def expression(self, c: str, value: str, outliers: bool) -> str:
        """SQL of the cleaned column; ``value`` is the SQL of its number, NaN allowed."""
        if self.inf_as_extreme:
            low, high = self.extremes[c]
            value = f"nullif({value}, double('NaN'))"
            value = (
                f"CASE {value} WHEN double('Infinity') THEN {sql_literal(high)} "
                f"WHEN double('-Infinity') THEN {sql_literal(low)} ELSE {value} END"
            )
        else:
            value = f"CASE WHEN abs({value}) < double('Infinity') THEN {value} END"
        limits = self.limits(c) if outliers else None
        if limits:
            value = clip_sql(value, *limits)
        if c in self.medians:
            value = f"coalesce({value}, {sql_literal(self.medians[c])})"
        return value

    def limits(self, c: str) -> tuple[float, float] | None:
        """Clip bounds of a column with the absolute cap worked in."""
        bounds = self.bounds.get(c)
        if self.cap is None:
            return bounds
        low, high = bounds or (-INF, INF)
        return min(max(low, -self.cap), self.cap), min(max(high, -self.cap), self.cap)

    def transform(self, df: DataFrame, outliers: bool = False) -> DataFrame:
        """Clean a table. Outlier clipping belongs to the training rows, so it is off by default."""
        types = dict(df.dtypes)
        kept = df.drop(*self.dropped)
        return _replace(
            kept,
            {c: F.expr(self.expression(c, raw_number_sql(c, types[c] == "string"), outliers)) for c in self.columns},
        )


@dataclass(frozen=True)
class Cleaner:
    """Coerce, treat infinities, clip outliers, drop empty columns and impute medians."""

    inf_as_extreme: bool = False
    clip_quantiles: tuple[float, float] | None = DEFAULT_CLIP
    cap: float | None = None
    impute: bool = True
    mode: str = "exact"

    def fit(self, df: DataFrame, columns: list[str]) -> CleanModel:
        types = dict(df.dtypes)
        numbers = df.selectExpr(*[f"{raw_number_sql(c, types[c] == 'string')} AS {quoted(c)}" for c in columns])
        extremes: dict[str, tuple[float, float]] = {}
        dropped: list[str] = []
        for part in _in_chunks(columns):
            aggregates = []
            for i, c in enumerate(part):
                finite = f"CASE WHEN {finite_sql(c)} THEN {quoted(c)} END"
                present = f"nullif({quoted(c)}, double('NaN'))" if self.inf_as_extreme else finite
                aggregates += [
                    F.expr(f"count({present}) AS n{i}"),
                    F.expr(f"min({finite}) AS l{i}"),
                    F.expr(f"max({finite}) AS h{i}"),
                ]
            row = numbers.agg(*aggregates).first()
            for i, c in enumerate(part):
                if row[f"n{i}"] == 0:
                    dropped.append(c)
                else:  # a column of infinities only has no finite extreme and becomes 0
                    extremes[c] = (row[f"l{i}"], row[f"h{i}"]) if row[f"l{i}"] is not None else (0.0, 0.0)
        kept = [c for c in columns if c not in dropped]
        model = CleanModel(kept, dropped, self.inf_as_extreme, extremes, {}, self.cap)
        if not kept or (self.clip_quantiles is None and not self.impute):
            return model
        settled = numbers.selectExpr(*[f"{model.expression(c, quoted(c), False)} AS {quoted(c)}" for c in kept])
        probs = [*(self.clip_quantiles or ()), 0.5]
        found = quantiles(settled, kept, probs, self.mode)
        bounds = {c: (q[0], q[1]) for c, q in found.items()} if self.clip_quantiles else {}
        middle = {c: q[-1] for c, q in found.items()}
        if self.cap is not None and self.impute:  # capping may move the two middle values
            clipped = CleanModel(kept, dropped, self.inf_as_extreme, extremes, bounds, self.cap)
            capped = numbers.selectExpr(*[f"{clipped.expression(c, quoted(c), True)} AS {quoted(c)}" for c in kept])
            middle = {c: q[0] for c, q in quantiles(capped, kept, [0.5], self.mode).items()}
        return CleanModel(
            kept, dropped, self.inf_as_extreme, extremes, bounds, self.cap, middle if self.impute else {}
        )


def integer_target(df: DataFrame, label: str) -> DataFrame:
    """Target as int; what is no number becomes 0."""
    return df.withColumn(label, F.coalesce(as_number(label).cast("int"), F.lit(0)))


@dataclass(frozen=True)
class ScaleModel:
    """(x − center) / scale per column."""

    parameters: dict[str, tuple[float, float]]

    def transform(self, df: DataFrame) -> DataFrame:
        return _replace(
            df,
            {
                c: F.expr(f"({quoted(c)} - {sql_literal(center)}) / {sql_literal(scale)}")
                for c, (center, scale) in self.parameters.items()
            },
        )


@dataclass(frozen=True)
class RobustScaler:
    """Median and interquartile range; a constant column is only centred."""

    mode: str = "exact"

    def fit(self, df: DataFrame, columns: list[str]) -> ScaleModel:
        found = quantiles(df, columns, [0.25, 0.5, 0.75], self.mode)
        return ScaleModel(
            {c: (q[1], (q[2] - q[0]) or 1.0) for c, q in found.items() if q[1] is not None}
        )


@dataclass(frozen=True)
class StandardScaler:
    """Mean and population deviation; a constant column is only centred."""

    def fit(self, df: DataFrame, columns: list[str]) -> ScaleModel:
        parameters = {}
        for part in _in_chunks(columns):
            row = df.agg(
                *[F.expr(f"avg({quoted(c)}) AS m{i}") for i, c in enumerate(part)],
                *[F.expr(f"stddev_pop({quoted(c)}) AS s{i}") for i, c in enumerate(part)],
            ).first()
            for i, c in enumerate(part):
                if row[f"m{i}"] is not None:
                    parameters[c] = (row[f"m{i}"], row[f"s{i}"] or 1.0)
        return ScaleModel(parameters)


SCALERS = {"RobustScaler": RobustScaler, "StandardScaler": StandardScaler}


@dataclass(frozen=True)
class EncodeModel:
    """Codes per text column: a literal map for few values, a written table for many."""

    maps: dict[str, dict[str, int]]
    tables: dict[str, tuple[DataFrame, int]]

    def transform(self, df: DataFrame) -> DataFrame:
        new = {}
        for c, codes in self.maps.items():
            value = F.coalesce(F.col(quoted(c)).cast("string"), F.lit("unknown"))
            pairs = [F.lit(x) for pair in codes.items() for x in pair]
            found = F.try_element_at(F.create_map(*pairs), value) if pairs else F.lit(None)
            new[c] = F.coalesce(found, F.lit(len(codes))).cast("double")
        out = _replace(df, new) if new else df
        for c, (table, size) in self.tables.items():
            value = F.coalesce(F.col(quoted(c)).cast("string"), F.lit("unknown"))
            joined = out.withColumn("_value", value).join(table, "_value", "left").drop("_value")
            out = _replace(joined, {c: F.coalesce(F.col("_code"), F.lit(size)).cast("double")}).drop("_code")
        return out


@dataclass(frozen=True)
class Encoder:
    """Text to codes 0..n−1 in sorted order; missing is ``unknown``, unseen values share code n."""

    literal_values: int = 1000

    def fit(self, df: DataFrame, columns: list[str]) -> EncodeModel:
        maps, tables = {}, {}
        if not columns:
            return EncodeModel(maps, tables)
        text = df.select(
            *[F.coalesce(F.col(quoted(c)).cast("string"), F.lit("unknown")).alias(c) for c in columns]
        )
        sizes = text.agg(*[F.approx_count_distinct(quoted(c)).alias(f"n{i}") for i, c in enumerate(columns)]).first()
        for i, c in enumerate(columns):
            distinct = text.select(F.col(quoted(c)).alias("_value")).distinct()
            if sizes[f"n{i}"] <= self.literal_values:
                values = sorted(r["_value"] for r in distinct.collect())  # size checked above
                maps[c] = {v: code for code, v in enumerate(values)}
            else:
                # Edges are values drawn by hash, so buckets are even whatever prefix the values share.
                distinct = cut_lineage(distinct)
                drawn = distinct.orderBy(F.xxhash64("_value"), "_value").limit(bucket_count(df)).collect()
                edges = F.array(*[F.lit(v) for v in sorted(r["_value"] for r in drawn)])
                bucket = F.size(F.filter(edges, lambda e: e <= F.col("_value")))
                ordered = distinct.select("_value", bucket.alias("_b"), F.lit(1).alias("_one"))
                coded = running_sums(ordered, [], "_b", "_value", {"_code": "_one"})
                table = cut_lineage(coded.select("_value", (F.col("_code") - 1).alias("_code")))
                tables[c] = (table, table.count())
        return EncodeModel(maps, tables)


def narrow_types(df: DataFrame, share: float = 0.5) -> tuple[DataFrame, list[str]]:
    """double→float and long→int where every value survives, and the low-cardinality text columns.

    A double column is narrowed when all its values come back unchanged from float; missing values and
    NaN do not count against it.
    """
    types = dict(df.dtypes)
    wide = [c for c, t in types.items() if t == "bigint"]
    double = [c for c, t in types.items() if t == "double"]
    text = [c for c, t in types.items() if t == "string"]
    row = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.min(quoted(c)).alias(f"l{i}") for i, c in enumerate(wide)],
        *[F.max(quoted(c)).alias(f"h{i}") for i, c in enumerate(wide)],
        *[F.approx_count_distinct(quoted(c)).alias(f"d{i}") for i, c in enumerate(text)],
        *[F.count_if(F.col(quoted(c)).cast("float").cast("double") != F.col(quoted(c))).alias(f"f{i}") for i, c in enumerate(double)],
    ).first()
    new = {c: F.col(quoted(c)).cast("float") for i, c in enumerate(double) if row[f"f{i}"] == 0}
    new |= {c: F.col(quoted(c)).cast("int") for c, t in types.items() if t in ("tinyint", "smallint")}
    for i, c in enumerate(wide):
        low, high = row[f"l{i}"], row[f"h{i}"]
        if low is None or (low >= -(2**31) and high < 2**31):
            new[c] = F.col(quoted(c)).cast("int")
    few = [c for i, c in enumerate(text) if row["rows"] and row[f"d{i}"] / row["rows"] < share]
    return _replace(df, new), few
