"""Numeric column expressions with one set of rules for NULL, NaN and infinity.

``NaN`` counts as missing and becomes NULL at ingest; ``±inf`` is a separate class of bad value that
cleaning has to deal with before imputation.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INF = float("inf")


def _col(c: Column | str) -> Column:
    return F.col(quoted(c)) if isinstance(c, str) else c


def quoted(name: str) -> str:
    """Back-quote a column name, so names with dots, blanks or slashes resolve."""
    return "`" + name.replace("`", "``") + "`"


def sql_literal(value: float) -> str:
    """A double as SQL text."""
    if math.isinf(value):
        return "double('Infinity')" if value > 0 else "double('-Infinity')"
    return f"{float(value)!r}D"


def raw_number_sql(name: str, text: bool = True) -> str:
    """SQL of a column as double, NaN still in it."""
    q = quoted(name)
    value = f"try_cast({q} AS DOUBLE)"
    return f"CASE WHEN NOT (CAST({q} AS STRING) RLIKE '[0-9.][dDfF] *$') THEN {value} END" if text else value


def number_sql(name: str, text: bool = True) -> str:
    """SQL of ``as_number``. Wide tables use SQL text: one call per column instead of one per node."""
    return f"nullif({raw_number_sql(name, text)}, double('NaN'))"


def finite_sql(name: str) -> str:
    """SQL of ``is_finite``; NaN sorts above infinity, so one comparison covers both.

    Kept short on purpose: a filter pushed through projections repeats the text it tests.
    """
    return f"coalesce(abs({quoted(name)}) < double('Infinity'), false)"


def as_number(c: Column | str, text: bool = True) -> Column:
    """Coerce to double; text that is no number, and NaN, become NULL.

    Java's parser also takes a type suffix (``1.5d``), which is text to every CSV reader.
    """
    if isinstance(c, str):
        return F.expr(number_sql(c, text))
    value = c.try_cast("double")
    if text:
        suffixed = c.cast("string").rlike("[0-9.][dDfF] *$")
        value = F.when(~suffixed, value)
    return F.when(~F.isnan(value), value)


def is_finite(c: Column | str) -> Column:
    """True for a present, finite number; never NULL."""
    if isinstance(c, str):
        return F.expr(finite_sql(c))
    return F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(INF)), F.lit(False))


def is_valid_ratio(c: Column | str) -> Column:
    """True for a finite, strictly positive number; never NULL."""
    c = _col(c)
    return F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(INF)) & (c > 0), F.lit(False))


def clip_sql(value: str, low: float, high: float) -> str:
    """Bound an SQL value; NULL passes through, where ``least``/``greatest`` alone would replace it."""
    return f"CASE WHEN {value} IS NOT NULL THEN least(greatest({value}, {sql_literal(low)}), {sql_literal(high)}) END"


def clip(name: str, low: float = -INF, high: float = INF) -> Column:
    """Bound a column; NULL and NaN pass through."""
    q = quoted(name)
    return F.expr(f"CASE WHEN isnan({q}) THEN {q} ELSE {clip_sql(q, low, high)} END")


def numeric_columns(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    """Names of the numeric columns, in schema order."""
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def coerce_all(df: DataFrame, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Coerce every column outside ``exclude`` to double in one projection."""
    types = dict(df.dtypes)
    return df.select(
        *[
            F.col(quoted(c)) if c in exclude else as_number(c, text=types[c] == "string").alias(c)
            for c in df.columns
        ]
    )


def numeric_only(df: DataFrame, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Keep numeric columns only, missing → 0; ``exclude`` columns are kept untouched."""
    keep = [c for c in df.columns if c in exclude] + numeric_columns(df, exclude)
    out = df.select(*[quoted(c) for c in keep])
    return out.na.fill(0, subset=numeric_columns(df, exclude))
