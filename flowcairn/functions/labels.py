"""Binary attack labels for the two feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowcairn.functions.numeric import as_number, quoted

# Names under which a label column may appear, in order of preference.
LABEL_CANDIDATES = ("Label", "label", "Attack", "attack", "Class", "class")
# The traffic classes of the single-file feed that enter the binary problem.
BINARY_TYPES = ("normal", "ddos")


def label_column(df: DataFrame) -> str | None:
    """The first label candidate present in the table."""
    return next((c for c in LABEL_CANDIDATES if c in df.columns), None)


def _is_text(df: DataFrame, name: str) -> bool:
    return dict(df.dtypes)[name] == "string"


def _numeric_label(name: str) -> Column:
    return F.coalesce(as_number(name).cast("int"), F.lit(0))


def attack_label(df: DataFrame, name: str | None = None) -> Column:
    """Multi-file feed: everything but BENIGN is an attack, a missing text label included."""
    name = name or df.columns[-1]
    if not _is_text(df, name):
        return _numeric_label(name)
    return F.coalesce(F.upper(F.col(quoted(name))) != "BENIGN", F.lit(True)).cast("int")


def ddos_label(df: DataFrame, name: str | None = None) -> Column:
    """Single-file feed: 1 for type ``ddos``; without a type column the label column decides."""
    name = "type" if "type" in df.columns else (name or df.columns[-1])
    if name != "type" and not _is_text(df, name):
        return _numeric_label(name)
    return F.coalesce(F.lower(F.col(quoted(name)).cast("string")) == "ddos", F.lit(False)).cast("int")


def keep_binary_types(df: DataFrame, name: str = "type", require_rows: bool = False) -> DataFrame:
    """Keep rows of the two traffic classes; optionally fail when none is left (starts a job)."""
    out = df.where(F.col(quoted(name)).isin(*BINARY_TYPES))
    if require_rows and out.isEmpty():
        raise ValueError("no row has type 'normal' or 'ddos'")
    return out
