"""Scores of evaluated models on detection, resources and explainability.

All take a table with one row per model. Column extremes come from one scalar subquery, so the same
expressions work on five models or on millions of alternatives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowcairn.functions.numeric import quoted

# Native interpretability per model family; an unknown family is halfway.
NATIVE_INTERPRETABILITY = {
    "Logistic_Regression": 1.0,
    "Decision_Tree": 1.0,
    "Random_Forest": 1.0,
    "CNN": 0.0,
    "TabNet": 0.0,
    "LR": 1.0,
    "DT": 1.0,
    "RF": 1.0,
}
RESOURCE_WEIGHTS = (0.5, 0.3, 0.2)
EXPLAIN_WEIGHTS = (0.5, 0.3, 0.2)


def with_extremes(df: DataFrame, columns: list[str]) -> DataFrame:
    """Add the struct ``_x`` with min and max of every column over the whole table."""
    fields = []
    for i, c in enumerate(columns):
        fields += [F.min(quoted(c)).alias(f"lo{i}"), F.max(quoted(c)).alias(f"hi{i}")]
    return df.withColumn("_x", df.agg(F.struct(*fields)).scalar())


def resource_efficiency(
    df: DataFrame,
    time: str = "train_time_sec",
    ram: str = "peak_ram_mb",
    latency: str = "latency_ms",
    weights: tuple[float, float, float] = RESOURCE_WEIGHTS,
    eps: float = 1e-6,
) -> DataFrame:
    """Add ``eff_<column>`` and ``resource_score``; lower readings score higher, a constant column 1.

    A reading that is absent from the table counts 0.
    """
    present = [c for c in (time, ram, latency) if c in df.columns]
    out = with_extremes(df, present)
    score: Column = F.lit(0.0)
    for c, w in zip((time, ram, latency), weights):
        if c not in present:
            continue
        i = present.index(c)
        low, high = F.col(f"_x.lo{i}"), F.col(f"_x.hi{i}")
        inverted = F.lit(1.0) - (F.col(quoted(c)) - low) / (high - low + F.lit(eps))
        out = out.withColumn(f"eff_{c}", F.when(high > low, inverted).otherwise(F.lit(1.0)))
        score = score + F.lit(w) * F.col(f"eff_{c}")
    return out.withColumn("resource_score", score).drop("_x")


def combined_explainability(
    native: Column, shap: Column, lime: Column, weights: tuple[float, float, float] = EXPLAIN_WEIGHTS
) -> Column:
    """Weighted native, SHAP and LIME scores; missing parts drop out and the weights are rescaled."""
    w_native, w_shap, w_lime = (F.lit(w) for w in weights)
    has_shap = shap.isNotNull() & ~F.isnan(shap)
    has_lime = lime.isNotNull() & ~F.isnan(lime)
    total = w_native + F.when(has_shap, w_shap).otherwise(0.0) + F.when(has_lime, w_lime).otherwise(0.0)
    score = (
        w_native * native
        + F.when(has_shap, w_shap * F.least(shap, F.lit(1.0))).otherwise(0.0)
        + F.when(has_lime, w_lime * F.least(lime, F.lit(1.0))).otherwise(0.0)
    )
    return score / total


def native_score(model: Column) -> Column:
    """Native interpretability by model name."""
    out: Column | None = None
    for name, value in NATIVE_INTERPRETABILITY.items():
        out = F.when(model == name, value) if out is None else out.when(model == name, value)
    return out.otherwise(F.lit(0.5))


def dimension_scores(
    df: DataFrame,
    model: str = "model_name",
    f1: str = "f1_score",
    time: str = "training_time_seconds",
    memory: str = "memory_used_mb",
    explainability: str = "explainability_score",
    eps: float = 1e-10,
) -> DataFrame:
    """Detection (min–max F1), resources (0.6 time + 0.4 memory, inverted) and explainability per model.

    Pass one row per model: fold rows have to be averaged first.
    """
    out = with_extremes(df, [f1, time, memory])

    def unit(c: str, i: int) -> Column:
        return (F.col(quoted(c)) - F.col(f"_x.lo{i}")) / (F.col(f"_x.hi{i}") - F.col(f"_x.lo{i}") + F.lit(eps))

    return out.select(
        F.col(quoted(model)).alias("model_name"),
        unit(f1, 0).alias("detection_performance"),
        (F.lit(0.6) * (F.lit(1.0) - unit(time, 1)) + F.lit(0.4) * (F.lit(1.0) - unit(memory, 2))).alias(
            "resource_efficiency"
        ),
        F.col(quoted(explainability)).alias("explainability"),
    )


def band(value: Column, cuts: list[tuple[float, str]], lowest: str) -> Column:
    """Text of the first cut the value lies above."""
    out: Column | None = None
    for cut, text in cuts:
        out = F.when(value > cut, text) if out is None else out.when(value > cut, text)
    return out.otherwise(lowest)


def report(df: DataFrame) -> DataFrame:
    """Bands, strengths and weaknesses per model from its three scores.

    Needs ``f1_score``, ``resource_efficiency`` and ``explainability_score``.
    """
    f1, res, exp = F.col("f1_score"), F.col("resource_efficiency"), F.col("explainability_score")
    return df.withColumns(
        {
            "performance_band": band(f1, [(0.9, "excellent"), (0.7, "good"), (0.5, "acceptable")], "insufficient"),
            "resource_band": band(res, [(0.8, "very efficient"), (0.5, "efficient"), (0.3, "moderate")], "inefficient"),
            "explain_band": band(exp, [(0.7, "highly explainable"), (0.4, "moderately explainable")], "black box"),
            "strengths": F.array_compact(
                F.array(
                    F.when(f1 > 0.85, "detection"), F.when(res > 0.7, "resources"), F.when(exp > 0.6, "explainability")
                )
            ),
            "weaknesses": F.array_compact(
                F.array(
                    F.when(f1 < 0.7, "detection"), F.when(res < 0.4, "resources"), F.when(exp < 0.3, "explainability")
                )
            ),
        }
    )
