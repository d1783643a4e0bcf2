"""Detection metrics from predictions: counts first, ratios from the counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowcairn.functions.numeric import quoted
from flowcairn.operators.ordering import bucket_count, bucket_edges, running_sums, with_buckets


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction", by: list[str] | None = None) -> DataFrame:
    """Row count per (group, label, prediction)."""
    keys = [*(by or []), label, prediction]
    return df.groupBy(*[quoted(k) for k in keys]).agg(F.count(F.lit(1)).alias("n"))


def ratio(top: Column, bottom: Column) -> Column:
    """Quotient with 0 for a zero divisor."""
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def classification_by_group(
    df: DataFrame, by: list[str], label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    """Binary counts and positive-class metrics per group; one aggregate, partial before the shuffle."""
    y, p = F.col(quoted(label)).cast("int"), F.col(quoted(prediction)).cast("int")
    counts = df.groupBy(*[quoted(b) for b in by]).agg(
        F.count_if((y == 1) & (p == 1)).alias("tp"),
        F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"),
        F.count_if((y == 0) & (p == 0)).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.withColumns(
        {
            "precision": ratio(tp, tp + fp),
            "recall": ratio(tp, tp + fn),
            "f1": ratio(2 * tp, 2 * tp + fp + fn),
            "accuracy": ratio(tp + tn, tp + fp + fn + tn),
        }
    )


def per_class(df: DataFrame, label: str = "label", prediction: str = "prediction", by: list[str] | None = None) -> DataFrame:
    """TP, FP, FN, support and metrics per class, from the confusion table."""
    by = by or []
    cells = confusion(df, label, prediction, by)
    hit = F.when(F.col(quoted(label)) == F.col(quoted(prediction)), F.col("n")).otherwise(0)
    actual = cells.groupBy(*by, F.col(quoted(label)).alias("class")).agg(F.sum("n").alias("support"), F.sum(hit).alias("tp"))
    claimed = cells.groupBy(*by, F.col(quoted(prediction)).alias("class")).agg(F.sum("n").alias("claimed"))
    zero = F.lit(0).cast("long")
    out = actual.join(claimed, [*by, "class"], "full").select(
        *by,
        "class",
        F.coalesce("support", zero).alias("support"),
        F.coalesce("tp", zero).alias("tp"),
        F.coalesce("claimed", zero).alias("claimed"),
    )
    tp, support, claims = F.col("tp"), F.col("support"), F.col("claimed")
    return out.select(
        *by,
        "class",
        "support",
        "tp",
        (claims - tp).alias("fp"),
        (support - tp).alias("fn"),
        ratio(tp, claims).alias("precision"),
        ratio(tp, support).alias("recall"),
        ratio(2 * tp, claims + support).alias("f1"),
    )


def weighted_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction", by: list[str] | None = None) -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1 for any number of classes."""
    by = by or []
    classes = per_class(df, label, prediction, by)
    total = F.sum("support")
    return classes.groupBy(*by).agg(
        ratio(F.sum("tp"), total).alias("accuracy"),
        *[ratio(F.sum(F.col(m) * F.col("support")), total).alias(m) for m in ("precision", "recall", "f1")],
    )


def metrics(df: DataFrame, label: str = "label", prediction: str = "prediction", classes: int = 2) -> DataFrame:
    """Positive-class metrics for two classes, support-weighted ones otherwise."""
    if classes == 2:
        return classification_by_group(df, [], label, prediction).select("f1", "precision", "recall", "accuracy")
    return weighted_metrics(df, label, prediction).select("f1", "precision", "recall", "accuracy")


def _score_counts(df: DataFrame, score: str, label: str, by: list[str]) -> DataFrame:
    scored = df.select(*[quoted(b) for b in by], F.col(quoted(score)).cast("double").alias("score"), F.col(quoted(label)).cast("int").alias("_y"))
    edges = bucket_edges(scored, ["score"], bucket_count(df))
    return (
        with_buckets(scored, edges)
        .where(F.col("score").isNotNull() & ~F.isnan("score"))
        .groupBy(*by, "score_bucket", "score")
        .agg(F.count_if(F.col("_y") == 1).alias("pos"), F.count_if(F.col("_y") != 1).alias("neg"))
    )


def roc_auc(df: DataFrame, score: str = "score", label: str = "label", by: list[str] | None = None) -> DataFrame:
    """Exact area under the ROC curve per group; tied scores count half. One class only gives NULL.

    Rows collapse to counts per distinct score before any sort.
    """
    by = by or []
    counts = _score_counts(df, score, label, by)
    below = running_sums(counts, by, "score_bucket", "score", {"neg_upto": "neg"})
    won = F.col("pos") * (F.col("neg_upto") - F.col("neg") / 2)
    return below.groupBy(*by).agg(
        F.sum("pos").alias("positives"),
        F.sum("neg").alias("negatives"),
        F.try_divide(F.sum(won), F.sum("pos").cast("double") * F.sum("neg").cast("double")).alias("auc"),
    )


def curve_points(df: DataFrame, score: str = "score", label: str = "label", by: list[str] | None = None) -> DataFrame:
    """ROC and precision–recall points: one row per distinct threshold, highest first."""
    by = by or []
    counts = _score_counts(df, score, label, by)
    sums = [F.sum("pos").alias("_p"), F.sum("neg").alias("_n")]
    above = running_sums(counts, by, "score_bucket", "score", {"tp": "pos", "fp": "neg"}, prefix=False)
    if by:
        joined = above.join(counts.groupBy(*by).agg(*sums), by)
    else:
        joined = above.withColumn("_t", counts.agg(F.struct(*sums)).scalar()).select("*", "_t._p", "_t._n")
    return joined.select(
        *by,
        F.col("score").alias("threshold"),
        "tp",
        "fp",
        ratio(F.col("tp"), F.col("_p")).alias("tpr"),
        ratio(F.col("fp"), F.col("_n")).alias("fpr"),
        ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
    )


def normalized_confusion(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Confusion counts with the share of the row's true class."""
    cells = confusion(df, label, prediction)
    totals = cells.groupBy(quoted(label)).agg(F.sum("n").alias("_total"))
    return cells.join(totals, label).withColumn("share", F.col("n") / F.col("_total")).drop("_total")


def fit_diagnosis(f1: Column, train_f1: Column | None = None, gap: float = 0.1) -> Column:
    """Fit verdict by test F1; with the training F1 a large gap counts as overfitting too."""
    over = f1 > 0.98
    if train_f1 is not None:
        over = over | (train_f1 - f1 > gap)
    return F.when(over, "overfit_suspected").when(f1 < 0.5, "underfit_suspected").otherwise("ok")
