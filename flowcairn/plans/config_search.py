"""Search the preparation grid: which cleaning, encoding, selection, scaling and balancing works best."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, replace
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowcairn.operators.metrics import classification_by_group
from flowcairn.operators.preparation import PrepareConfig, Preparation
from flowcairn.operators.splits import stratified_split
from flowcairn.operators.stats import best_per_group
from flowcairn.plans.models import train_model
from flowcairn.session import cut_lineage, scratch

GRID_SIZE = 108
GRID_SCHEMA = (
    "config_id int, apply_cleaning boolean, apply_encoding boolean, apply_feature_selection boolean, "
    "feature_selection_k int, apply_scaling boolean, scaling_method string, apply_resampling boolean, "
    "resampling_method string"
)


def preparation_grid(size: int = GRID_SIZE) -> list[PrepareConfig]:
    """The grid in fixed order: every valid combination with cleaning, then as many without as needed."""
    on_off = (True, False)
    combos = [
        PrepareConfig(True, encode, select, k, scale, scaler, balance, sampler)
        for encode, select, scale, balance in product(on_off, on_off, on_off, on_off)
        for k in ((10, 20, 30) if select else (None,))
        for scaler in (("RobustScaler", "StandardScaler") if scale else (None,))
        for sampler in (("SMOTE", "ADASYN") if balance else (None,))
    ]
    combos += [replace(c, apply_cleaning=False) for c in combos[: max(0, size - len(combos))]]
    return combos[:size]


def grid_table(spark: SparkSession, grid: list[PrepareConfig]) -> DataFrame:
    """The grid as rows."""
    names = [part.strip().split(" ")[0] for part in GRID_SCHEMA.split(", ")][1:]
    return spark.createDataFrame([(i, *[asdict(c)[n] for n in names]) for i, c in enumerate(grid)], GRID_SCHEMA)


def effective(config: PrepareConfig, features: int, has_text: bool) -> PrepareConfig:
    """The part of a grid point that matters for a table; equal ones are trained once."""
    if not has_text:
        config = replace(config, apply_encoding=False)
    if config.apply_feature_selection and (config.feature_selection_k or 0) >= features:
        config = replace(config, apply_feature_selection=False, feature_selection_k=None)
    return config


def search(
    df: DataFrame,
    features: list[str],
    label: str,
    keys: list[str],
    grid: list[PrepareConfig] | None = None,
    max_iter: int = 100,
    parallel: int | None = None,
    seed: int = 42,
) -> DataFrame:
    """Accuracy of a quick linear model per grid point on a 20 % stratified hold-out.

    The split is written once; every distinct stage is fitted once, on the 80 % only, and points that
    mean the same on this table are trained once. ``parallel`` points run side by side, by default one per core (at least
    4): their jobs are short and small. Rows: the grid with ``score`` and ``error``.
    """
    spark = df.sparkSession
    grid = grid or preparation_grid()
    types = dict(df.dtypes)
    has_text = any(types[c] == "string" for c in features)
    parted = cut_lineage(
        stratified_split(df.select(*keys, *features, label), label, keys, (0.8, 0.2), ("train", "test"), seed)
    )
    train = parted.where("split = 'train'").drop("split")
    test = parted.where("split = 'test'").drop("split")
    memo: dict = {}
    leaves = list(dict.fromkeys(effective(c, len(features), has_text) for c in grid))

    def score(config: PrepareConfig) -> tuple[float | None, str | None]:
        try:
            with scratch(spark):  # a point leaves its score only; synthetic rows are written once, the others are projections
                fitted = Preparation(config, label, seed, memo=memo).fit(train, features)
                ready = fitted.transform_train(train, keys)
                model = train_model("LR", ready, fitted.features, label, {"max_iter": max_iter}, seed=seed)
                predicted = model.score(fitted.transform(test)).select(label, "prediction")
                return classification_by_group(predicted, [], label).first()["accuracy"], None
        except Exception as error:  # a failing point keeps its place in the result
            return None, f"{type(error).__name__}: {error}"

    # Shared stages first, one by one, so the parallel points find them fitted.
    seen = set()
    for config in leaves:
        stages = (config.apply_cleaning, config.apply_encoding, config.apply_feature_selection, config.scaling_method)
        if stages not in seen:
            seen.add(stages)
            try:
                Preparation(config, label, seed, memo=memo).fit(train, features)
            except Exception:  # the point itself reports the error below
                continue
    with ThreadPoolExecutor(max_workers=parallel or max(4, spark.sparkContext.defaultParallelism)) as pool:
        found = dict(zip(leaves, pool.map(score, leaves)))
    scored = [(i, *found[effective(c, len(features), has_text)]) for i, c in enumerate(grid)]
    points = spark.createDataFrame(scored, "config_id int, score double, error string")
    return grid_table(spark, grid).join(points, "config_id")


def ranked(results: DataFrame) -> DataFrame:
    """Results by falling score, ties by grid order."""
    return results.orderBy(F.desc_nulls_last("score"), "config_id")


def best(results: DataFrame) -> DataFrame:
    """The first grid point with the highest score."""
    return best_per_group(results, [], "score", "config_id")
