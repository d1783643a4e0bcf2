"""Predictions, neighbours, models, cross-validation, explanations and tuning."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowcairn.catalog.bindings import FEATURES, SCORED_EVENTS_SQL, event_features, lineitem, scored_events, wide_vectors
from flowcairn.catalog.registry import query, rounded, sql_round, table
from flowcairn.operators import explain, metrics
from flowcairn.operators.neighbors import knn_classify, knn_join
from flowcairn.operators.splits import stratified_split
from flowcairn.operators.tree_attribution import expected_score, mllib_trees, tree_scores, tree_shapley
from flowcairn.plans import config_search, evaluate, tuning
from flowcairn.plans.models import REGISTRY, importances, train_all, train_model
from flowcairn.plans.phases import with_key
from flowcairn.session import cut_lineage

_R = sql_round


@query("confusion", f"SELECT algo, label, prediction, count(*) AS n FROM ({SCORED_EVENTS_SQL}) s GROUP BY ALL")
def confusion(spark, sf_dir):
    return metrics.confusion(scored_events(spark, sf_dir), by=["algo"])


@query(
    "confusion_normalized",
    f"""SELECT label, prediction, count(*) AS n, {_R('count(*) / CAST(sum(count(*)) OVER (PARTITION BY label) AS DOUBLE)')} AS share
        FROM ({SCORED_EVENTS_SQL}) s GROUP BY label, prediction""",
)
def confusion_normalized(spark, sf_dir):
    return metrics.normalized_confusion(scored_events(spark, sf_dir)).withColumn("share", rounded("share"))


@query(
    "binary_metrics",
    f"""SELECT {_R('2.0 * tp / (2 * tp + fp + fn)')} AS f1, {_R('tp / CAST(tp + fp AS DOUBLE)')} AS "precision",
          {_R('tp / CAST(tp + fn AS DOUBLE)')} AS recall, {_R('(tp + tn) / CAST(tp + fp + fn + tn AS DOUBLE)')} AS accuracy
        FROM (SELECT count(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp, count(*) FILTER (WHERE label = 0 AND prediction = 1) AS fp,
                     count(*) FILTER (WHERE label = 1 AND prediction = 0) AS fn, count(*) FILTER (WHERE label = 0 AND prediction = 0) AS tn
              FROM ({SCORED_EVENTS_SQL}) s) c""",
)
def binary_metrics(spark, sf_dir):
    out = metrics.metrics(scored_events(spark, sf_dir))
    return out.select(*[rounded(c).alias(c) for c in out.columns])


# Quality against toxicity as a second problem with rare classes: prediction = the other flag's complement.
_CLASSES_SQL = "SELECT quality + 2 * toxic AS label, CASE WHEN n_chars % 3 = 0 THEN quality ELSE quality + 2 * toxic END AS prediction FROM labels JOIN documents USING (doc_id)"


def _classes(spark, sf_dir):
    both = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    label = F.col("quality") + 2 * F.col("toxic")
    return both.select(
        label.alias("label"), F.when(F.col("n_chars") % 3 == 0, F.col("quality")).otherwise(label).alias("prediction")
    )


_PER_CLASS_SQL = f"""
  WITH s AS ({_CLASSES_SQL}), k AS (SELECT DISTINCT label AS class FROM s UNION SELECT DISTINCT prediction FROM s)
  SELECT class, (SELECT count(*) FROM s WHERE label = class) AS support,
         (SELECT count(*) FROM s WHERE label = class AND prediction = class) AS tp,
         (SELECT count(*) FROM s WHERE label <> class AND prediction = class) AS fp,
         (SELECT count(*) FROM s WHERE label = class AND prediction <> class) AS fn FROM k
"""


def _q(top: str, bottom: str) -> str:
    return f"CASE WHEN {bottom} = 0 THEN 0.0 ELSE {top} / CAST({bottom} AS DOUBLE) END"


@query(
    "per_class_metrics",
    f"""SELECT class, support, tp, fp, fn, {_R(_q('tp', '(tp + fp)'))} AS "precision", {_R(_q('tp', '(tp + fn)'))} AS recall,
               {_R(_q('2.0 * tp', '(2 * tp + fp + fn)'))} AS f1 FROM ({_PER_CLASS_SQL}) c""",
)
def per_class_metrics(spark, sf_dir):
    out = metrics.per_class(_classes(spark, sf_dir))
    return out.withColumns({c: rounded(c) for c in ("precision", "recall", "f1")})


@query(
    "weighted_metrics",
    f"""SELECT {_R('sum(tp) / CAST(sum(support) AS DOUBLE)')} AS accuracy,
          {_R(f"sum({_q('tp', '(tp + fp)')} * support) / sum(support)")} AS "precision",
          {_R(f"sum({_q('tp', '(tp + fn)')} * support) / sum(support)")} AS recall,
          {_R(f"sum({_q('2.0 * tp', '(2 * tp + fp + fn)')} * support) / sum(support)")} AS f1
        FROM ({_PER_CLASS_SQL}) c""",
)
def weighted_metrics(spark, sf_dir):
    out = metrics.weighted_metrics(_classes(spark, sf_dir))
    return out.select(*[rounded(c).alias(c) for c in out.columns])


@query(
    "roc_auc",
    f"""SELECT algo, positives, negatives, {_R('(ranks - positives * (positives + 1) / 2.0) / (CAST(positives AS DOUBLE) * negatives)', 9)} AS auc
        FROM (SELECT algo, sum(label) AS positives, count(*) - sum(label) AS negatives, sum(rk) FILTER (WHERE label = 1) AS ranks
              FROM (SELECT algo, label, rank() OVER (PARTITION BY algo ORDER BY score)
                      + (count(*) OVER (PARTITION BY algo, score) - 1) / 2.0 AS rk FROM ({SCORED_EVENTS_SQL}) s) r GROUP BY algo) t""",
)
def roc_auc(spark, sf_dir):
    """Area under the curve per algorithm, ties counted half."""
    return metrics.roc_auc(scored_events(spark, sf_dir), by=["algo"]).withColumn("auc", rounded("auc", 9))


@query(
    "roc_points",
    f"""SELECT threshold, tp, fp, {_R('tp / CAST(p AS DOUBLE)')} AS tpr, {_R('fp / CAST(n AS DOUBLE)')} AS fpr,
          {_R('tp / CAST(tp + fp AS DOUBLE)')} AS "precision"
        FROM (SELECT score AS threshold, sum(sum(label)) OVER (ORDER BY score DESC) AS tp, sum(count(*) - sum(label)) OVER (ORDER BY score DESC) AS fp,
                     sum(sum(label)) OVER () AS p, sum(count(*) - sum(label)) OVER () AS n
              FROM ({SCORED_EVENTS_SQL}) s GROUP BY score) t""",
)
def roc_points(spark, sf_dir):
    """ROC and precision–recall points of all thresholds."""
    out = metrics.curve_points(scored_events(spark, sf_dir))
    return out.withColumns({c: rounded(c) for c in ("tpr", "fpr", "precision")})


@query(
    "fit_diagnosis",
    f"""SELECT algo, fold, CASE WHEN f1 > 0.98 THEN 'overfit_suspected' WHEN f1 < 0.5 THEN 'underfit_suspected' ELSE 'ok' END AS verdict
        FROM (SELECT algo, fold, 2.0 * count(*) FILTER (WHERE label = 1 AND prediction = 1)
              / (2 * count(*) FILTER (WHERE label = 1 AND prediction = 1) + count(*) FILTER (WHERE label <> prediction)) AS f1
              FROM ({SCORED_EVENTS_SQL}) s GROUP BY algo, fold) m""",
)
def fit_diagnosis(spark, sf_dir):
    by_fold = metrics.classification_by_group(scored_events(spark, sf_dir), ["algo", "fold"])
    return by_fold.select("algo", "fold", metrics.fit_diagnosis(F.col("f1")).alias("verdict"))


_NEAR_SQL = """
  SELECT q, n, label, distance, row_number() OVER (PARTITION BY q ORDER BY distance, n) AS rank
  FROM (SELECT a.vec_id AS q, b.vec_id AS n, b.label AS label,
               list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS distance
        FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id) p
"""


@query(
    "knn_join",
    f"SELECT q AS query_id, n AS neighbor_id, rank, {_R('distance')} AS distance FROM ({_NEAR_SQL}) d WHERE rank <= 5",
)
def nearest_neighbors(spark, sf_dir):
    """The five nearest other vectors of every vector."""
    df = table(spark, sf_dir, "embeddings")
    out = knn_join(df, df, 5, "vec_id", "vec_id", "embedding", skip_self=True)
    return out.withColumn("distance", rounded("distance"))


@query(
    "knn_join_cells",
    f"SELECT q AS query_id, n AS neighbor_id, rank, {_R('distance')} AS distance FROM ({_NEAR_SQL}) d WHERE rank <= 5",
)
def nearest_neighbors_by_cells(spark, sf_dir):
    """The same neighbours by the partitioned search that takes over beyond the broadcast size."""
    df = table(spark, sf_dir, "embeddings")
    out = knn_join(df, df, 5, "vec_id", "vec_id", "embedding", skip_self=True, broadcast_bytes=0, pivots=8)
    return out.withColumn("distance", rounded("distance"))


@query(
    "knn_join_tree",
    """WITH d AS (SELECT c_custkey AS query_id, o_orderkey AS neighbor_id,
                         sqrt(pow(c_acctbal / 20.0 - o_totalprice / 1000.0, 2) + pow(c_custkey % 100 - o_custkey % 100, 2)) AS d FROM customer, orders),
            r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, neighbor_id) AS rank FROM d)
       SELECT query_id, neighbor_id, CAST(rank AS INT) AS rank, """
    + f"{_R('d')} AS distance FROM r WHERE rank <= 3",
)
def nearest_orders(spark, sf_dir):
    """The three orders nearest to each customer by money and group, among all orders, by a tree of balls."""
    vector = lambda money, group: F.array(money, (F.col(group) % 100).cast("double")).alias("vec")
    customers = table(spark, sf_dir, "customer").select("c_custkey", vector(F.col("c_acctbal") / 20.0, "c_custkey"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", vector(F.col("o_totalprice") / 1000.0, "o_custkey"))
    out = knn_join(customers, orders, 3, "c_custkey", "o_orderkey", "vec", broadcast_bytes=0, slice_rows=1_000)
    return out.withColumn("distance", rounded("distance"))


@query(
    "knn_classify",
    f"""SELECT vec_id, prediction, {_R('votes / 5.0')} AS vote_share FROM (
          SELECT q AS vec_id, label AS prediction, count(*) AS votes,
                 row_number() OVER (PARTITION BY q ORDER BY count(*) DESC, label) AS place
          FROM ({_NEAR_SQL}) d WHERE rank <= 5 GROUP BY q, label) v WHERE place = 1""",
)
def classify_by_neighbors(spark, sf_dir):
    """Leave-one-out vote of the five nearest vectors."""
    df = table(spark, sf_dir, "embeddings")
    out = knn_classify(df, df, "embedding", "label", "vec_id", "vec_id", 5, skip_self=True)
    return out.withColumn("vote_share", rounded("vote_share"))


def _keyed_lineitem(spark, sf_dir):
    """The line items' features and label with a row key; many rows are equal but for the key."""
    return with_key(lineitem(spark, sf_dir).select(*FEATURES, "label"))


def _cv(spark, sf_dir, names, params=None, explained=False):
    """Five-fold cross-validation on all dimensions of the embeddings."""
    df, features = wide_vectors(spark, sf_dir)
    return evaluate.cross_validate(df, names, features, "label", ["vec_id"], 5, params, explain=explained)


def _checked(results):
    """Per model and fold: test rows, and whether the metrics are those of the stored confusion cells.

    Two classes are checked by the positive class, more by the means over classes weighted by their rows.
    A fold that failed has no rows and is not consistent.
    """
    cells = "confusion_matrix"
    number = lambda e: F.expr(f"CAST({e} AS DOUBLE)")
    out = results.withColumns({
        "_n": F.expr(f"aggregate(flatten({cells}), 0L, (s, x) -> s + x)"),
        "_right": F.expr(f"aggregate(transform({cells}, (r, i) -> r[i]), 0L, (s, x) -> s + x)"),
        "_tp": number(f"{cells}[1][1]"), "_fp": number(f"{cells}[0][1]"), "_fn": number(f"{cells}[1][0]"),
    })
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    precision, recall = share(F.col("_tp"), F.col("_tp") + F.col("_fp")), share(F.col("_tp"), F.col("_tp") + F.col("_fn"))
    binary = (F.abs(F.col("precision") - precision) < 1e-9) & (F.abs(F.col("recall") - recall) < 1e-9)
    binary = binary & (F.abs(F.col("f1") - share(2 * precision * recall, precision + recall)) < 1e-9)
    # Of class i: rows, hits and predictions.
    held, hit = f"aggregate({cells}[i], 0L, (s, x) -> s + x)", f"{cells}[i][i]"
    called = f"aggregate(transform({cells}, r -> r[i]), 0L, (s, x) -> s + x)"
    several = F.lit(True)
    for name, top, bottom in (("precision", hit, called), ("recall", hit, held), ("f1", f"2 * {hit}", f"({held} + {called})")):
        of_class = f"coalesce(try_divide(CAST({top} AS DOUBLE), CAST({bottom} AS DOUBLE)), 0D) * {held}"
        total = F.expr(f"aggregate(transform(sequence(0, size({cells}) - 1), i -> {of_class}), 0D, (s, x) -> s + x)")
        several = several & (F.abs(F.col(name) - F.try_divide(total, F.col("_n"))) < 1e-9)
    right = F.when(F.size(cells) > 2, several).otherwise(binary)
    same = (F.abs(F.col("accuracy") - F.col("_right") / F.col("_n")) < 1e-9) & right & F.col("error").isNull()
    return out.select("algo", F.col("fold").cast("int").alias("fold"), F.col("_n").alias("n"), F.coalesce(same, F.lit(False)).alias("consistent"))


def _folds_sql(algo: str, source: str) -> str:
    """Test rows of stratified folds: every class deals its rows to the folds in turn."""
    return f"""SELECT '{algo}' AS algo, CAST(fold AS INT) AS fold, CAST(sum((n - fold + 4) // 5) AS BIGINT) AS n, true AS consistent
      FROM (SELECT label, count(*) AS n FROM ({source}) GROUP BY label), range(5) r(fold) GROUP BY fold"""


_FLOW_LABELS = "SELECT CAST(l_returnflag <> 'N' AS INT) AS label FROM lineitem"
_VECTOR_LABELS = "SELECT CAST(label < 3 AS INT) AS label FROM embeddings"


_FOUND: dict[tuple, object] = {}


def _once(results):
    """Cross-validation results are a few rows: they are kept for ``cv_metrics``; a query of its own (``fitted``) always fits."""

    def fitted(spark, sf_dir):
        _FOUND[spark.sparkContext.applicationId, sf_dir, results.__name__] = out = results(spark, sf_dir)
        return out

    def found(spark, sf_dir):
        key = spark.sparkContext.applicationId, sf_dir, results.__name__
        return _FOUND[key] if key in _FOUND else fitted(spark, sf_dir)

    found.fitted = fitted
    return found


@_once
def _lr_cv(spark, sf_dir):
    return evaluate.cross_validate(_keyed_lineitem(spark, sf_dir), ["LR"], FEATURES, "label", ["row_key"], 5, spent=True)


@query("lr_cv", _folds_sql("LR", _FLOW_LABELS))
def lr_cv(spark, sf_dir):
    """Five-fold logistic regression on the line items, balanced and scaled inside the fold."""
    return _checked(_lr_cv.fitted(spark, sf_dir))


@_once
def _tree_cv(spark, sf_dir):
    df = _keyed_lineitem(spark, sf_dir)
    return evaluate.cross_validate(df, ["DT"], FEATURES, "label", ["row_key"], 5, {"DT": {"max_depth": 10}}, spent=True)


@query("tree_cv", _folds_sql("DT", _FLOW_LABELS))
def tree_cv(spark, sf_dir):
    """Five-fold decision tree on the line items with class weights."""
    return _checked(_tree_cv.fitted(spark, sf_dir))


@_once
def _rf_cv(spark, sf_dir):
    return _cv(spark, sf_dir, ["RF"], {"RF": {"n_estimators": 100, "max_depth": 10}})


@query("rf_cv", _folds_sql("RF", _VECTOR_LABELS))
def rf_cv(spark, sf_dir):
    return _checked(_rf_cv.fitted(spark, sf_dir))


@_once
def _gbt_cv(spark, sf_dir):
    return _cv(spark, sf_dir, ["GBT"], {"GBT": {"n_estimators": 100, "max_depth": 4}})


@query("gbt_cv", _folds_sql("GBT", _VECTOR_LABELS))
def gbt_cv(spark, sf_dir):
    return _checked(_gbt_cv.fitted(spark, sf_dir))


@_once
def _mlp_cv(spark, sf_dir):
    return _cv(spark, sf_dir, ["CNN"])


@query("mlp_cv", _folds_sql("CNN", _VECTOR_LABELS))
def mlp_cv(spark, sf_dir):
    return _checked(_mlp_cv.fitted(spark, sf_dir))


@_once
def _knn_cv(spark, sf_dir):
    return _cv(spark, sf_dir, ["KNN"])


@query("knn_cv", _folds_sql("KNN", _VECTOR_LABELS))
def knn_cv(spark, sf_dir):
    return _checked(_knn_cv.fitted(spark, sf_dir))


def _ten_labels(spark, sf_dir):
    df, features = wide_vectors(spark, sf_dir)
    return df.drop("label").join(table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("int").alias("label")), "vec_id"), features


@_once
def _multiclass_cv(spark, sf_dir):
    df, features = _ten_labels(spark, sf_dir)
    return evaluate.cross_validate(df, ["DT"], features, "label", ["vec_id"], 5, {"DT": {"max_depth": 8}})


@query("multiclass_cv", _folds_sql("DT", "SELECT label FROM embeddings"))
def multiclass_cv(spark, sf_dir):
    """Five-fold decision tree over all ten classes of the embeddings."""
    return _checked(_multiclass_cv.fitted(spark, sf_dir))


@_once
def _gbt_multiclass_cv(spark, sf_dir):
    df, features = _ten_labels(spark, sf_dir)
    return evaluate.cross_validate(df, ["GBT"], features, "label", ["vec_id"], 5, {"GBT": {"n_estimators": 100, "max_depth": 4}})


@query("gbt_multiclass_cv", _folds_sql("GBT", "SELECT label FROM embeddings"))
def gbt_multiclass_cv(spark, sf_dir):
    """Five-fold softmax boosting over all ten classes of the embeddings."""
    return _checked(_gbt_multiclass_cv.fitted(spark, sf_dir))


@query(
    "softmax_boosting",
    f"""SELECT round, CASE WHEN round = 0 THEN {_R('entropy', 9)} END AS start_loss, true AS falls, true AS gradients_cancel, true AS beats_majority
        FROM range(0, 101) r(round), (SELECT -sum(n / total * ln(n / total)) AS entropy FROM (
          SELECT CAST(count(*) AS DOUBLE) AS n, CAST(sum(count(*)) OVER () AS DOUBLE) AS total FROM embeddings GROUP BY label) c) e""",
)
def softmax_boosting(spark, sf_dir):
    """Log loss of ten-class boosting round by round: it starts at the entropy of the classes and always falls.

    In every round the gradients of a row over its classes cancel; at the end the training rows are told
    apart better than by their largest class.
    """
    df, features = _ten_labels(spark, sf_dir)
    model = train_model("GBT", df, features, params={"n_estimators": 100, "max_depth": 4}, classes=10).model
    scored = model.score(df).agg(F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("right"))
    largest = df.groupBy("label").count().agg((F.max("count") / F.sum("count")).alias("share"))
    rows = [(n, loss, loss < model.history[n - 1][1] if n else True, drift < 1e-9) for n, loss, drift in model.history]
    history = spark.createDataFrame(rows, "round long, loss double, falls boolean, gradients_cancel boolean")
    beats = scored.crossJoin(largest).select((F.col("right") > F.col("share")).alias("beats_majority"))  # one row each
    return history.crossJoin(F.broadcast(beats)).select(
        "round", F.when(F.col("round") == 0, rounded("loss", 9)).alias("start_loss"), "falls", "gradients_cancel", "beats_majority"
    )


CROSS_VALIDATIONS = {
    "lr_cv": _lr_cv, "tree_cv": _tree_cv, "rf_cv": _rf_cv, "gbt_cv": _gbt_cv, "mlp_cv": _mlp_cv, "knn_cv": _knn_cv, "multiclass_cv": _multiclass_cv,
    "gbt_multiclass_cv": _gbt_multiclass_cv,
}


@query("cv_metrics")
def cv_metrics(spark, sf_dir):
    """Accuracy, precision, recall, F1 and AUC of the cross-validations, a row per query, model and fold."""
    parts = [
        results(spark, sf_dir).select(F.lit(name).alias("query"), "algo", "fold", "accuracy", "precision", "recall", "f1", "auc", "confusion_matrix", "error")
        for name, results in CROSS_VALIDATIONS.items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("model_comparison")
def model_comparison(spark, sf_dir):
    """Cross-validated models, averaged per model, with explanations."""
    out = _cv(spark, sf_dir, ["LR", "DT"], {"DT": {"max_depth": 8}}, explained=True)
    return evaluate.summarize(out)


@query("train_all")
def trained_models(spark, sf_dir):
    """Every model of the registry on four fifths of the events; metrics on the held-out fifth, fit verdict."""
    df, features = event_features(spark, sf_dir)
    parted = cut_lineage(stratified_split(df.na.fill(0.0), "label", ["event_id"], (0.8, 0.2), ("train", "test")))
    train, held_out = (parted.where(F.col("split") == part).drop("split") for part in ("train", "test"))
    models = train_all(REGISTRY, train, features, "label", "event_id", params={"max_depth": 8})
    parts = [
        m.score(held_out, "event_id").select("label", "prediction").withColumn("algo", F.lit(n)) for n, m in models.items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return metrics.classification_by_group(out, ["algo"]).withColumn("verdict", metrics.fit_diagnosis(F.col("f1")))


@query("native_importance")
def native_importance(spark, sf_dir):
    """Importances of a forest and coefficients of a linear model on the same table."""
    df, features = wide_vectors(spark, sf_dir)
    forest = train_model("RF", df, features, params={"n_estimators": 100, "max_depth": 6})
    linear = train_model("LR", df, features)
    return importances(forest, spark).unionByName(importances(linear, spark))


@query("perm_importance")
def perm_importance(spark, sf_dir):
    """Accuracy drop per shuffled column, ten repeats over the whole table."""
    df, features = event_features(spark, sf_dir)
    df = df.na.fill(0.0)
    model = train_model("RF", df, features, params={"n_estimators": 100, "max_depth": 8})
    return explain.permutation_importance(model.score, df, features, "label", "event_id")


@query("shapley")
def shapley(spark, sf_dir):
    """Mean absolute attribution per feature of a boosted model."""
    df, features = wide_vectors(spark, sf_dir)
    model = train_model("GBT", df, features, params={"n_estimators": 100, "max_depth": 3})
    return explain.mean_attribution(explain.shapley(model.score, df, features, "vec_id"))


def _boosted_with_constant(spark, sf_dir):
    df, features = wide_vectors(spark, sf_dir)
    df, features = df.withColumn("same", F.lit(1.0)), [*features, "same"]
    return train_model("GBT", df, features, params={"n_estimators": 100, "max_depth": 3}), df, features


@query(
    "tree_shapley",
    """SELECT vec_id, 65 AS n_features, true AS efficient, true AS dummy_is_zero FROM embeddings""",
)
def tree_shapley_rows(spark, sf_dir):
    """Exact attributions of a boosted model for every row: they add up to the margin, and a constant column has none."""
    model, df, features = _boosted_with_constant(spark, sf_dir)
    trees = mllib_trees(model.model)
    found = tree_shapley(trees, df, features, "vec_id")
    sums = found.groupBy("vec_id").agg(
        F.count(F.lit(1)).cast("int").alias("n_features"), F.sum("attribution").alias("total"),
        F.max(F.when(F.col("feature") == "same", F.abs("attribution"))).alias("dummy"),
    )
    margins = tree_scores(trees, df, features, "vec_id")
    efficient = F.abs(F.col("total") + F.lit(expected_score(trees)) - F.col("margin")) < 1e-9
    return sums.join(margins, "vec_id").select("vec_id", "n_features", efficient.alias("efficient"), (F.col("dummy") == 0).alias("dummy_is_zero"))


@query("tree_shapley_means")
def tree_shapley_means(spark, sf_dir):
    """Mean absolute exact attribution per feature over the whole table."""
    model, df, features = _boosted_with_constant(spark, sf_dir)
    found = tree_shapley(mllib_trees(model.model), df, features, "vec_id")
    return found.groupBy("feature").agg(F.avg(F.abs("attribution")).alias("mean_attribution"))


@query("lime")
def lime(spark, sf_dir):
    """Local surrogate weights of ten rows."""
    df, features = wide_vectors(spark, sf_dir)
    model = train_model("LR", df, features)
    return explain.lime(model.score, df, features, "vec_id")


@query("explanation_quality")
def explanation_quality(spark, sf_dir):
    """Fidelity, stability and complexity of sampled attributions."""
    df, features = wide_vectors(spark, sf_dir)
    model = train_model("LR", df, features)
    found = explain.shapley(model.score, df, features, "vec_id")
    return explain.explanation_quality(found, df, features, "vec_id")


@query("tuning_sweep")
def tuning_sweep(spark, sf_dir):
    """Every k-NN grid point, fitted on one part and scored on another."""
    df, features = wide_vectors(spark, sf_dir)
    parted = stratified_split(df, "label", ["vec_id"])
    return tuning.sweep(
        "KNN", parted.where("split = 'train'").drop("split"), parted.where("split = 'val'").drop("split"), features,
        row_id="vec_id",
    )


@query("random_search")
def random_search(spark, sf_dir):
    """Five seeded grid points of the decision tree, three folds each."""
    df, features = wide_vectors(spark, sf_dir)
    return tuning.random_search("DT", df, features, row_id="vec_id")


@query("config_search")
def preparation_search(spark, sf_dir):
    """All 108 preparation configurations, best first."""
    df, features = wide_vectors(spark, sf_dir)
    return config_search.ranked(config_search.search(df, features, "label", ["vec_id"]))
