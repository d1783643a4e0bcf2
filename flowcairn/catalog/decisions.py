"""Scores, TOPSIS ranks and Pareto fronts over per-supplier and per-part aggregates as alternatives."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowcairn.catalog.registry import query, rounded, sql_round, table
from flowcairn.operators import decide, scores

_R = sql_round


def _models(spark, sf_dir):
    """One alternative per supplier, with readings that stand for a model's results."""
    base = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_suppkey")
        .agg(
            F.round(F.lit(1.0) - F.avg("l_discount") * 5, 6).alias("f1_score"),
            F.round(F.avg("l_extendedprice") / 1000, 6).alias("training_time_seconds"),
            F.round(F.avg("l_quantity"), 6).alias("memory_used_mb"),
            F.round(F.avg("l_tax") * 100, 6).alias("latency_ms"),
            F.round(F.max("l_tax") * 10, 6).alias("_shap"),
            F.round(F.min("l_quantity") / 10, 6).alias("_lime"),
        )
    )
    kind = F.col("l_suppkey") % 5
    name = F.element_at(
        F.array(*[F.lit(n) for n in ("Logistic_Regression", "Decision_Tree", "CNN", "TabNet", "Custom")]),
        (kind + 1).cast("int"),
    )
    return base.select(
        F.format_string("S%06d", "l_suppkey").alias("model_name"),
        name.alias("family"),
        "f1_score",
        "training_time_seconds",
        "memory_used_mb",
        "latency_ms",
        F.when(F.col("l_suppkey") % 3 != 0, F.col("_shap")).alias("shap_score"),
        F.when(F.col("l_suppkey") % 4 != 0, F.col("_lime")).alias("lime_score"),
    )


_MODELS_SQL = """
  SELECT printf('S%06d', l_suppkey) AS model_name,
         CASE l_suppkey % 5 WHEN 0 THEN 'Logistic_Regression' WHEN 1 THEN 'Decision_Tree' WHEN 2 THEN 'CNN'
                            WHEN 3 THEN 'TabNet' ELSE 'Custom' END AS family,
         round(1.0::DOUBLE - avg(l_discount) * 5, 6) AS f1_score, round(avg(l_extendedprice) / 1000, 6) AS training_time_seconds,
         round(avg(l_quantity), 6) AS memory_used_mb, round(avg(l_tax) * 100, 6) AS latency_ms,
         CASE WHEN l_suppkey % 3 <> 0 THEN round(max(l_tax) * 10, 6) END AS shap_score,
         CASE WHEN l_suppkey % 4 <> 0 THEN round(min(l_quantity) / 10, 6) END AS lime_score
  FROM lineitem GROUP BY l_suppkey
"""


def _eff(c: str) -> str:
    return (
        f"CASE WHEN max({c}) OVER () > min({c}) OVER () THEN "
        f"1.0 - ({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER () + 1e-6) ELSE 1.0 END"
    )


_READINGS = ("training_time_seconds", "memory_used_mb", "latency_ms")


@query(
    "resource_scores",
    "SELECT model_name, "
    + ", ".join(f"{_R(_eff(c))} AS eff_{c}" for c in _READINGS)
    + ", "
    + _R(" + ".join(f"{w} * ({_eff(c)})" for w, c in zip((0.5, 0.3, 0.2), _READINGS)))
    + f" AS resource_score FROM ({_MODELS_SQL}) m",
)
def resource_scores(spark, sf_dir):
    out = scores.resource_efficiency(_models(spark, sf_dir), *_READINGS)
    names = [f"eff_{c}" for c in _READINGS] + ["resource_score"]
    return out.select("model_name", *[rounded(c).alias(c) for c in names])


_EXPLAIN_SQL = f"""
  SELECT *, (0.5 * native + CASE WHEN shap_score IS NULL THEN 0 ELSE 0.3 * least(shap_score, 1.0) END
             + CASE WHEN lime_score IS NULL THEN 0 ELSE 0.2 * least(lime_score, 1.0) END)
            / (0.5::DOUBLE + CASE WHEN shap_score IS NULL THEN 0 ELSE 0.3 END + CASE WHEN lime_score IS NULL THEN 0 ELSE 0.2 END)
            AS explainability_score
  FROM (SELECT *, CASE WHEN family IN ('Logistic_Regression', 'Decision_Tree') THEN 1.0
                       WHEN family IN ('CNN', 'TabNet') THEN 0.0 ELSE 0.5 END AS native FROM ({_MODELS_SQL}) m) n
"""


def _explained(spark, sf_dir):
    df = _models(spark, sf_dir).withColumn("native", scores.native_score(F.col("family")))
    return df.withColumn(
        "explainability_score",
        scores.combined_explainability(F.col("native"), F.col("shap_score"), F.col("lime_score")),
    )


@query(
    "explain_scores",
    f"SELECT model_name, CAST(native AS DOUBLE) AS native, {_R('explainability_score')} AS explainability_score FROM ({_EXPLAIN_SQL}) e",
)
def explain_scores(spark, sf_dir):
    return _explained(spark, sf_dir).select(
        "model_name", "native", rounded("explainability_score").alias("explainability_score")
    )


def _unit(c: str) -> str:
    return f"({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER () + 1e-10)"


_DIMENSIONS_SQL = f"""
  SELECT model_name, f1_score, explainability_score, {_unit('f1_score')} AS detection_performance,
         0.6 * (1 - {_unit('training_time_seconds')}) + 0.4 * (1 - {_unit('memory_used_mb')}) AS resource_efficiency
  FROM ({_EXPLAIN_SQL}) e
"""


@query(
    "dimension_scores",
    f"""SELECT model_name, {_R('detection_performance')} AS detection_performance,
          {_R('resource_efficiency')} AS resource_efficiency, {_R('explainability_score')} AS explainability
        FROM ({_DIMENSIONS_SQL}) d""",
)
def dimension_scores(spark, sf_dir):
    out = scores.dimension_scores(_explained(spark, sf_dir))
    return out.select("model_name", *[rounded(c).alias(c) for c in out.columns[1:]])


@query(
    "report_bands",
    f"""SELECT model_name,
          CASE WHEN f1_score > 0.9 THEN 'excellent' WHEN f1_score > 0.7 THEN 'good' WHEN f1_score > 0.5 THEN 'acceptable' ELSE 'insufficient' END AS performance_band,
          CASE WHEN r > 0.8 THEN 'very efficient' WHEN r > 0.5 THEN 'efficient' WHEN r > 0.3 THEN 'moderate' ELSE 'inefficient' END AS resource_band,
          CASE WHEN x > 0.7 THEN 'highly explainable' WHEN x > 0.4 THEN 'moderately explainable' ELSE 'black box' END AS explain_band,
          concat_ws(',', CASE WHEN f1_score > 0.85 THEN 'detection' END, CASE WHEN r > 0.7 THEN 'resources' END,
                    CASE WHEN x > 0.6 THEN 'explainability' END) AS strengths,
          concat_ws(',', CASE WHEN f1_score < 0.7 THEN 'detection' END, CASE WHEN r < 0.4 THEN 'resources' END,
                    CASE WHEN x < 0.3 THEN 'explainability' END) AS weaknesses
        FROM (SELECT *, round(resource_efficiency, 6) AS r, round(explainability_score, 6) AS x FROM ({_DIMENSIONS_SQL}) d) q""",
)
def report_bands(spark, sf_dir):
    """Bands, strengths and weaknesses per alternative."""
    explained = _explained(spark, sf_dir)
    dims = scores.dimension_scores(explained).select(
        "model_name",
        F.round("resource_efficiency", 6).alias("resource_efficiency"),
        F.round("explainability", 6).alias("explainability_score"),
    )
    out = scores.report(explained.select("model_name", "f1_score").join(dims, "model_name"))
    return out.select(
        "model_name",
        "performance_band",
        "resource_band",
        "explain_band",
        F.concat_ws(",", "strengths").alias("strengths"),
        F.concat_ws(",", "weaknesses").alias("weaknesses"),
    )


def _topsis_sql(source: str, name: str, criteria: list[tuple[str, float, str]]) -> str:
    norms = ", ".join(f"sqrt(sum({c} * {c}) OVER ()) AS n_{c}" for c, _, _ in criteria)
    weighted = ", ".join(f"CASE WHEN n_{c} > 0 THEN {c} / n_{c} * {w}::DOUBLE ELSE 0 END AS v_{c}" for c, w, _ in criteria)

    def distance(best: bool) -> str:
        parts = [
            f"pow(v_{c} - {'max' if (kind == 'max') == best else 'min'}(v_{c}) OVER (), 2)" for c, _, kind in criteria
        ]
        return f"sqrt({' + '.join(parts)})"

    return f"""
      SELECT {name}, score, row_number() OVER (ORDER BY round(score, 9) DESC, md5(concat_ws('|', CAST({name} AS VARCHAR), '42'))) AS rank
      FROM (SELECT {name}, worst / (best + worst + 1e-10) AS score FROM (
        SELECT {name}, {distance(True)} AS best, {distance(False)} AS worst FROM (
          SELECT {name}, {weighted} FROM (SELECT *, {norms} FROM ({source}) s) n) w) d) t"""


@query(
    "topsis_rank",
    f"""SELECT model_name, {_R('score')} AS score, rank FROM ({_topsis_sql(
        _MODELS_SQL, "model_name",
        [("f1_score", 0.5, "max"), ("training_time_seconds", 0.3, "min"), ("memory_used_mb", 0.2, "min")])}) r""",
)
def topsis_rank(spark, sf_dir):
    scored = decide.topsis(
        _models(spark, sf_dir),
        ["f1_score", "training_time_seconds", "memory_used_mb"],
        [0.5, 0.3, 0.2],
        ["max", "min", "min"],
    )
    out = decide.rank_alternatives(scored, "model_name")
    return out.select("model_name", rounded("score").alias("score"), "rank")


@query(
    "topsis_parts",
    f"""SELECT p_partkey, {_R('score')} AS score, rank FROM ({_topsis_sql(
        "SELECT p_partkey, p_size, p_retailprice FROM part", "p_partkey",
        [("p_size", 0.4, "max"), ("p_retailprice", 0.6, "min")])}) r""",
)
def topsis_parts(spark, sf_dir):
    """Ranking of a long table of alternatives."""
    scored = decide.topsis(table(spark, sf_dir, "part"), ["p_size", "p_retailprice"], [0.4, 0.6], ["max", "min"])
    out = decide.rank_alternatives(scored, "p_partkey")
    return out.select("p_partkey", rounded("score").alias("score"), "rank")


def _minmax(c: str) -> str:
    return (
        f"CASE WHEN max({c}) OVER () > min({c}) OVER () THEN ({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) ELSE {c} END"
    )


_DECISION_SQL = f"""
  SELECT model_name, {_minmax('f1_score')} AS f, {_minmax('res')} AS r, {_minmax('explainability_score')} AS x
  FROM (SELECT *, 1 / (1 + training_time_seconds / max(training_time_seconds) OVER ()) AS res FROM ({_EXPLAIN_SQL}) e) d
"""


@query(
    "decision_rank",
    f"""SELECT model_name AS alternative, {_R('score')} AS score, rank FROM ({_topsis_sql(
        _DECISION_SQL, "model_name",
        [("f", 0.539614550221, "max"), ("r", 0.163424118566, "max"), ("x", 0.296961331212, "max")])}) q""",
)
def decision_rank(spark, sf_dir):
    """Decision matrix, AHP weights of the default comparisons, TOPSIS and rank."""
    out = decide.rank_models(_explained(spark, sf_dir))
    return out.withColumn("score", rounded("score"))


_DOMINATED = """EXISTS (SELECT 1 FROM m b WHERE b.f1_score >= a.f1_score AND b.training_time_seconds <= a.training_time_seconds
  AND b.memory_used_mb <= a.memory_used_mb AND (b.f1_score > a.f1_score OR b.training_time_seconds < a.training_time_seconds
  OR b.memory_used_mb < a.memory_used_mb))"""


_TRADE_OFFS = """SELECT event_id, value AS gain, round(1000.0 / (1.0 + value)) + event_id % 7 AS speed, CAST(user_id % 50 AS DOUBLE) AS cost
      FROM events WHERE value IS NOT NULL"""


@query(
    "pareto_front_wide",
    f"""WITH t AS ({_TRADE_OFFS}) SELECT event_id, gain, speed, cost FROM t a WHERE NOT EXISTS (SELECT 1 FROM t b
        WHERE b.gain >= a.gain AND b.speed >= a.speed AND b.cost <= a.cost AND (b.gain > a.gain OR b.speed > a.speed OR b.cost < a.cost))""",
)
def pareto_front_wide(spark, sf_dir):
    """Events not beaten on criteria that pull apart, by cells of a grid whatever the number of rows left."""
    df = table(spark, sf_dir, "events").where("value IS NOT NULL").select(
        "event_id", F.col("value").alias("gain"), (F.round(1000.0 / (1.0 + F.col("value"))) + F.col("event_id") % 7).alias("speed"),
        (F.col("user_id") % 50).cast("double").alias("cost"),
    )
    return decide.pareto_front(df, ["gain", "speed"], ["cost"], broadcast_rows=0, slice_rows=2_000)


@query(
    "pareto_front",
    f"WITH m AS ({_MODELS_SQL}) SELECT model_name, f1_score, training_time_seconds, memory_used_mb FROM m a WHERE NOT {_DOMINATED}",
)
def pareto(spark, sf_dir):
    """Suppliers not beaten on all three readings."""
    df = _models(spark, sf_dir).select("model_name", "f1_score", "training_time_seconds", "memory_used_mb")
    return decide.pareto_front(df, ["f1_score"], ["training_time_seconds", "memory_used_mb"])
