"""Two-sample tests, similarity, densities and range checks."""

from __future__ import annotations

from flowcairn.catalog.bindings import FEATURES, event_features, lineitem
from flowcairn.catalog.registry import query, rounded, sql_round
from flowcairn.operators import distribution
from pyspark.sql import functions as F

_R = sql_round


def _ks_sql(columns: list[str]) -> str:
    parts = []
    for c in columns:
        parts.append(
            f"""SELECT '{c}' AS feature, n, m, max(abs(c0 / n - c1 / m)) AS d FROM (
                  SELECT v, CAST(sum(n0) OVER (ORDER BY v) AS DOUBLE) AS c0, CAST(sum(n1) OVER (ORDER BY v) AS DOUBLE) AS c1,
                         sum(n0) OVER () AS n, sum(n1) OVER () AS m
                  FROM (SELECT {c} AS v, count(*) FILTER (WHERE l_returnflag = 'N') AS n0,
                               count(*) FILTER (WHERE l_returnflag <> 'N') AS n1 FROM lineitem GROUP BY 1) g) w
                GROUP BY n, m"""
        )
    return f"""
      SELECT feature, CAST(n AS BIGINT) AS n, CAST(m AS BIGINT) AS m, d, CASE WHEN lam < 0.2 THEN 1.0 ELSE
             least(greatest(2.0 * list_sum(list_transform(range(1, 101),
               lambda j: CASE WHEN j % 2 = 1 THEN 1.0 ELSE -1.0 END * exp(-2.0 * j * j * lam * lam))), 0.0), 1.0) END AS p
      FROM (SELECT *, sqrt(CAST(n AS DOUBLE) * m / (CAST(n AS DOUBLE) + m)) * d AS lam FROM ({" UNION ALL ".join(parts)}) u) l"""


@query(
    "ks_two_sample",
    f"SELECT feature, n, m, {_R('d', 9)} AS ks_statistic, {_R('p')} AS ks_pvalue FROM ({_ks_sql(FEATURES)}) k",
)
def ks_two_sample(spark, sf_dir):
    """Attack against benign rows, every feature in one pass."""
    out = distribution.ks_two_sample(lineitem(spark, sf_dir), FEATURES, "label")
    return out.withColumns({"ks_statistic": rounded("ks_statistic", 9), "ks_pvalue": rounded("ks_pvalue")})


_MOMENTS_SQL = " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, avg({c}) FILTER (WHERE l_returnflag = 'N') AS mean1,
          avg({c}) FILTER (WHERE l_returnflag <> 'N') AS mean2,
          stddev_samp({c}) FILTER (WHERE l_returnflag = 'N') AS s1,
          stddev_samp({c}) FILTER (WHERE l_returnflag <> 'N') AS s2 FROM lineitem"""
    for c in FEATURES
)


@query(
    "feature_similarity",
    f"""SELECT feature, {_R('d', 9)} AS ks_statistic, {_R('mean1')} AS mean1, {_R('mean2')} AS mean2,
          {_R('abs(mean1 - mean2)')} AS mean_diff, {_R('abs(s1 - s2)')} AS std_diff,
          p > 0.05 OR CASE WHEN abs(mean1 + mean2) / 2 <> 0 THEN abs(mean1 - mean2) / (abs(mean1 + mean2) / 2) < 0.1
                           ELSE abs(mean1 - mean2) = 0 END AS compatible
        FROM ({_ks_sql(FEATURES)}) k JOIN ({_MOMENTS_SQL}) m USING (feature)""",
)
def feature_similarity(spark, sf_dir):
    out = distribution.feature_similarity(lineitem(spark, sf_dir), FEATURES, "label")
    return out.select(
        "feature",
        rounded("ks_statistic", 9).alias("ks_statistic"),
        *[rounded(c).alias(c) for c in ("mean1", "mean2", "mean_diff", "std_diff")],
        "compatible",
    )


@query(
    "kde_by_label",
    f"""WITH r AS (SELECT CAST(event_type = 'error' AS INT) AS label, value FROM events WHERE value > 0),
        s AS (SELECT label, count(*) AS n, 1.06 * stddev_samp(value) * pow(count(*), -0.2) AS h FROM r GROUP BY label),
        g AS (SELECT i AS grid_no, lo + (hi - lo) * i / 199.0 AS grid_x
              FROM (SELECT min(value) AS lo, max(value) AS hi FROM r) b, range(0, 200) t(i))
        SELECT r.label, CAST(grid_no AS INT) AS grid_no, {_R('grid_x')} AS grid_x,
               {_R('sum(exp(-0.5 * ((grid_x - value) / h) * ((grid_x - value) / h)) / sqrt(2 * pi())) / n / h')} AS density
        FROM r JOIN s USING (label), g GROUP BY r.label, grid_no, grid_x, n, h""",
)
def kde_by_label(spark, sf_dir):
    """Density of the event value per label on 200 grid points."""
    df, _ = event_features(spark, sf_dir)
    out = distribution.density_by_label(df, "value", "label")
    return out.withColumns({"grid_x": rounded("grid_x"), "density": rounded("density")})


@query(
    "kde_binned",
    f"""WITH r AS (SELECT CAST(event_type = 'error' AS INT) AS label, value FROM events WHERE value > 0),
        s AS (SELECT label, count(*) AS n, 1.06 * stddev_samp(value) * pow(count(*), -0.2) AS h FROM r GROUP BY label),
        b AS (SELECT (SELECT min(value) FROM r) AS lo, (SELECT max(value) FROM r) AS hi, (SELECT min(h) / 10 FROM s) AS d),
        c AS (SELECT label, floor((value - lo) / d) AS node, (value - lo) / d - floor((value - lo) / d) AS part FROM r, b),
        w AS (SELECT label, node, sum(w) AS w FROM (SELECT label, node, 1.0 - part AS w FROM c UNION ALL SELECT label, node + 1, part FROM c) u GROUP BY label, node),
        g AS (SELECT i AS grid_no, lo + (hi - lo) * i / 199.0 AS grid_x FROM b, range(0, 200) t(i))
        SELECT w.label, CAST(grid_no AS INT) AS grid_no, {_R('grid_x')} AS grid_x,
               {_R('sum(w * exp(-0.5 * pow((grid_x - lo - node * d) / h, 2)) / sqrt(2 * pi())) / n / h')} AS density
        FROM w JOIN s USING (label), g, b GROUP BY w.label, grid_no, grid_x, n, h""",
)
def kde_binned(spark, sf_dir):
    """The same density from shares on a fine grid: the kernel never meets rows."""
    df, _ = event_features(spark, sf_dir)
    out = distribution.binned_density_by_label(df, "value", "label")
    return out.withColumns({"grid_x": rounded("grid_x"), "density": rounded("density")})


@query(
    "range_check",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, CAST(l_returnflag <> 'N' AS INT) AS label, min({c}) AS min, max({c}) AS max,
              {_R(f'avg({c})')} AS mean, {_R(f'stddev_samp({c})')} AS std, {_R(f'max({c}) - min({c})')} AS range,
              (SELECT min({c}) >= -0.1 AND max({c}) <= 1.1 FROM lineitem) AS in_unit_range,
              (SELECT min({c}) >= -5.0 AND max({c}) <= 5.0 FROM lineitem) AS in_robust_range
            FROM lineitem GROUP BY 2"""
        for c in FEATURES
    ),
)
def range_check(spark, sf_dir):
    out = distribution.range_check(lineitem(spark, sf_dir), FEATURES, "label")
    return out.withColumns({c: rounded(c) for c in ("mean", "std", "range")})


@query(
    "harmonization_report",
    f"""SELECT count(*) AS features, count(*) FILTER (WHERE p > 0.05) AS compatible_features,
          {_R('min(p)')} AS smallest_p FROM ({_ks_sql(FEATURES)}) k""",
)
def harmonization_report(spark, sf_dir):
    """Compatible features and the smallest p-value out of the reported five."""
    checked = distribution.fusion_validation(lineitem(spark, sf_dir), FEATURES, "label")
    out = distribution.harmonization_report(checked)
    smallest = F.array_min(F.transform("first_p_values", lambda x: x["ks_pvalue"]))
    return out.select("features", "compatible_features", rounded(smallest).alias("smallest_p"))
