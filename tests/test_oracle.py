"""Every query with SQL gives the same rows in another engine, and plans stay free of pair blow-ups."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "scripts"))

from __spark_entry__ import entry, oracle_sql, queries  # noqa: E402

check_oracle = pytest.importorskip("check_oracle")


@pytest.fixture(scope="module")
def duck(sf_dir):
    return check_oracle.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_rows(spark, sf_dir, duck, name):
    assert check_oracle.compare(queries()[name](spark, sf_dir), duck, oracle_sql()[name]) == ""


def test_entry(spark, sf_dir):
    assert entry(spark).count() > 0 and set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", ["ks_two_sample", "roc_auc", "stratified_kfold", "knn_join", "topsis_parts", "pareto_front", "mutual_information"])
def test_no_pair_blow_up(spark, sf_dir, name):
    df = queries()[name](spark, sf_dir)
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")
    plan = df._jdf.queryExecution().explainString(mode)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
