"""Corpus queries with SQL give the same rows in another engine."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent.parent / "scripts"))

from flowcairn.llm.catalog import ORACLES, QUERIES  # noqa: E402

check_oracle = pytest.importorskip("check_oracle")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, sf_dir, name):
    con = check_oracle.connect(sf_dir)
    assert check_oracle.compare(QUERIES[name](spark, sf_dir), con, ORACLES[name]) == ""


def test_all_numbers_are_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert [n for k in range(1, 14) for n in [[x for x in names if x.startswith(f"op{k}_")]] if len(n) != 1] == []
    assert "pipeline" in names
