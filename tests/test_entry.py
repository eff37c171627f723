import os
import sys

import pytest

import __spark_entry__ as contract
from rowtide import plans


def test_names():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert set(plans.QUERIES) <= set(contract.queries())


def test_without_the_subpackage(monkeypatch):
    for name in [n for n in sys.modules if n.startswith("rowtide.llm") or n == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    import rowtide

    monkeypatch.delattr(rowtide, "llm", raising=False)
    monkeypatch.setitem(sys.modules, "rowtide.llm", None)
    assert set(contract.queries()) == set(plans.QUERIES)
    assert set(contract.oracle_sql()) == set(plans.ORACLES)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables")
def test_entry(spark):
    rows = contract.entry(spark).collect()
    assert len(rows) > 0 and sum(r["n"] for r in rows) == spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()
