"""Every layout query against its SQL; those without SQL give rows."""

import pytest
from compare import SF, same

from quirefold.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    if name in catalog.ORACLES:
        same(df, catalog.ORACLES[name])
    else:
        assert df.count() > 0


def test_entry_without_llm(monkeypatch):
    """The entry module stands when the folder is gone."""
    import importlib
    import sys

    import __spark_entry__ as entry

    gone = [m for m in sys.modules if m.startswith("quirefold.llm") or m == "corpus_pipeline"]
    for m in gone:
        monkeypatch.delitem(sys.modules, m)
    monkeypatch.setitem(sys.modules, "quirefold.llm", None)
    again = importlib.reload(entry)
    assert not any(k.startswith("op") or k == "pipeline" for k in again.queries())
    assert set(again.oracle_sql()) <= set(again.queries())
