import sys

import __spark_entry__
from loomstrand import registry


def test_core_queries_load_without_the_optional_part(monkeypatch):
    for name in [n for n in sys.modules if n.startswith("loomstrand.llm") or n == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "loomstrand.llm", None)
    assert set(__spark_entry__.queries()) == set(registry.QUERIES)
    assert set(__spark_entry__.oracle_sql()) == set(registry.ORACLE_SQL)
