"""The driver's contract, and that the core stands without the text subpackage."""

import importlib
import re
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_names():
    entry = importlib.import_module("__spark_entry__")
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 30
    assert {f"p{n}_found" for n in (1, 2, 3, 4, 5)} <= set(queries)


def test_entry(spark, small):
    df = importlib.import_module("__spark_entry__").entry(spark)
    assert df.count() > 0


def test_nothing_outside_imports_the_text_subpackage():
    for p in (ROOT / "barloom").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert not re.search(r"^\s*(from|import) barloom\.llm", p.read_text(), re.M), p


def test_queries_without_text_subpackage(monkeypatch):
    entry = importlib.import_module("__spark_entry__")
    for name in [m for m in sys.modules if m.startswith("barloom.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "barloom.llm", None)
    assert not any(re.match(r"p[678]_", n) for n in entry.queries())
