"""The driver contract, with and without the training-data part."""

import importlib
import sys

import pytest


def load():
    sys.modules.pop("__spark_entry__", None)
    return importlib.import_module("__spark_entry__")


def test_entry_gives_rows(spark):
    assert load().entry(spark).count() > 0


def test_oracles_belong_to_queries():
    e = load()
    assert set(e.oracle_sql()) <= set(e.queries())


def test_imports_without_the_other_part(monkeypatch):
    for name in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("sparrowgrid.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "sparrowgrid.llm", None)
    monkeypatch.setitem(sys.modules, "sparrowgrid.llm.queries", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    e = load()
    assert e.queries() and not [n for n in e.queries() if n.startswith("op") or n == "pipeline"]
    sys.modules.pop("__spark_entry__")


def test_a_broken_part_is_not_hidden(monkeypatch):
    for name in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("sparrowgrid.llm")]:
        monkeypatch.delitem(sys.modules, name)
    broken = type(sys)("corpus_pipeline")
    monkeypatch.setitem(sys.modules, "sparrowgrid.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", broken)
    broken.run, broken.ORACLE_SQL = None, None
    assert load().queries()  # absent: the rest stands

    class Broken:
        def find_spec(self, name, path=None, target=None):
            if name == "corpus_pipeline":
                raise ModuleNotFoundError("no pyarrow", name="pyarrow")

    monkeypatch.delitem(sys.modules, "corpus_pipeline")
    monkeypatch.setattr(sys, "meta_path", [Broken(), *sys.meta_path])
    with pytest.raises(ModuleNotFoundError, match="pyarrow"):
        load()
    sys.modules.pop("__spark_entry__", None)
