"""The driver's contract, with and without the optional subpackage."""

import importlib
import importlib.util

import __spark_entry__ as entry_module


def test_without_the_subpackage(monkeypatch):
    real = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: None if name.startswith(("sessvar.llm", "corpus_pipeline")) else real(name, *a))
    assert not any(n.startswith("op") and n[2].isdigit() or n == "pipeline" for n in entry_module.queries())
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_entry(spark):
    assert entry_module.entry(spark).collect()
