"""The contract holds without the training-data operators, or without what they need."""

import builtins
import sys

import pytest

import __spark_entry__ as entry_mod


@pytest.mark.parametrize("missing", ["arbora.llm.queries", "corpus_pipeline", "xxhash"])
def test_library_queries_without_the_subpackage(monkeypatch, missing):
    held = {m: sys.modules[m] for m in list(sys.modules) if m == "corpus_pipeline" or m.startswith("arbora.llm")}
    for m in held:
        monkeypatch.delitem(sys.modules, m)
    real = builtins.__import__

    def fail(name, *args, **kwargs):
        if name == missing:
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
        return real(name, *args, **kwargs)

    monkeypatch.setattr(builtins, "__import__", fail)
    with pytest.warns(UserWarning):
        names = entry_mod.queries()
    assert len(names) >= 85 and not any(n.startswith("op") and n[2].isdigit() for n in names) and "pipeline" not in names
    for m in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("arbora.llm")]:
        monkeypatch.delitem(sys.modules, m)
