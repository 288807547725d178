"""The entry module with and without the optional subpackage."""

import builtins
import importlib
import sys

import __spark_entry__ as entry


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_subpackage(monkeypatch):
    real = builtins.__import__

    def missing(name, globals=None, locals=None, fromlist=(), level=0):
        if "corpus_pipeline" in name or ".llm" in name or "llm" in (fromlist or ()):
            raise ImportError(name)
        return real(name, globals, locals, fromlist, level)

    with monkeypatch.context() as m:
        m.setattr(builtins, "__import__", missing)
        for name in [n for n in sys.modules if n == "corpus_pipeline" or n.startswith("loomgraph.llm")]:
            m.delitem(sys.modules, name)
        again = importlib.reload(entry)
        assert again.queries() and not [q for q in again.queries() if q.startswith("op") and q[2].isdigit() or q == "pipeline"]
    importlib.reload(entry)
