import importlib
import sys

import __spark_entry__ as entry


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_library_works_without_the_corpus_operators(monkeypatch):
    for name in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("loamwork.llm")]:
        monkeypatch.delitem(sys.modules, name)

    class Missing:
        def find_spec(self, name, path=None, target=None):
            if name == "loamwork.llm" or name == "corpus_pipeline":
                raise ModuleNotFoundError(name, name=name)

    monkeypatch.setattr(sys, "meta_path", [Missing(), *sys.meta_path])
    monkeypatch.delattr(sys.modules["loamwork"], "llm", raising=False)
    try:
        bare = importlib.reload(entry)
        assert bare.queries() and not any(k.startswith("op") or k == "pipeline" for k in bare.queries())
    finally:
        monkeypatch.undo()
        importlib.reload(entry)
