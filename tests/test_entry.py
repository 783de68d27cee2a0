import importlib
import sys


def test_entry_points(spark):
    import __spark_entry__ as e

    q, s = e.queries(), e.oracle_sql()
    assert set(s) <= set(q) and "bm25_multi_term" in q
    assert e.entry(spark).count() >= 0


def test_core_does_not_need_training_data_part(monkeypatch):
    """The entry works when the subpackage is not there."""
    import __spark_entry__ as e

    for name in [m for m in sys.modules if m.startswith("tamarack.llm")]:
        monkeypatch.delitem(sys.modules, name)

    class Gone:
        def find_spec(self, name, path=None, target=None):
            if name.startswith("tamarack.llm"):
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)

    import tamarack

    monkeypatch.delattr(tamarack, "llm", raising=False)
    monkeypatch.setattr(sys, "meta_path", [Gone(), *sys.meta_path])
    importlib.reload(e)
    assert not [k for k in e.queries() if k.startswith("p1_")]
