import pytest

from sparkwarden.plans import registry

#: Queries whose rows must not all be of one kind: column and the least number of different values.
CLASSES = {"decide_verdict": ("verdict", 2), "context_rules": ("found", 6), "path_downgrades": ("severity", 2), "dependency_names": ("id", 3), "registry_hosts": ("id", 3), "rate_limiter": ("allowed", 2), "verdict_cache": ("cached", 2), "second_opinion": ("final", 3)}


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, small, same, name):
    df = registry.queries()[name](spark, small)
    rows = same(df, duck, registry.oracle_sql()[name])
    if name not in ("payload_in_config", "blob_shapes", "unexpected_reds", "hidden_kinds"):
        assert rows
    if name in CLASSES:
        column, least = CLASSES[name]
        at = sorted(df.columns).index(column)
        assert len({r[at] for r in rows}) >= least


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_runs(spark, small, name):
    assert registry.queries()[name](spark, small).count() > 0


def test_entry_imports_without_the_optional_part(monkeypatch):
    import importlib
    import sys

    for name in ("sparkwarden.llm.registry", "corpus_pipeline"):
        monkeypatch.setitem(sys.modules, name, None)
    sys.modules.pop("__spark_entry__", None)
    entry = importlib.import_module("__spark_entry__")
    assert "decide_verdict" in entry.queries() and not any(x.startswith("op") for x in entry.queries())
    sys.modules.pop("__spark_entry__", None)


def test_entry_does_not_hide_a_broken_import(monkeypatch):
    import importlib
    import sys

    import __spark_entry__ as entry

    monkeypatch.setattr(importlib, "import_module", lambda name: (_ for _ in ()).throw(ModuleNotFoundError("x", name="numpy")))
    with pytest.raises(ModuleNotFoundError):
        entry._optional("sparkwarden.llm.registry")
    sys.modules.pop("__spark_entry__", None)
