import inspect

import __spark_entry__ as entry
from ledgerlake import adapter, registry


def test_names_and_oracles_agree():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    assert registry.FLAGSHIP in queries
    assert all(callable(q) for q in queries.values())


def test_nothing_outside_the_folder_imports_it():
    import pkgutil

    import ledgerlake

    for m in pkgutil.walk_packages(ledgerlake.__path__, "ledgerlake."):
        if m.name == "ledgerlake.llm" or m.name.startswith("ledgerlake.llm."):
            continue
        source = inspect.getsource(__import__(m.name, fromlist=["x"]))
        assert "ledgerlake.llm" not in source and "from .llm" not in source


def test_frames_fill_both_dialects():
    for name in adapter.FRAMES:
        for spark in (True, False):
            text = adapter._fill(adapter.FRAMES[name], spark)
            assert "add_months:" not in text and "add_days:" not in text
