import __spark_entry__ as entry


def test_contract(spark, data):
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 60
    assert entry.entry(spark).count() > 0


def test_no_module_of_the_core_needs_the_language_package():
    import pathlib
    import re

    root = pathlib.Path(entry.__file__).parent / "ledgerloom"
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert not re.search(r"\bllm\b", path.read_text()), path
