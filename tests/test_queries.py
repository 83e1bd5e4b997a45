"""Every query of the catalog against its SQL; those without SQL run."""

import pytest
from compare import rows, sql_rows

from textloom.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, small, duck, name):
    got = rows(catalog.queries()[name](spark, small))
    sql = catalog.oracle_sql().get(name)
    if sql:
        assert got == sql_rows(duck, sql)
    else:
        assert got


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["doc_id", "n_source", "coverage", "ok"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_else_imports_the_optional_subpackage():
    import pathlib
    import re

    root = pathlib.Path(catalog.__file__).parents[1]
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert not re.search(r"textloom\.llm|corpus_pipeline", path.read_text()), path
