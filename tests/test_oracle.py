"""Every core query against its SQL, or at least its rows where it has none."""

import pytest
from compare import both, connect

from siltstone.plans import catalogue

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, data, con, name):
    ours, theirs = both(spark, con, data, QUERIES[name], SQL[name])
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_has_rows(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


def test_entry_and_registry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(QUERIES) <= set(e.queries())


def test_nothing_outside_imports_the_optional_subpackage():
    import re
    from pathlib import Path

    root = Path(catalogue.__file__).resolve().parents[1]
    for p in root.rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"siltstone[. ]*(?:import )?llm", p.read_text()), p
