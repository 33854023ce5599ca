"""Every query of the core beside its SQL, over the smallest tables."""

from pathlib import Path

import pytest
from compare import compare, connect

from siltstone.plans import problems, relational, scalars, storage

MODULES = [relational, scalars, storage, problems]
NAMES = [(m, n) for m in MODULES for n in m.QUERIES]
#: Queries whose result may be empty on tables this small.
EMPTY = {"agg_limit", "group_having"}


@pytest.fixture(scope="module")
def con(small):
    return connect(Path(small))


@pytest.mark.parametrize("module,name", NAMES, ids=[n for _, n in NAMES])
def test_same_as_sql(spark, small, con, module, name):
    said = compare(spark, con, module.QUERIES[name], module.ORACLE[name], small)
    assert said == "" or said == "no rows"


def test_entry_and_names(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns
    assert set(e.oracle_sql()) <= set(e.queries())
    assert len(e.queries()) == len({k.lower() for k in e.queries()})
