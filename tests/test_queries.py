"""Every analytics query against its SQL, over the smallest tables."""

import pytest

from tests.compare import assert_same
from tests.conftest import SMALL
from tallyforge.plans import catalog


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) & set(catalog.ORACLE_SQL)))
def test_query_equals_sql(spark, duck, name):
    assert_same(catalog.QUERIES[name](spark, SMALL).toPandas(), duck.execute(catalog.ORACLE_SQL[name]).fetchdf())


def test_entry_imports_and_registers():
    import __spark_entry__ as e

    assert catalog.FLAGSHIP in e.queries()
    assert set(e.oracle_sql()) <= set(e.queries())


def test_cascade_stages(spark):
    """Every stage answers some name."""
    kinds = {r["kind"] for r in catalog.QUERIES["match_cascade"](spark, SMALL).select("kind").distinct().collect()}
    assert kinds >= {"override", "alias", "global_alias", "fuzzy_alias", "exact", "semantic", "unmatched"}
