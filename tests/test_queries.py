"""Every query of the engine's own operators against its SQL, and the driver's contract."""

import pytest
from conftest import DATA

from tidewell.plans import registry


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query_gives_the_rows_of_its_sql(name, matches):
    matches(registry.QUERIES[name], registry.SQL[name], f"{DATA}/sf0.001")


def test_contract(spark):
    import __spark_entry__ as own

    assert set(own.oracle_sql()) <= set(own.queries())
    assert set(registry.QUERIES) <= set(own.queries())
    assert own.entry(spark).columns == ["subset", "image", "keep", "reason"]


def test_no_plan_uses_a_local_checkpoint(spark):
    plan = registry.QUERIES["dedup_removed"](spark, f"{DATA}/sf0.001")._jdf.queryExecution().toString()
    assert "ExistingRDD" not in plan
