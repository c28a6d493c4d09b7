"""The same-product check makes the key of a name once."""

import pytest

from shelfscope.operators import same_products as SP


@pytest.fixture
def plan(spark):
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    yield lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    spark.conf.unset("spark.sql.debug.maxToStringFields")


def test_candidate_keys_are_made_once(spark, plan):
    columns = "block string, id long, name string, total struct<total: double, unit: string>"
    candidates = spark.createDataFrame([("a", 1, "green tea plus", None), ("a", 2, "coffee", None), (None, 3, "green tea", None)], columns)
    existing = spark.createDataFrame([("a", 9, "Green Tea", None)], columns)
    covered = SP.same_product(candidates, existing, "block", "id")
    assert "送料無料" not in plan(covered) and "_compose" not in plan(covered)
    assert [r.id for r in covered.collect()] == [1]
