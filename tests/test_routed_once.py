"""Decision lines are judged once, and nothing that grows with them goes through the driver."""

import pytest

from shelfscope.operators import decisions as D
from shelfscope.plans import jobs

SF = "/root/testdata/sf0.001"


@pytest.fixture
def plan(spark):
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    yield lambda df: df._jdf.queryExecution()
    spark.conf.unset("spark.sql.debug.maxToStringFields")


def test_lines_are_judged_once(spark, plan):
    routed = jobs.routed(spark, SF)
    assert "variant_get" not in plan(routed).optimizedPlan().toString()
    assert "Join" not in plan(D.application_order(routed)).optimizedPlan().toString()


def test_routing_broadcasts_nothing(spark, plan):
    assert "Broadcast" not in plan(jobs.routed(spark, SF)).executedPlan().toString()
