"""Costly texts are computed once per row and landed hits are evaluated once, whatever reads them."""

import pytest
from pyspark.sql import functions as F

from shelfscope.operators import matching as M
from shelfscope.operators import offers as O
from shelfscope.plans import text as plans

SF = "/root/testdata/sf0.001"


@pytest.fixture
def plan(spark):
    """Text of the optimized plan with all expressions."""
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    yield lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    spark.conf.unset("spark.sql.debug.maxToStringFields")


def test_supplemental_query_makes_each_keyword_once(spark, plan):
    # two keywords a row, each with one search for the removal rate
    assert plan(plans.supplemental_query(spark, SF)).count("除去") == 2


def test_prepared_products_make_each_keyword_once(spark, plan):
    products = spark.createDataFrame(
        [(1, "a b", "5mL", "b", "u", [])],
        "orig_idx int, name string, capacity string, brand string, base_url string, brand_variants array<string>")
    # name, brand and brand variants
    assert plan(M.prepare_products(products, "orig_idx")).count("除去") == 3


def test_offer_decisions_read_hits_once(spark, plan):
    hits = spark.createDataFrame(
        [(1, 0, 0, "u", False, "r", None)],
        "orig_idx int, query_idx int, pos int, url string, ok boolean, reason string, strict boolean")
    held = spark.createDataFrame(
        [(1, "yahoo", "matched", "u of one reading", 0)], "orig_idx int, provider string, match_status string, url string, pos int")
    marked = hits.withColumn("url", F.concat("url", F.lit(" of one reading")))
    decided = O.offer_decisions(marked, held, "orig_idx")
    assert plan(decided).count("of one reading") == 1
    assert [tuple(r) for r in decided.collect()] == [(1, "review", None, None, False, "r")]
