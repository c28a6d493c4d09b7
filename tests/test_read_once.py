"""Landed hits and catalogues are read once, whatever follows from them."""

import pytest
from pyspark.sql import functions as F

from shelfscope.operators import refresh_run as N

HIT = ("orig_idx long, stage int, pos int, name string, price long, item_url string, affiliate_url string, "
       "shop_url string, shop_name string")
ITEM = "https://item.rakuten.co.jp/s/{}/"


@pytest.fixture
def plan(spark):
    """Text of the optimized plan with all expressions."""
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    yield lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    spark.conf.unset("spark.sql.debug.maxToStringFields")


def test_look_up_moves_hits_once(spark, plan):
    products = spark.createDataFrame([(1, "green tea", ITEM.format("a")), (2, "green tea", "")], "orig_idx long, name string, base_url string")
    hits = spark.createDataFrame([(1, 0, 0, "green tea", 5, ITEM.format("a"), None, "s", "s")], HIT)
    looked = N.look_up(products, hits.withColumn("shop_name", F.concat("shop_name", F.lit(" of one reading"))))
    assert plan(looked).count("of one reading") == 1
    assert {r.orig_idx: (r.hit and r.hit.price, r.failure) for r in looked.collect()} == {1: (5, None), 2: (None, "none found")}


def test_moved_products_are_those_with_other_hits(spark, plan):
    def hits(rows):
        return spark.createDataFrame([(k, 0, pos, "n", price, None, None, "s", "s") for k, pos, price in rows], HIT)

    before = hits([(1, 0, 5), (1, 1, 6), (2, 0, 5), (3, 0, 5), (5, 0, 1), (5, 0, 1)])
    after = hits([(1, 1, 6), (1, 0, 5), (2, 0, 7), (4, 0, 5), (5, 0, 1)])
    moved = N.moved_products(before, after)
    assert sorted(r.orig_idx for r in moved.collect()) == [2, 3, 4, 5]
    assert "Join" not in plan(moved)


def test_tables_of_a_run_follow_from_its_judged_rows(spark):
    product = ("article_id string, orig_idx long, rank long, name string, price long, capacity string, price_per_unit string, "
               "review_count long, rating double, base_url string, image_url string")
    now = spark.createDataFrame(
        [("a", i, i, "soap", 100 + i, "100g", "-", 0, 4.0, ITEM.format(i), "i") for i in range(1, 4)], product)
    articles = spark.createDataFrame([("a", "3選", None, None)], "article_id string, title string, article_type string, target_unit string")
    hits = spark.createDataFrame([(i, 0, 0, "soap 100g", 200 - i, ITEM.format(i), None, "s", "s") for i in range(1, 4)], HIT)
    judged = N.judge_run(now, articles, hits, now.select("article_id", "orig_idx").limit(0)).localCheckpoint()
    day = F.lit("2024-03-10").cast("date")
    changes, deleted = (N.run_tables(judged, now.limit(0), articles, day, max_rank=2)[t].collect() for t in ("changes", "deleted"))
    assert sorted((r.orig_idx, r["rank"], r.price, r.gone) for r in changes) == [(1, 1, 101, True), (2, 2, 198, False), (3, 1, 197, False)]
    assert [r.rank for r in deleted] == [1]
