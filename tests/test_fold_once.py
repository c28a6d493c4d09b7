"""Decision lines are parsed once, and deleted products follow from the judged lines."""

import json

import pytest
from pyspark.sql import functions as F

from shelfscope.operators import fold as L
from shelfscope.sources.jsonl import tolerant
from shelfscope.streaming import drop_folder as S

PRODUCT = ("article_id string, orig_idx long, rank long, name string, price long, capacity string, review_count long, "
           "rating double, base_url string, image_url string, price_per_unit string")


@pytest.fixture
def folded(spark):
    products = spark.createDataFrame([("a", i, i + 1, f"n{i}", 5, "1g", 0, 0.0, "u", "i", "-") for i in range(3)], PRODUCT)
    said = [{"articleFile": "src/content/articles/a.md", "rank": 1, "currentName": "n0", "action": "review", "decision": "delete"},
            {"articleFile": "src/content/articles/a.md", "rank": 1, "currentName": "n1", "action": "replace",
             "selectedAffiliateUrl": "https://x.example/1", "newPrice": 7}]
    lines = spark.createDataFrame([(f"{i}.jsonl", 1, json.dumps(x)) for i, x in enumerate(said)], "file string, line_no long, raw string")
    return L.fold_decisions(tolerant(lines), products.select("article_id").distinct(), products), products


@pytest.fixture
def plan(spark):
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    yield lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    spark.conf.unset("spark.sql.debug.maxToStringFields")


def test_lines_are_parsed_once(folded, plan):
    assert "parse_json" not in plan(folded[0]) and "variant_get" not in plan(folded[0])
    assert [r.effect for r in L.outcomes(folded[0]).orderBy("file").collect()] == ["delete", "replace"]


def test_deleted_products_are_not_numbered(folded, plan):
    judged, products = folded
    tables = S.match_tables(F.lit("2024-03-10").cast("date"))(judged.localCheckpoint(), products)
    assert "Window" not in plan(tables["deleted"]) and "row_number" not in plan(tables["deleted"])
    assert [(r.name, r["rank"]) for r in tables["deleted"].collect()] == [("n0", 1)]
    assert sorted((r.orig_idx, r["rank"], r.price, r.gone) for r in tables["changes"].collect()) == [
        (0, 1, 5, True), (1, 1, 7, False), (2, 2, 5, False)]
