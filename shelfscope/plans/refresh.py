"""The price refresh as runs over a committed catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import refresh_run as N
from ..session import cut_lineage, scratch_path
from ..streaming import ledger
from . import fixtures as fx
from .prices import fixed_text_sql
from .registry import query
from .text import NAMED_SQL, named

DAY = "2024-03-10"
_LATER = "starts_with(article_id, 'Brand#1') AND orig_idx % 3 = 0"


def _ranked(source: str, price: str, n: int) -> str:
    """Oracle of one run: unit price by price and size, rank in the article, the first ten.

    A product that is frozen and not found keeps its old text, which gives no unit price.
    """
    v = f"v{n}"
    return f"""
{v} AS (SELECT *, {price} AS pr{n}, CAST({price} AS DOUBLE) / CAST(amount * packs AS DOUBLE) AS {v} FROM {source}),
s{n} AS (SELECT *, CASE WHEN NOT stale THEN CAST({fixed_text_sql(v)} AS DOUBLE) END AS shown{n} FROM {v}),
b{n} AS (SELECT *, CASE WHEN shown{n} > 0 THEN shown{n} / CASE WHEN unit IN ('L', 'kg') THEN 1000 ELSE 1 END END AS bv{n}, CASE WHEN shown{n} > 0 THEN u1 END AS bu{n} FROM s{n}),
pl{n} AS (SELECT *, row_number() OVER (PARTITION BY article_id, bu{n} ORDER BY bv{n}, pr{n}, orig_idx) AS place{n} FROM b{n}),
gs{n} AS (SELECT article_id, bu{n}, count(*) AS n, list(review_count ORDER BY place{n}) AS reviews, min(CASE WHEN place{n} = 1 THEN pr{n} END) AS p1, min(orig_idx) AS f1 FROM pl{n} GROUP BY ALL),
go{n} AS (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY bu{n} IS NULL, n DESC, reviews DESC, p1, f1) AS g FROM gs{n}),
all{n} AS (SELECT p.*, row_number() OVER (PARTITION BY p.article_id ORDER BY g, place{n}) AS rank{n}, CASE WHEN stale THEN 'old' ELSE concat('約', {fixed_text_sql(v)}, '円/', unit) END AS label{n}
  FROM pl{n} p JOIN go{n} o ON p.article_id = o.article_id AND p.bu{n} IS NOT DISTINCT FROM o.bu{n}),
rk{n} AS (SELECT * FROM all{n} WHERE rank{n} <= 10)"""


_RUNS = NAMED_SQL + """,
w AS (SELECT *, orig_idx % 17 = 3 AS lost, orig_idx % 17 = 3 AND orig_idx % 11 = 4 AS stale, CASE unit WHEN 'L' THEN 'mL' WHEN 'kg' THEN 'g' ELSE unit END AS u1 FROM read),""" + _ranked(
    "w", "CASE WHEN lost THEN price ELSE price + 4 END", 1) + "," + _ranked(
    "rk1", f"pr1 + CASE WHEN {_LATER} AND NOT lost THEN 10 ELSE 0 END", 2)


def landed(spark: SparkSession, sf: str, later: bool = False) -> DataFrame:
    """Responses of the products' own items, after others; every seventeenth search missed the own item."""
    more = F.when(F.lit(later) & F.expr(_LATER.replace("starts_with", "startswith")), 10).otherwise(0)
    items = named(spark, sf).select(
        "orig_idx", F.inline(F.array(
            F.struct(F.lit(0).alias("stage"), F.lit(0).alias("pos"), F.concat("name", F.lit(" other")).alias("name"),
                     (F.col("price") - 1).alias("price"), F.lit("https://item.rakuten.co.jp/other/x/").alias("item_url")),
            F.struct(F.lit(1).alias("stage"), F.lit(1).alias("pos"), F.col("item_name").alias("name"),
                     (F.col("price") + 4 + more).alias("price"),
                     F.when(F.col("orig_idx") % 17 == 3, "https://item.rakuten.co.jp/other/y/").otherwise(F.col("base_url")).alias("item_url")))))
    none = F.lit(None).cast("string")
    return items.withColumns({"affiliate_url": none, "shop_name": F.lit("shop"), "shop_url": F.lit("https://www.example.jp/x"), "image_url": none})


def run_three(spark: SparkSession, sf: str) -> str:
    """The first responses twice, then later ones; returns the folder of the catalogue."""
    root = scratch_path(spark, "catalogue")
    products = fx.products(spark, sf).select(
        "article_id", "orig_idx", F.lit(None).cast("long").alias("rank"), "name", "price", "capacity",
        F.lit("old").alias("price_per_unit"), "review_count", "rating", "base_url", F.lit("i").alias("image_url"))
    ledger.create(products, root)
    articles = cut_lineage(products.select(
        "article_id", F.concat(F.lit("T 10選 "), "article_id").alias("title"), F.lit("comparison").alias("article_type"),
        F.lit(None).cast("string").alias("target_unit")).distinct())
    frozen = products.select("article_id", "orig_idx").where("orig_idx % 11 = 4")
    first, last = cut_lineage(landed(spark, sf)), cut_lineage(landed(spark, sf, later=True))
    day = F.lit(DAY).cast("date")
    N.refresh(spark, root, 1, articles, first, frozen, day)
    N.refresh(spark, root, 2, articles, first, frozen, day, earlier_hits=first)
    N.refresh(spark, root, 3, articles, last, frozen, day, earlier_hits=first)
    return root


@query("refresh_state", fx.with_ctes("products", more=_RUNS) + f""",
seen AS (SELECT orig_idx, CASE WHEN lost THEN 'failed' WHEN {_LATER} THEN 'changed' ELSE 'unchanged' END AS outcome FROM rk1
  WHERE article_id IN (SELECT article_id FROM rk1 WHERE {_LATER} AND NOT lost))
SELECT article_id, orig_idx, rank2 AS rank, name, pr2 AS price, capacity, label2 AS price_per_unit, outcome FROM rk2 LEFT JOIN seen USING (orig_idx)""")
def refresh_state(spark: SparkSession, sf: str) -> DataFrame:
    """The catalogue after three runs; ``outcome`` where the last run, of later responses, looked at a product."""
    root = run_three(spark, sf)
    seen = ledger.committed(spark, root, "log").where("batch_id = 3").select("orig_idx", "outcome")
    return ledger.state(spark, root).join(seen, "orig_idx", "left").select(
        "article_id", "orig_idx", "rank", "name", "price", "capacity", "price_per_unit", "outcome")
