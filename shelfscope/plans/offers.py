"""Queries over offers and prices shown per product."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import capacity as C
from ..operators import offers as O
from ..operators import ranking as R
from ..session import cut_lineage
from . import fixtures as fx
from .prices import NUMBERS, fixed_text_sql
from .registry import query

ENABLED = ["rakuten", "yahoo", "amazon"]
AS_OF = "2000-06-15 12:00:00"


def _enc(v: str) -> str:
    # names hold letters and blanks only
    return f"replace({v}, ' ', '%20')"


VISIBLE_SQL = f"""
shown AS (SELECT orig_idx, provider, CASE provider WHEN 'rakuten' THEN '楽天市場' WHEN 'yahoo' THEN 'Yahoo!ショッピング' ELSE 'Amazon' END AS label,
    price, url, 0 AS seq, pos FROM offers WHERE available AND coalesce(match_status, 'matched') = 'matched'),
extra AS (
  SELECT orig_idx, 'rakuten' AS provider, '楽天市場' AS label, price, base_url AS url, 1 AS seq, 0 AS pos FROM products
    WHERE orig_idx NOT IN (SELECT orig_idx FROM shown WHERE provider = 'rakuten')
  UNION ALL SELECT orig_idx, 'yahoo', 'Yahoo!で探す', NULL,
    concat('https://ck.jp.ap.valuecommerce.com/servlet/referral?sid=11&pid=22&vc_url=https%3A%2F%2Fshopping.yahoo.co.jp%2Fsearch%3Fp%3D', replace({_enc('name')}, '%', '%25')), 2, 0 FROM products
    WHERE orig_idx NOT IN (SELECT orig_idx FROM shown WHERE provider = 'yahoo')
  UNION ALL SELECT orig_idx, 'amazon', 'Amazonで探す', NULL,
    concat('https://www.amazon.co.jp/s?k=', {_enc('name')}, '&tag=shelf-22'), 3, 0 FROM products
    WHERE orig_idx NOT IN (SELECT orig_idx FROM offers WHERE provider = 'amazon')),
visible AS (SELECT * EXCLUDE (dup), CASE provider WHEN 'rakuten' THEN 0 WHEN 'yahoo' THEN 1 ELSE 2 END AS po
  FROM (SELECT *, row_number() OVER (PARTITION BY orig_idx, provider, url ORDER BY seq, pos, price) AS dup
        FROM (SELECT * FROM shown UNION ALL SELECT * FROM extra)) WHERE dup = 1),
priced AS (SELECT * FROM visible WHERE price > 0 AND provider <> 'amazon'),
low AS (SELECT orig_idx, min(price) AS lowest_price FROM priced GROUP BY orig_idx)"""
BASE = fx.with_ctes("products", "offers", more=VISIBLE_SQL)


def offers(spark: SparkSession, sf: str) -> DataFrame:
    return fx.offers(spark, sf).withColumn("label", F.lit(None).cast("string"))


def visible(spark: SparkSession, sf: str) -> DataFrame:
    return O.visible_offers(fx.products(spark, sf), offers(spark, sf), "orig_idx", ENABLED,
                            yahoo=("11", "22"), amazon_tag="shelf-22")


@query("visible_offers", BASE + "SELECT orig_idx, provider, po AS provider_order, label, url, seq FROM visible")
def visible_offers(spark: SparkSession, sf: str) -> DataFrame:
    return visible(spark, sf).select("orig_idx", "provider", "provider_order", "label", "url", "seq")


@query("fresh_offers", fx.with_ctes("offers") + f"""
SELECT orig_idx, provider, pos, price,
  provider <> 'amazon' OR updated_at > TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR AS fresh FROM offers""")
def fresh_offers(spark: SparkSession, sf: str) -> DataFrame:
    as_of = F.lit(AS_OF).cast("timestamp")
    return fx.offers(spark, sf).select(
        "orig_idx", "provider", "pos", "price", O.is_fresh(as_of).alias("fresh"))


@query("lowest_offer", BASE + """
SELECT orig_idx, arg_min(provider, (price, po, seq, pos)) AS provider, min(price) AS price,
  arg_min(url, (price, po, seq, pos)) AS url FROM priced GROUP BY orig_idx""")
def lowest_offer(spark: SparkSession, sf: str) -> DataFrame:
    low = O.lowest_offer(O.comparable(visible(spark, sf)), "orig_idx")
    return low.select("orig_idx", "provider", "price", "url")


GAP_SQL = """,
two AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY orig_idx ORDER BY price, po, seq, pos) AS rn FROM priced) WHERE rn <= 2),
gaps AS (SELECT orig_idx, min(price) AS lowest_price, max(CASE WHEN rn = 1 THEN provider END) AS lowest_provider,
  max(CASE WHEN rn = 2 THEN price END) - min(price) AS gap FROM two GROUP BY orig_idx),
labelled AS (SELECT *, CASE WHEN gap = 0 THEN '同価格' WHEN gap > 0 THEN
  concat(CASE lowest_provider WHEN 'rakuten' THEN '楽天' ELSE 'Yahoo!' END, 'が', format('{:,}', gap), '円安い') END AS gap_label FROM gaps)
"""


@query("price_gap", BASE + GAP_SQL + "SELECT * FROM labelled")
def price_gap(spark: SparkSession, sf: str) -> DataFrame:
    return O.price_gap(O.comparable(visible(spark, sf)), "orig_idx")


@query("price_summary", BASE + GAP_SQL + """
SELECT l.*, n AS price_rows FROM labelled l JOIN (SELECT orig_idx, count(*) AS n FROM priced GROUP BY orig_idx) USING (orig_idx)""")
def price_summary(spark: SparkSession, sf: str) -> DataFrame:
    return O.price_summary(O.comparable(visible(spark, sf)), "orig_idx")


@query("display_price", fx.with_ctes("products", "offers", more=NUMBERS + "," + VISIBLE_SQL + """,
shown_price AS (SELECT s.orig_idx, coalesce(lowest_price, CASE WHEN price > 0 THEN price END) AS display_price, total, unit
  FROM sized s LEFT JOIN low USING (orig_idx)),
per_unit AS (SELECT *, CAST(display_price AS DOUBLE) / total AS v FROM shown_price)""") + f"""
SELECT orig_idx, display_price, v AS unit_value, concat('約', {fixed_text_sql('v')}, '円/', unit) AS unit_label FROM per_unit""")
def display_price(spark: SparkSession, sf: str) -> DataFrame:
    low = O.lowest_offer(O.comparable(visible(spark, sf)), "orig_idx")
    shown = O.display_price(fx.products(spark, sf), low, "orig_idx")
    shown = C.with_total(shown, "capacity", "size")
    return C.with_unit_price(shown, "display_price", "size", "ppu").select(
        "orig_idx", "display_price", F.col("ppu.value").alias("unit_value"),
        F.col("ppu.label").alias("unit_label"))


@query("offer_rows", BASE + """,
per AS (SELECT orig_idx, provider, arg_min(price, (seq, pos)) AS row_price FROM priced GROUP BY ALL)
SELECT v.orig_idx, v.provider, v.url, v.seq, s.shown_price, coalesce(s.shown_price = lowest_price, false) AS is_lowest
FROM visible v LEFT JOIN per USING (orig_idx, provider) LEFT JOIN low USING (orig_idx)
JOIN products p ON p.orig_idx = v.orig_idx,
LATERAL (SELECT coalesce(row_price, CASE WHEN v.provider = 'rakuten' AND p.price > 0 THEN p.price END) AS shown_price) s""")
def offer_rows(spark: SparkSession, sf: str) -> DataFrame:
    return O.offer_rows(visible(spark, sf), fx.products(spark, sf), "orig_idx").select(
        "orig_idx", "provider", "url", "seq", "shown_price", "is_lowest")


@query("offer_display_order", BASE + """
SELECT orig_idx, provider, url, seq, row_number() OVER (PARTITION BY orig_idx
  ORDER BY CASE WHEN provider <> 'amazon' AND price > 0 THEN price END NULLS LAST, po, seq, pos) AS place FROM visible""")
def offer_display_order(spark: SparkSession, sf: str) -> DataFrame:
    return O.display_order(visible(spark, sf), "orig_idx").select(
        "orig_idx", "provider", "url", "seq", "place")


@query("primary_offer", BASE + """
SELECT orig_idx, arg_min(provider, (provider <> 'rakuten', po, seq, pos)) AS provider,
  arg_min(url, (provider <> 'rakuten', po, seq, pos)) AS url FROM visible GROUP BY orig_idx""")
def primary_offer(spark: SparkSession, sf: str) -> DataFrame:
    return O.primary_offer(visible(spark, sf), "orig_idx").select("orig_idx", "provider", "url")


@query("offer_summary", fx.with_ctes("offers") + """
SELECT orig_idx, provider, count(*) AS n, string_agg(DISTINCT coalesce(match_status, 'unknown'), ',' ORDER BY coalesce(match_status, 'unknown')) AS statuses
FROM offers GROUP BY ALL""")
def offer_summary(spark: SparkSession, sf: str) -> DataFrame:
    summary = O.offer_summary(fx.offers(spark, sf), "orig_idx")
    return summary.select("orig_idx", F.explode("offer_summary").alias("provider", "s")).select(
        "orig_idx", "provider", F.col("s.count").alias("n"), F.array_join("s.statuses", ",").alias("statuses"))


@query("top_pick", fx.with_ctes("products", "offers", more=VISIBLE_SQL + """,
picks AS (SELECT article_id, arg_min(orig_idx, (CASE WHEN (orig_idx * 7) % 90 = 1 THEN 0 ELSE 1 END, orig_idx)) AS orig_idx FROM products GROUP BY article_id)""") + """
SELECT k.article_id, k.orig_idx, p.name, coalesce(l.lowest_price, p.price) AS display_price
FROM picks k JOIN products p USING (orig_idx) LEFT JOIN low l USING (orig_idx)""")
def top_pick(spark: SparkSession, sf: str) -> DataFrame:
    ranked = fx.products(spark, sf).withColumn("rank", F.col("orig_idx") * 7 % 90)
    picks = R.top_pick(ranked.select("article_id", "orig_idx", "rank", "name", "price", "base_url"))
    # only the picked products' offers are read on
    mine = offers(spark, sf).join(picks.select("orig_idx"), "orig_idx", "left_semi")
    seen = O.visible_offers(picks, mine, "orig_idx", ENABLED)
    low = O.lowest_offer(O.comparable(seen), "orig_idx")
    return O.display_price(picks, low, "orig_idx").select("article_id", "orig_idx", "name", "display_price")


def _sort_sql(column: str, direction: str) -> str:
    return f"row_number() OVER (PARTITION BY article_id ORDER BY {column} {direction} NULLS LAST, orig_idx)"


@query("comparison_sort", fx.with_ctes("products", "offers", more=NUMBERS + "," + VISIBLE_SQL + f""",
t AS (SELECT s.article_id, s.orig_idx, s.rating, lowest_price, CAST(lowest_price AS DOUBLE) / total AS v
  FROM sized s LEFT JOIN low USING (orig_idx)),
tt AS (SELECT *, CASE WHEN v IS NOT NULL THEN CAST({fixed_text_sql('v')} AS DOUBLE) END AS shown FROM t),
u AS (SELECT *, CASE WHEN shown > 0 THEN shown END AS uv FROM tt)""") + f"""
SELECT article_id, orig_idx, {_sort_sql('lowest_price', 'ASC')} AS by_price,
  {_sort_sql('uv', 'DESC')} AS by_unit_price, {_sort_sql('coalesce(rating, 0)', 'DESC')} AS by_rating FROM u""")
def comparison_sort(spark: SparkSession, sf: str) -> DataFrame:
    low = O.lowest_offer(O.comparable(visible(spark, sf)), "orig_idx")
    table = O.display_price(fx.products(spark, sf), low, "orig_idx")
    table = C.with_total(table, "capacity", "size")
    table = C.with_unit_price(table, "lowest_price", "size", "ppu").select(
        "article_id", "orig_idx", "rating", "lowest_price", F.col("ppu.label").alias("unit_price_label"))
    # sorted three ways below
    table = cut_lineage(table)
    table = R.comparison_sort(table, "price", False, "by_price")
    table = R.comparison_sort(table, "unit_price", True, "by_unit_price")
    table = R.comparison_sort(table, "rating", True, "by_rating")
    return table.select("article_id", "orig_idx", "by_price", "by_unit_price", "by_rating")
