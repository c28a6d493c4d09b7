"""Offer sync from evaluated hits to the stored offers and the report of the run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import matching as M
from ..operators import offer_sync as S
from ..session import cut_lineage
from . import fixtures as fx
from .registry import query

# Two hits per product: the first is rejected by name and holds the matched link of every third product, the
# second is accepted for even products and holds the matched link of every fifth one.
_HITS = """
SELECT p.orig_idx, 0 AS query_idx, CAST(i AS INT) AS pos,
  CASE WHEN i = 0 OR p.orig_idx % 2 = 1 THEN concat('zzz ', p.capacity)
    ELSE concat(upper(p.name), ' ', IF(p.orig_idx % 4 = 0, p.brand, ''), ' ', p.capacity) END AS name,
  IF(p.orig_idx % 7 <> 0, p.price + 3, NULL) AS price, CAST(4.5 AS DOUBLE) AS rating, CAST(12 AS BIGINT) AS review_count,
  CAST(NULL AS STRING) AS image_url,
  CASE WHEN m.url IS NOT NULL AND p.orig_idx % IF(i = 0, 3, 5) = 0 THEN m.url
    ELSE concat('https://s.example/a/', CAST(p.orig_idx AS STRING), '-', CAST(2 * i AS STRING), '.html') END AS url
FROM (SELECT *, explode(sequence(0, 1)) AS i FROM {p}) p LEFT JOIN (
  SELECT orig_idx, min_by(url, pos) AS url FROM {o}
  WHERE provider = 'yahoo' AND coalesce(match_status, 'matched') = 'matched' GROUP BY orig_idx) m ON m.orig_idx = p.orig_idx
"""

_DECIDED = """
m AS (SELECT orig_idx, arg_min(url, pos) AS murl FROM offers
  WHERE provider = 'yahoo' AND coalesce(match_status, 'matched') = 'matched' GROUP BY 1),
l AS (SELECT orig_idx, max(pos) AS last FROM offers GROUP BY 1),
h AS (SELECT p.*, murl, last, orig_idx % 3 = 0 AND murl IS NOT NULL AS first_held, orig_idx % 5 = 0 AND murl IS NOT NULL AS second_held,
    CASE WHEN orig_idx % 7 <> 0 THEN price + 3 END AS new_price,
    orig_idx % 4 = 0 OR len(list_filter(string_split(name, ' '), lambda x: length(x) >= 6)) > 0 AS strong
  FROM products p LEFT JOIN m USING (orig_idx) LEFT JOIN l USING (orig_idx)),
d AS (SELECT *, orig_idx % 2 = 0 AND NOT (first_held AND second_held) AS took,
    CASE WHEN second_held THEN murl ELSE concat('https://s.example/a/', CAST(orig_idx AS VARCHAR), '-2.html') END AS new_url,
    first_held OR (second_held AND orig_idx % 2 = 1) AS was FROM h),
o AS (SELECT *, row_number() OVER (PARTITION BY orig_idx, provider ORDER BY pos) AS place, coalesce(match_status, 'matched') AS st FROM offers),
a AS (SELECT o.*, d.new_url, d.new_price, CASE
    WHEN o.provider <> 'yahoo' THEN 'keep'
    WHEN coalesce(took, false) AND place = 1 THEN CASE WHEN st = 'rejected' THEN 'locked' WHEN url = new_url THEN 'refresh'
      WHEN was AND new_url <> murl THEN 'replace' ELSE 'other_url' END
    WHEN NOT coalesce(took, false) AND coalesce(was, false) AND st <> 'rejected' THEN 'review' ELSE 'keep' END AS action
  FROM o LEFT JOIN d ON d.orig_idx = o.orig_idx),
s AS (SELECT orig_idx, provider, pos, action,
    CASE WHEN action = 'replace' THEN new_url ELSE url END AS url,
    CASE action WHEN 'replace' THEN new_price WHEN 'refresh' THEN coalesce(new_price, price) ELSE price END AS price,
    CASE action WHEN 'replace' THEN 'pending' WHEN 'review' THEN 'review' ELSE match_status END AS match_status,
    CASE WHEN action IN ('replace', 'refresh') THEN true WHEN action = 'review' THEN false ELSE available END AS available,
    CASE WHEN action IN ('replace', 'refresh') THEN DATE '2024-03-10' ELSE updated_at END AS updated_at,
    CASE WHEN action = 'review' THEN 'capacity不一致: 商品名トークン不一致' END AS match_notes,
    action IN ('replace', 'refresh', 'review') AS changed,
    CASE action WHEN 'locked' THEN 'offer is in rejected' WHEN 'other_url' THEN 'matched offer keeps its link' END AS reason FROM a
  UNION ALL
  SELECT orig_idx, 'yahoo', coalesce(last + 1, 0), 'insert', new_url, new_price, 'pending', true, DATE '2024-03-10', NULL, true, NULL
  FROM d WHERE took AND NOT EXISTS (SELECT 1 FROM offers f WHERE f.orig_idx = d.orig_idx AND f.provider = 'yahoo'))"""


def _run(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    text = F.lit(None).cast("string")
    offers = fx.offers(spark, sf).withColumns({
        "label": F.lit("old"), "rating": F.lit(None).cast("double"), "review_count": F.lit(None).cast("long"),
        "image_url": text, "catalogue_id": text, "match_notes": text})
    products = fx.products(spark, sf).withColumn("brand_variants", F.array().cast("array<string>"))
    hits = spark.sql(_HITS, p=fx.products(spark, sf), o=fx.offers(spark, sf))
    evaluated = cut_lineage(M.evaluate_candidates(products.drop("price", "rating", "review_count"), hits, "orig_idx").select(
        "orig_idx", "query_idx", "pos", "url", "ok", "reason", "strict", *S.HIT))
    decided = S.decide(evaluated, offers, "orig_idx")
    return evaluated, decided, S.apply_decisions(decided, offers, "orig_idx", F.lit("2024-03-10").cast("date"), "Yahoo!")


@query("offer_sync", fx.with_ctes("products", "offers", more=_DECIDED) + "SELECT * FROM s")
def offer_sync(spark: SparkSession, sf: str) -> DataFrame:
    return _run(spark, sf)[2].select(
        "orig_idx", "provider", "pos", "action", "url", "price", "match_status", "available", "updated_at", "match_notes",
        "changed", "reason")


@query("offer_sync_report", fx.with_ctes("products", "offers", more=_DECIDED) + """
SELECT d.orig_idx, CASE WHEN took THEN 'auto' ELSE 'review' END AS decision,
  CASE WHEN first_held AND second_held THEN 1 ELSE 2 END AS candidates,
  CASE WHEN took THEN concat(upper(name), ' ', CASE WHEN d.orig_idx % 4 = 0 THEN brand ELSE '' END, ' ', capacity) END AS candidate,
  CASE WHEN took THEN new_price END AS price, CASE WHEN took THEN new_url END AS url, CASE WHEN took THEN strong END AS strict,
  concat('zzz ', capacity, ': 商品名トークン不一致', CASE WHEN d.orig_idx % 2 = 1 AND NOT (first_held AND second_held)
    THEN concat('|zzz ', capacity, ': 商品名トークン不一致') ELSE '' END) AS rejected,
  CASE WHEN was AND took AND new_url <> murl THEN 'replace' WHEN was AND NOT took THEN 'downgrade' END AS change,
  CASE WHEN was THEN '商品名トークン不一致' END AS rejected_reason, w.reason AS write_skipped
FROM d LEFT JOIN (SELECT orig_idx, arg_min(reason, pos) AS reason FROM s WHERE provider = 'yahoo' AND reason IS NOT NULL GROUP BY 1) w
  ON w.orig_idx = d.orig_idx""")
def offer_sync_report(spark: SparkSession, sf: str) -> DataFrame:
    evaluated, decided, synced = _run(spark, sf)
    line = F.transform("rejected", lambda r: F.concat(r["name"], F.lit(": "), r["reason"]))
    return S.report(evaluated, decided, synced, "orig_idx").withColumn("rejected", F.array_join(line, "|"))
