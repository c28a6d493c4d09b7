"""Queries over landed hits, candidate matching and additions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as T
from ..functions.arrow import nfkc_lower
from ..operators import additions as A
from ..operators import matching as M
from ..operators import offers as O
from ..operators import same_products as SP
from ..sources import hits as H
from . import fixtures as fx
from .registry import query

# -- landed responses: three hits per product --------------------------------

_RESPONSES = """
SELECT orig_idx, to_json(named_struct('totalResultsReturned', 3, 'hits', array(
  named_struct('name', name, 'url', concat('https://s.example/', CAST(orig_idx AS STRING)), 'price', price, 'inStock', CAST(NULL AS BOOLEAN),
    'review', named_struct('rate', rating, 'count', review_count), 'image', named_struct('small', 's0', 'medium', 'm0'), 'exImage', named_struct('url', 'x0'), 'seller', named_struct('name', brand)),
  named_struct('name', IF(orig_idx % 3 = 0, '', concat(name, ' b')), 'url', 'https://s.example/b', 'price', CAST(NULL AS BIGINT), 'inStock', orig_idx % 2 = 0,
    'review', CAST(NULL AS STRUCT<rate: DOUBLE, count: BIGINT>), 'image', named_struct('small', 's1', 'medium', IF(orig_idx % 2 = 0, 'm1', NULL)), 'exImage', CAST(NULL AS STRUCT<url: STRING>), 'seller', CAST(NULL AS STRUCT<name: STRING>)),
  named_struct('name', concat(name, ' c'), 'url', CAST(NULL AS STRING), 'price', price, 'inStock', true,
    'review', CAST(NULL AS STRUCT<rate: DOUBLE, count: BIGINT>), 'image', CAST(NULL AS STRUCT<small: STRING, medium: STRING>), 'exImage', CAST(NULL AS STRUCT<url: STRING>), 'seller', CAST(NULL AS STRUCT<name: STRING>))
))) AS body FROM {p}
"""


@query("normalize_hits", fx.with_ctes("products") + """
SELECT 'offer' AS market, orig_idx, 0 AS pos, name, price, rating, review_count, 'x0' AS image_url, true AS available FROM products
UNION ALL SELECT 'offer', orig_idx, 1, concat(name, ' b'), NULL, NULL, NULL, CASE WHEN orig_idx % 2 = 0 THEN 'm1' ELSE 's1' END, orig_idx % 2 = 0 FROM products WHERE orig_idx % 3 <> 0
UNION ALL SELECT 'base', orig_idx, 0, name, price, CASE WHEN rating > 0 THEN rating END, CASE WHEN review_count > 0 THEN review_count END, 'i1', NULL FROM products""")
def normalize_hits(spark: SparkSession, sf: str) -> DataFrame:
    products = fx.products(spark, sf)
    offer = H.offer_hits(spark.sql(_RESPONSES, p=products))
    item = F.struct(
        F.col("name").alias("itemName"), F.col("price").alias("itemPrice"), F.col("base_url").alias("itemUrl"),
        F.coalesce(F.col("rating").cast("string"), F.lit("0")).alias("reviewAverage"),
        F.col("review_count").alias("reviewCount"), F.array(F.lit("i1"), F.lit("i2")).alias("mediumImageUrls"))
    base = H.base_hits(products.select("orig_idx", F.to_json(F.struct(F.array(item).alias("Items"))).alias("body")))
    columns = ["orig_idx", "pos", "name", "price", "rating", "review_count", "image_url", "available"]
    return offer.select(F.lit("offer").alias("market"), *columns).unionByName(
        base.withColumn("available", F.lit(None).cast("boolean")).select(F.lit("base").alias("market"), *columns))


# hits of base searches: pos 0 a donation listing on every third product, pos 1
# another shop's item, pos 2 the product's own item on two of three
_HITS = """
SELECT orig_idx, orig_idx % 4 AS stage, pos, CASE pos WHEN 0 THEN IF(orig_idx % 3 = 0, concat('ふるさと納税 ', name), name)
    ELSE concat(name, ' ', CAST(pos AS STRING)) END AS name,
  price + pos * 10 AS price, review_count * (pos + 1) AS review_count, rating,
  CASE WHEN pos = 2 AND orig_idx % 3 <> 1 THEN base_url ELSE concat('https://item.rakuten.co.jp/other/i', CAST(orig_idx * 3 + pos AS STRING), '/') END AS item_url,
  CAST(NULL AS STRING) AS affiliate_url, concat('shop ', CAST(pos AS STRING)) AS shop_name,
  IF(pos = 1 AND orig_idx % 6 = 0, 'https://www.example.jp/f12345-town', 'https://www.example.jp/x') AS shop_url
FROM (SELECT *, explode(sequence(0, 2)) AS pos FROM {p})
"""
HITS = """hits AS (SELECT p.*, pos, CASE pos WHEN 0 THEN (CASE WHEN orig_idx % 3 = 0 THEN concat('ふるさと納税 ', name) ELSE name END) ELSE concat(name, ' ', CAST(pos AS VARCHAR)) END AS hit_name,
  price + pos * 10 AS hit_price, review_count * (pos + 1) AS hit_reviews, (pos = 2 AND orig_idx % 3 <> 1) AS own,
  (pos = 0 AND orig_idx % 3 = 0) OR (pos = 1 AND orig_idx % 6 = 0) AS donated
  FROM products p, (VALUES (0), (1), (2)) AS t(pos))"""
# searches of every eleventh product found nothing
FOUND_HITS = HITS.replace("AS t(pos))", "AS t(pos) WHERE orig_idx % 11 <> 0)")


def hits(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(_HITS, p=fx.products(spark, sf))


def found_hits(spark: SparkSession, sf: str) -> DataFrame:
    """Hits where the search of every eleventh product found nothing."""
    return hits(spark, sf).filter("orig_idx % 11 <> 0")


@query("exclude_listings", fx.with_ctes("products", more=HITS) + """
SELECT orig_idx, pos, hit_name AS name FROM hits WHERE NOT donated""")
def exclude_listings(spark: SparkSession, sf: str) -> DataFrame:
    return M.regular_listings(hits(spark, sf)).select("orig_idx", "pos", "name")


@query("first_hit", fx.with_ctes("products", more=FOUND_HITS) + """
SELECT p.orig_idx, min(pos) AS pos, arg_min(hit_name, pos) AS hit_name, CASE WHEN min(pos) IS NULL THEN 'none found' ELSE 'found' END AS status
FROM products p LEFT JOIN (SELECT * FROM hits WHERE NOT donated) h ON h.orig_idx = p.orig_idx GROUP BY p.orig_idx""")
def first_hit(spark: SparkSession, sf: str) -> DataFrame:
    rows = M.first_hits(fx.products(spark, sf), found_hits(spark, sf), "orig_idx")
    return rows.select("orig_idx", "hit.pos", F.col("hit.name").alias("hit_name"), "status")


@query("staged_lookup", fx.with_ctes("products", more=HITS) + """
SELECT orig_idx, orig_idx % 4 AS stage, hit_name AS name, hit_price AS price FROM hits WHERE own AND NOT donated""")
def staged_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return M.staged_lookup(fx.products(spark, sf), hits(spark, sf), "orig_idx").select(
        "orig_idx", "stage", "name", "price")


@query("reconcile_urls", fx.with_ctes("products", more=FOUND_HITS) + """,
best AS (SELECT orig_idx, arg_min(hit_name, (NOT own, pos)) AS hit_name, arg_min(hit_price, (NOT own, pos)) AS hit_price, bool_or(own) AS own FROM hits GROUP BY 1)
SELECT p.orig_idx, coalesce(hit_name, 'ERROR: 0件') AS hit_name, hit_price, CASE WHEN own THEN '○' WHEN own IS NULL THEN '' ELSE '△(別商品)' END AS match
FROM products p LEFT JOIN best b ON b.orig_idx = p.orig_idx""")
def reconcile_urls(spark: SparkSession, sf: str) -> DataFrame:
    return M.reconcile(fx.products(spark, sf), found_hits(spark, sf), "orig_idx").select(
        "orig_idx", "hit_name", "hit_price", "match")


@query("replacement_candidates", fx.with_ctes("products", more=HITS) + """,
f AS (SELECT orig_idx, arg_min(hit_reviews, pos) AS then_count, arg_min(review_count, pos) AS now_count, arg_min(own, pos) AS own FROM hits WHERE NOT donated GROUP BY 1)
SELECT orig_idx, now_count, then_count FROM f WHERE NOT own AND CASE WHEN now_count > 0 THEN then_count >= now_count * 2 ELSE then_count > 0 END""")
def replacement_candidates(spark: SparkSession, sf: str) -> DataFrame:
    rows = M.replacement_candidates(fx.products(spark, sf), hits(spark, sf), "orig_idx", 2)
    return rows.select("orig_idx", F.col("review_count").alias("now_count"),
                       F.col("hit.review_count").alias("then_count"))


@query("match_queue", fx.with_ctes("products", more=HITS) + """
SELECT orig_idx, row_number() OVER (PARTITION BY orig_idx ORDER BY pos) AS place, hit_name AS name FROM hits WHERE NOT donated""")
def match_queue(spark: SparkSession, sf: str) -> DataFrame:
    return M.match_queue(fx.products(spark, sf), hits(spark, sf), "orig_idx").select("orig_idx", "place", "name")


# -- candidates: four per product in two searches ----------------------------

_CANDIDATES = """
SELECT orig_idx, CAST(i div 2 AS INT) AS query_idx, i % 2 AS pos,
  CASE i WHEN 0 THEN concat('zzz ', capacity) WHEN 1 THEN concat(name, ' ', CAST(amount AS STRING), unit)
    WHEN 2 THEN concat(upper(name), ' ', IF(orig_idx % 2 = 0, brand, ''), ' ', capacity) ELSE concat(name, ' again ', capacity) END AS name,
  CASE WHEN i = 0 OR i = 2 THEN concat('https://s.example/a/', CAST(orig_idx AS STRING), '-', CAST(i AS STRING), '.html')
    WHEN orig_idx % 3 = 0 THEN concat('https://s.example/a/', lpad(CAST(orig_idx AS STRING), 13, '4'), 'x', CAST(packs AS STRING), '.html')
    ELSE concat('https://s.example/a/p', CAST(orig_idx AS STRING), '.html') END AS url
FROM (SELECT *, explode(sequence(0, 3)) AS i FROM {p})
"""
CANDIDATES = """cands AS (SELECT p.*, i, i // 2 AS query_idx, i % 2 AS pos,
  CASE i WHEN 0 THEN '商品名トークン不一致' WHEN 1 THEN (CASE WHEN packs = 1 OR orig_idx % 3 = 0 THEN 'capacity一致' ELSE 'capacity不一致' END)
    WHEN 2 THEN 'capacity一致' ELSE 'capacity一致' END AS why,
  CASE WHEN i IN (0, 2) THEN concat('https://s.example/a/', CAST(orig_idx AS VARCHAR), '-', CAST(i AS VARCHAR), '.html')
    WHEN orig_idx % 3 = 0 THEN concat('https://s.example/a/', lpad(CAST(orig_idx AS VARCHAR), 13, '4'), 'x', CAST(packs AS VARCHAR), '.html')
    ELSE concat('https://s.example/a/p', CAST(orig_idx AS VARCHAR), '.html') END AS url,
  CASE i WHEN 2 THEN orig_idx % 2 = 0 ELSE false END OR len(list_filter(string_split(name, ' '), lambda x: length(x) >= 6)) > 0 AS strict_if
  FROM products p, (VALUES (0), (1), (2), (3)) AS t(i))"""


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(_CANDIDATES, p=fx.products(spark, sf))


def evaluated(spark: SparkSession, sf: str) -> DataFrame:
    products = fx.products(spark, sf).withColumn("brand_variants", F.array().cast("array<string>"))
    return M.evaluate_candidates(products, candidates(spark, sf), "orig_idx")


@query("match_candidates", fx.with_ctes("products", more=CANDIDATES) + """
SELECT orig_idx, query_idx, pos FROM cands WHERE i > 0""")
def match_candidates(spark: SparkSession, sf: str) -> DataFrame:
    products = fx.products(spark, sf).withColumn("brand_variants", F.array().cast("array<string>"))
    return M.match_candidates(products, candidates(spark, sf), "orig_idx").select("orig_idx", "query_idx", "pos")


@query("evaluate_candidates", fx.with_ctes("products", more=CANDIDATES) + """
SELECT orig_idx, query_idx, pos, why AS reason, why = 'capacity一致' AS ok,
  CASE WHEN why = 'capacity一致' THEN strict_if END AS strict FROM cands""")
def evaluate_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return evaluated(spark, sf).select("orig_idx", "query_idx", "pos", "reason", "ok", "strict")


@query("first_accepted", fx.with_ctes("products", more=CANDIDATES) + """
SELECT orig_idx, min(i) // 2 AS query_idx, min(i) % 2 AS pos, arg_min(url, i) AS url, arg_min(strict_if, i) AS strict
FROM cands WHERE why = 'capacity一致' AND i < 3 GROUP BY orig_idx""")
def first_accepted(spark: SparkSession, sf: str) -> DataFrame:
    return M.first_accepted(evaluated(spark, sf), "orig_idx").select(
        "orig_idx", "query_idx", "pos", "url", "strict")


@query("offer_decision", fx.with_ctes("products", more=CANDIDATES) + """,
acc AS (SELECT orig_idx, arg_min(url, i) AS url, arg_min(strict_if, i) AS strict FROM cands WHERE why = 'capacity一致' AND i < 3 GROUP BY 1),
rej AS (SELECT c.orig_idx, why FROM cands c WHERE i = 1 AND why <> 'capacity一致' AND orig_idx % 4 = 0)
SELECT p.orig_idx, 'upsert' AS action, acc.url AS selected_url, acc.strict, rej.why IS NOT NULL AS force, rej.why AS rejected_reason
FROM products p JOIN acc ON acc.orig_idx = p.orig_idx LEFT JOIN rej ON rej.orig_idx = p.orig_idx""")
def offer_decision(spark: SparkSession, sf: str) -> DataFrame:
    # every fourth product holds the link of the second candidate
    held = candidates(spark, sf).filter("query_idx = 0 AND pos = 1 AND orig_idx % 4 = 0").select(
        "orig_idx", F.lit("yahoo").alias("provider"), F.lit("matched").alias("match_status"), "url",
        F.lit(0).alias("pos"))
    rows = evaluated(spark, sf).select("orig_idx", "query_idx", "pos", "url", "ok", "reason", "strict")
    return O.offer_decisions(rows, held, "orig_idx").select(
        "orig_idx", "action", "selected_url", "strict", "force", "rejected_reason")


@query("brand_match", fx.with_ctes("products") + """
SELECT orig_idx, orig_idx % 3 <> 2 AS all_tokens, orig_idx % 2 = 0 AS brand,
  orig_idx % 3 <> 2 AND len(list_filter(string_split(name, ' '), lambda x: length(x) >= 6)) > 0
  OR (orig_idx % 3 = 2 AND length(string_split(name, ' ')[1]) >= 6) AS distinctive FROM products""")
def brand_match(spark: SparkSession, sf: str) -> DataFrame:
    refill = F.concat("name", F.lit(" 詰め替え"))
    first = F.split("name", " ")[0]
    other = F.when(F.col("orig_idx") % 3 == 2, first).otherwise(F.concat("name", F.lit(" 詰替")))
    df = fx.products(spark, sf).withColumns({
        "kw": nfkc_lower(T.search_keyword(refill)), "b": F.lower("brand"),
        "text": F.concat(other, F.when(F.col("orig_idx") % 2 == 0, F.concat(F.lit(" "), F.lower("brand"))).otherwise("")),
    })
    checks = M.brand_checks(
        T.name_tokens(F.col("kw")), F.array("b"), F.array().cast("array<string>"), F.col("text"))
    return df.select("orig_idx", *[v.alias(k) for k, v in checks.items()])


@query("brand_alias", fx.with_ctes("products") + """
SELECT orig_idx, CASE WHEN orig_idx % 2 = 0 THEN 'Brandクリア|クリア' ELSE 'クリア' END AS aliases FROM products""")
def brand_alias(spark: SparkSession, sf: str) -> DataFrame:
    brand = F.when(F.col("orig_idx") % 2 == 0, F.col("brand")).otherwise("花王")
    found = T.alias_suggestions(
        F.concat("name", F.lit(" クリア ナイト")), brand, F.concat("brand", F.lit(" クリア デイ ア")))
    return fx.products(spark, sf).select("orig_idx", F.array_join(found, "|").alias("aliases"))


SAME = """
cand AS (SELECT article_id, orig_idx, replace(concat(name, CASE WHEN orig_idx % 4 = 0 THEN 'plus' ELSE 'zq' END), ' ', '') AS k, unit,
    CASE WHEN orig_idx % 5 <> 0 THEN amount * packs END AS total FROM products),
ex AS (SELECT article_id, replace(name, ' ', '') AS k, unit, CASE WHEN orig_idx % 7 <> 0 THEN amount * packs END AS total FROM products),
cg AS (SELECT *, list_distinct([substr(k, CAST(i AS INTEGER), 4) FOR i IN range(1, length(k) - 2)]) AS g FROM (SELECT DISTINCT * EXCLUDE (orig_idx), orig_idx FROM cand)),
eg AS (SELECT *, list_distinct([substr(k, CAST(i AS INTEGER), 4) FOR i IN range(1, length(k) - 2)]) AS g FROM (SELECT DISTINCT * FROM ex))"""


@query("same_product_ngram", fx.with_ctes("products", more=SAME) + """
SELECT DISTINCT c.orig_idx FROM cg c JOIN eg e USING (article_id)
WHERE (contains(c.k, e.k) OR contains(e.k, c.k) OR (len(list_intersect(e.g, c.g)) >= 2 AND len(list_intersect(e.g, c.g)) * 4.0 / length(e.k) >= 0.4))
  AND (c.total IS NULL OR e.total IS NULL OR (c.total = e.total AND c.unit = e.unit))""")
def same_product_ngram(spark: SparkSession, sf: str) -> DataFrame:
    from ..functions import capacity as C

    products = C.with_total(fx.products(spark, sf), "capacity", "total")
    tail = F.when(F.col("orig_idx") % 4 == 0, " plus").otherwise(" zq")
    none = F.lit(None).cast(C.SIZE_TYPE)
    cand = products.select(
        "article_id", "orig_idx", F.concat("name", tail).alias("name"),
        F.when(F.col("orig_idx") % 5 != 0, F.col("total")).otherwise(none).alias("total"))
    existing = products.select(
        "article_id", "name", F.when(F.col("orig_idx") % 7 != 0, F.col("total")).otherwise(none).alias("total"))
    return SP.same_product(cand, existing, "article_id", "orig_idx")


# -- additions ---------------------------------------------------------------

_RULES = [
    # priority, category, keyword regex, keywords, include, exclude, groups, units, min score
    (1, "ECONOMY", "Brand#1", ["kw one"], ["widget"], ["hot"], [["red", "blue"]], None, 3),
    (2, "ECONOMY", None, ["kw two", "kw three"], ["ring", "bolt"], None, None, ["mL", "L"], None),
    (2, "SMALL", None, None, ["gear"], ["old"], None, None, 5),
]
_RULE_SCHEMA = (
    "priority int, category_id string, keyword_regex string, keywords array<string>, include array<string>, "
    "exclude array<string>, required_groups array<array<string>>, units array<string>, min_score int"
)


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_RULES, _RULE_SCHEMA).withColumn("require_include", F.lit(None).cast("boolean"))


def report_articles(spark: SparkSession, sf: str) -> DataFrame:
    """Brand and type make an article, so that articles are many."""
    return (
        fx.products(spark, sf).select("brand", "category_id").distinct()
        .select(F.concat_ws("/", "brand", "category_id").alias("article_id"), "category_id",
                F.col("brand").alias("keyword"))
    )


RULES_SQL = """
arts AS (SELECT DISTINCT concat(brand, '/', category_id) AS article_id, category_id, brand AS keyword FROM products),
ruled AS (SELECT *, CASE WHEN category_id = 'ECONOMY' AND contains(keyword, 'Brand#1') THEN 1 WHEN category_id IN ('ECONOMY', 'SMALL') THEN 2 END AS priority FROM arts)"""


@query("rule_lookup", fx.with_ctes("products", more=RULES_SQL) + """
SELECT article_id, priority, CASE WHEN priority = 1 THEN concat('kw one|', keyword, '|', keyword, ' 大容量')
  WHEN category_id = 'ECONOMY' THEN concat('kw two|kw three|', keyword)
  ELSE concat(keyword, '|', keyword, ' 大容量|', keyword, ' まとめ買い') END AS keywords,
  CASE WHEN priority = 1 THEN 3 WHEN category_id = 'SMALL' THEN 5 ELSE 4 END AS min_score FROM ruled""")
def rule_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return A.rules_for(report_articles(spark, sf), rules(spark)).select(
        "article_id", "priority", F.array_join("keywords", "|").alias("keywords"), "min_score")


def addition_products(spark: SparkSession, sf: str) -> DataFrame:
    """Every eighth product is listed already; all of them are candidates."""
    return fx.products(spark, sf).filter("orig_idx % 8 = 0").withColumn(
        "article_id", F.concat_ws("/", "brand", "category_id"))


def addition_candidates(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("orig_idx")
    listed = F.concat(F.lit("https://item.rakuten.co.jp/shop"), (i % 7).cast("string"), F.lit("/item"),
                      i.cast("string"), F.lit("/"))
    return fx.products(spark, sf).select(
        F.concat_ws("/", "brand", "category_id").alias("article_id"), i.alias("row_id"),
        (i % 3).alias("query_idx"), i.alias("pos"),
        F.when(i % 10 == 3, F.concat("name", F.lit(" ホルダー")))
        .when(i % 9 == 4, F.col("name")).otherwise(F.concat("name", F.lit(" ｗｗ"), i.cast("string"), F.lit(" "), "capacity")).alias("name"),
        F.when(i % 13 != 0, F.col("price")).alias("price"), "review_count", "rating",
        F.when(i % 17 != 0, listed).alias("item_url"))


def judged(spark: SparkSession, sf: str) -> DataFrame:
    articles = report_articles(spark, sf)
    found = A.rules_for(articles, rules(spark))
    # products deleted some days ago
    deleted = fx.products(spark, sf).filter("orig_idx % 19 = 5").select(
        F.concat_ws("/", "brand", "category_id").alias("article_id"), F.col("base_url").alias("direct_url"),
        F.expr("date_sub(DATE'2024-03-10', CAST(orig_idx % 14 AS INT))").alias("deleted_at"))
    return A.judge_candidates(
        addition_candidates(spark, sf), found, addition_products(spark, sf), deleted,
        F.lit("2024-03-10").cast("date"))


JUDGED_SQL = RULES_SQL + """,
c AS (SELECT concat(brand, '/', category_id) AS article_id, orig_idx AS row_id, orig_idx % 3 AS query_idx, orig_idx AS pos, name, unit, amount, packs, orig_idx AS i,
  CASE WHEN orig_idx % 13 <> 0 THEN price END AS price, review_count, rating, category_id, orig_idx % 10 = 3 AS holder, orig_idx % 10 = 3 OR orig_idx % 9 = 4 AS sizeless
  FROM products),
d AS (SELECT * FROM (SELECT c.*, priority, keyword,
  row_number() OVER (PARTITION BY c.article_id, CASE WHEN i % 17 <> 0 THEN CAST(i AS VARCHAR) ELSE
    concat(name, CASE WHEN holder THEN ' ホルダー' WHEN i % 9 = 4 THEN '' ELSE CAST(i AS VARCHAR) END) END ORDER BY query_idx, pos) AS rn
  FROM c JOIN ruled USING (article_id)) WHERE rn = 1),
h AS (SELECT *,
  CASE WHEN priority = 1 THEN (CASE WHEN contains(name, 'widget') THEN 1 ELSE 0 END)
    WHEN priority = 2 AND category_id = 'ECONOMY' THEN (CASE WHEN contains(name, 'ring') THEN 1 ELSE 0 END) + (CASE WHEN contains(name, 'bolt') THEN 1 ELSE 0 END)
    WHEN priority = 2 THEN (CASE WHEN contains(name, 'gear') THEN 1 ELSE 0 END) ELSE 0 END AS inc,
  CASE WHEN holder THEN 1 ELSE 0 END + CASE WHEN priority = 1 AND contains(name, 'hot') THEN 1 WHEN priority = 2 AND category_id = 'SMALL' AND contains(name, 'old') THEN 1 ELSE 0 END AS exc,
  CASE WHEN priority = 1 THEN (CASE WHEN contains(name, 'red') OR contains(name, 'blue') THEN 1 ELSE 0 END) END AS grp FROM d),
s AS (SELECT *, CASE WHEN inc > 0 THEN 3 + least(inc - 1, 2) ELSE 0 END + 2 * coalesce(grp, 0) - 4 * exc + CASE WHEN price IS NOT NULL THEN 1 ELSE 0 END
  + CASE WHEN review_count >= 1000 THEN 3 WHEN review_count >= 300 THEN 2 WHEN review_count >= 50 THEN 1 ELSE 0 END
  + CASE WHEN coalesce(rating, 0) >= 4.5 THEN 2 WHEN coalesce(rating, 0) >= 4.0 THEN 1 ELSE 0 END AS score,
  CASE WHEN exc > 0 THEN 'カテゴリ外（除外語' WHEN grp = 0 THEN 'カテゴリ外（必須語なし' WHEN inc = 0 THEN 'カテゴリ外（カテゴリ語なし' END AS verdict FROM h),
ex AS (SELECT concat(brand, '/', category_id) AS article_id, replace(name, ' ', '') AS k, unit, amount * packs AS total FROM products WHERE orig_idx % 8 = 0),
exg AS (SELECT *, list_distinct([substr(k, CAST(j AS INTEGER), 4) FOR j IN range(1, length(k) - 2)]) AS g FROM ex),
e AS (SELECT *, CASE WHEN i % 17 = 0 THEN 'URL取得不可' WHEN i % 8 = 0 THEN '既存URL重複' WHEN i % 19 = 5 AND i % 14 <= 7 THEN '直近削除履歴' WHEN verdict IS NOT NULL THEN verdict
  WHEN NOT sizeless AND category_id = 'ECONOMY' AND priority = 2 AND unit NOT IN ('mL', 'L') THEN '比較対象外の容量単位' END AS early,
  replace(concat(name, CASE WHEN holder THEN 'ホルダー' WHEN i % 9 = 4 THEN '' ELSE concat('ww', CAST(i AS VARCHAR)) END), ' ', '') AS raw FROM s),
ek AS (SELECT *, CASE WHEN sizeless THEN raw ELSE regexp_replace(concat(raw, CAST(amount AS VARCHAR), lower(unit), '×', CAST(packs AS VARCHAR), '個'), '[0-9]+[,.]?[0-9]*(ml|g|kg|l|個|本|袋|枚)', '', 'g') END AS k FROM e),
eg AS (SELECT *, list_distinct([substr(k, CAST(j AS INTEGER), 4) FOR j IN range(1, length(k) - 2)]) AS g FROM ek),
cov AS (SELECT DISTINCT row_id FROM eg JOIN exg x USING (article_id) WHERE early IS NULL
  AND (contains(eg.k, x.k) OR contains(x.k, eg.k) OR (len(list_intersect(x.g, eg.g)) >= 2 AND len(list_intersect(x.g, eg.g)) * 4.0 / length(x.k) >= 0.4))
  AND (sizeless OR (eg.unit = x.unit AND amount * packs = x.total))),
judged AS (SELECT e.*, CASE WHEN early IS NOT NULL THEN early WHEN row_id IN (SELECT row_id FROM cov) THEN 'URL違い同一商品'
  WHEN score < CASE WHEN priority = 1 THEN 3 WHEN priority = 2 AND category_id = 'SMALL' THEN 5 ELSE 4 END THEN 'スコア不足' END AS reason FROM e)"""


def _short_reason() -> F.Column:
    """Reason without the words it names."""
    return F.regexp_replace("reason", r"(?:: .*)?）$", "")


@query("candidate_score", fx.with_ctes("products", more=JUDGED_SQL) + "SELECT row_id, score FROM judged")
def candidate_score(spark: SparkSession, sf: str) -> DataFrame:
    return judged(spark, sf).select("row_id", F.col("score").cast("bigint").alias("score"))


@query("addition_filters", fx.with_ctes("products", more=JUDGED_SQL) + "SELECT article_id, row_id, reason FROM judged")
def addition_filters(spark: SparkSession, sf: str) -> DataFrame:
    return judged(spark, sf).select("article_id", "row_id", _short_reason().alias("reason"))


@query("exclusion_stats", fx.with_ctes("products", more=JUDGED_SQL) + """
SELECT article_id, reason, count(*) AS n FROM judged WHERE reason IS NOT NULL GROUP BY ALL""")
def exclusion_stats(spark: SparkSession, sf: str) -> DataFrame:
    return A.exclusion_stats(judged(spark, sf).withColumn("reason", _short_reason()))


@query("exclusion_samples", fx.with_ctes("products", more=JUDGED_SQL) + """
SELECT article_id, row_id, place FROM (SELECT article_id, row_id, row_number() OVER (PARTITION BY article_id ORDER BY query_idx, pos, row_id) AS place
  FROM judged WHERE reason IS NOT NULL) WHERE place <= 5""")
def exclusion_samples(spark: SparkSession, sf: str) -> DataFrame:
    return A.exclusion_samples(judged(spark, sf), 5).select("article_id", "row_id", "place")


@query("addition_topk", fx.with_ctes("products", more=JUDGED_SQL) + """,
n AS (SELECT article_id, count(*) AS n FROM ex GROUP BY 1),
t AS (SELECT article_id, row_id, score, row_number() OVER (PARTITION BY article_id ORDER BY sizeless, score DESC, review_count DESC, coalesce(rating, 0) DESC, query_idx, pos, row_id) AS place
  FROM judged WHERE reason IS NULL)
SELECT t.article_id, row_id, score, place FROM t LEFT JOIN n ON n.article_id = t.article_id WHERE place <= 6 - coalesce(n, 0)""")
def addition_topk(spark: SparkSession, sf: str) -> DataFrame:
    return A.suggestions(judged(spark, sf), addition_products(spark, sf), 6).select(
        "article_id", "row_id", F.col("score").cast("bigint").alias("score"), "place")
