"""Queries over sources, sinks, decisions, merges, exports and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as T
from ..functions import urls as U
from ..functions.arrow import nfkc_lower
from ..operators import decisions as D
from ..operators import exports as X
from ..operators import offers as O
from ..operators import quality as Q
from ..operators import ranking as R
from ..operators import refresh as P
from ..operators import reports as A
from ..session import scratch_path
from ..sources import articles as S
from ..sources import jsonl as J
from ..sources import tables as W
from . import fixtures as fx
from .catalogue import SHELF, shelf
from .matching import FOUND_HITS, found_hits
from .offers import VISIBLE_SQL, visible
from .prices import NUMBERS, fixed_text_sql
from .registry import query
from .text import _NAMED, NAMED_SQL, PAIRS_SQL, faq_articles

# -- Markdown articles -------------------------------------------------------


def markdown(spark: SparkSession, sf: str) -> DataFrame:
    """One Markdown file per document, with two products; some are broken."""
    return fx.articles(spark, sf).join(fx.table(spark, sf, "documents").select("doc_id", "text"), "doc_id").select(
        F.concat(F.lit("/content/"), "article_id", F.lit(".md")).alias("path"),
        F.expr("""concat(IF(doc_id % 23 = 5, '', '---\\n'), 'title: "', title, '"\\ncategory: ', category_id,
          '\\npublishedAt: ', CAST(published_at AS STRING), '\\n', IF(article_type IS NULL, '', concat('articleType: ', article_type, '\\n')),
          IF(doc_id % 29 = 7, 'tags: [a\\n', 'tags: [a, b]\\n'), 'draft: ', CAST(draft AS STRING), '\\nproducts:\\n',
          '  - rank: 1\\n    name: "item ', CAST(doc_id AS STRING), '"\\n    price: ', CAST(n_chars AS STRING), '\\n    offers:\\n',
          '      - provider: yahoo\\n        url: https://s.example/', CAST(doc_id AS STRING), '\\n        matchStatus: matched\\n',
          '  - rank: 2\\n    name: second\\n    price: 5\\n', '---\\n', text)""").alias("content"))


_GOOD = "WHERE doc_id % 23 <> 5 AND doc_id % 29 <> 7"


@query("src_articles", fx.with_ctes("articles") + f"""
SELECT article_id, title, category_id, article_type, draft, CAST(published_at AS VARCHAR) AS published_at, length(d.text) + 1 AS body_length
FROM articles a JOIN documents d USING (doc_id) {_GOOD}""")
def src_articles(spark: SparkSession, sf: str) -> DataFrame:
    records, _ = S.parse_front_matter(markdown(spark, sf))
    return S.article_table(records).select(
        "article_id", "title", "category_id", "article_type", "draft",
        F.col("published_at").cast("string").alias("published_at"), F.length("body").alias("body_length"))


@query("src_rejects", fx.with_ctes("articles") + """
SELECT concat('/content/', article_id, '.md') AS path FROM articles WHERE doc_id % 23 = 5 OR doc_id % 29 = 7""")
def src_rejects(spark: SparkSession, sf: str) -> DataFrame:
    return S.parse_front_matter(markdown(spark, sf))[1]


@query("src_categories", fx.with_ctes("categories") + """
SELECT category_id, name, slug, sort_order FROM categories""")
def src_categories(spark: SparkSession, sf: str) -> DataFrame:
    files = fx.categories(spark, sf).select(
        F.concat(F.lit("/categories/"), "category_id", F.lit(".md")).alias("path"),
        F.concat(F.lit("---\nname: "), "name", F.lit("\nslug: "), "slug", F.lit("\norder: "),
                 F.col("sort_order").cast("string"), F.lit("\n---\n")).alias("content"))
    records, _ = S.parse_front_matter(files, S.CATEGORY)
    return S.category_table(records).select("category_id", "name", "slug", "sort_order")


@query("explode_products", fx.with_ctes("articles") + f"""
SELECT article_id, 0 AS orig_idx, 1 AS rank, concat('item ', CAST(doc_id AS VARCHAR)) AS name, n_chars AS price, concat('https://s.example/', CAST(doc_id AS VARCHAR)) AS offer_url FROM articles {_GOOD}
UNION ALL SELECT article_id, 1, 2, 'second', 5, NULL FROM articles {_GOOD}""")
def explode_products(spark: SparkSession, sf: str) -> DataFrame:
    records, _ = S.parse_front_matter(markdown(spark, sf))
    products = S.explode_products(S.article_table(records))
    return S.product_offers(products).select(
        "article_id", "orig_idx", "rank", "name", "price", F.col("offer.url").alias("offer_url"))


# -- decision lines: one per product, in twelve kinds ------------------------

_MATCH_LINES = """
SELECT concat('reports/', CASE orig_idx % 5 WHEN 0 THEN 'processed' WHEN 1 THEN 'review' WHEN 2 THEN 'failed' WHEN 3 THEN 'review/done' ELSE 'pending' END, '/f', CAST(orig_idx % 5 AS STRING), '.jsonl') AS file,
  orig_idx AS line_no, CASE kind WHEN 3 THEN 'not json' WHEN 5 THEN '  ' WHEN 10 THEN '[1, 2]' ELSE
  to_json(named_struct('articleFile', CASE kind WHEN 4 THEN '../src/x.md' WHEN 9 THEN 'src/content/articles/gone.md' ELSE concat('src/content/articles/', article_id, '.md') END,
    'rank', rank, 'action', CASE WHEN kind IN (1, 2) THEN 'review' WHEN kind = 8 THEN 'noop' ELSE 'replace' END,
    'decision', IF(kind = 1, 'delete', NULL), 'currentName', IF(orig_idx % 2 = 0, IF(kind = 6, 'wrong', name), NULL),
    'current', IF(orig_idx % 2 = 1, named_struct('name', IF(kind = 6, 'wrong', name)), NULL),
    'selectedAffiliateUrl', IF(kind = 7, 'none', 'https://x.example/1'), 'newPrice', price + 1, 'newName', IF(orig_idx % 4 = 0, concat(name, ' v2'), ''),
    'newReviewCount', 'many', 'confidence', 'high', 'reason', concat('r', CAST(orig_idx AS STRING)))) END AS raw
FROM (SELECT *, orig_idx % 12 AS kind FROM {p})
"""
ROUTED = f"""ranked3 AS (SELECT *, orig_idx % 3 + 1 AS rank, orig_idx % 12 AS kind, orig_idx % 5 AS f FROM shelf),
same AS (SELECT article_id, name, count(*) AS same FROM shelf GROUP BY ALL),
cnt AS (SELECT article_id, count(*) AS n FROM shelf GROUP BY ALL),
routed AS (SELECT r.*, CASE WHEN kind = 5 THEN 'noop' WHEN kind IN (3, 4, 10) THEN 'failed'
    WHEN kind <> 9 AND orig_idx // 3 % 10 = 9 THEN 'pending' WHEN kind IN (6, 7, 8, 9) THEN 'failed' ELSE 'processed' END AS outcome,
  CASE WHEN kind = 1 AND same = 1 AND n > 1 THEN 'delete' WHEN kind IN (1, 2) THEN 'review' ELSE 'replace' END AS would
  FROM ranked3 r JOIN same USING (article_id, name) JOIN cnt USING (article_id))"""


def shelf_ranked(spark: SparkSession, sf: str) -> DataFrame:
    return shelf(spark, sf).withColumn("rank", F.col("orig_idx") % 3 + 1)


def match_lines(spark: SparkSession, sf: str) -> DataFrame:
    return J.tolerant(spark.sql(_MATCH_LINES, p=shelf_ranked(spark, sf)))


def routed(spark: SparkSession, sf: str) -> DataFrame:
    products = shelf_ranked(spark, sf)
    wanted = (F.col("article_id") == "gone") | ~F.col("article_id").endswith("9")
    return D.route_decisions(match_lines(spark, sf), products.select("article_id").distinct(), products, wanted)


@query("jsonl_tolerant", fx.with_ctes("products") + """
SELECT orig_idx AS line_no, orig_idx % 12 = 5 AS is_empty, orig_idx % 12 <> 3 AS is_ok, orig_idx % 12 NOT IN (3, 5, 10) AS is_object FROM products""")
def jsonl_tolerant(spark: SparkSession, sf: str) -> DataFrame:
    return match_lines(spark, sf).select("line_no", "is_empty", "is_ok", "is_object")


@query("jsonl_lines", fx.with_ctes("products", more=SHELF) + """
SELECT orig_idx % 5 AS folder, count(*) AS lines, count(*) FILTER (WHERE orig_idx % 12 = 5) AS empty, true AS numbered FROM shelf GROUP BY ALL""")
def jsonl_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Written as text files by folder and read back with line numbers."""
    path = scratch_path(spark, "lines")
    lines = match_lines(spark, sf).select("raw", (F.col("line_no") % 5).alias("folder"))
    lines.write.partitionBy("folder").text(path)
    back = J.tolerant(J.read_lines(spark, path, "*.txt"))
    folder = F.regexp_extract("file", r"folder=(\d+)", 1).cast("bigint")
    per_file = back.groupBy(folder.alias("folder"), "file").agg(
        F.count("*").alias("n"), F.count_if("is_empty").alias("e"),
        (F.max("line_no") == F.count("*")).alias("whole"), (F.min("line_no") == 1).alias("from_one"))
    return per_file.groupBy("folder").agg(
        F.sum("n").alias("lines"), F.sum("e").alias("empty"),
        F.bool_and(F.col("whole") & F.col("from_one")).alias("numbered"))


@query("decision_router", fx.with_ctes("products", more=SHELF + "," + ROUTED) + """
SELECT orig_idx AS line_no, outcome, CASE WHEN outcome = 'processed' THEN would END AS effect FROM routed""")
def decision_router(spark: SparkSession, sf: str) -> DataFrame:
    return routed(spark, sf).select("line_no", "outcome", "effect")


@query("decision_order", fx.with_ctes("products", more=SHELF + "," + ROUTED) + """
SELECT line_no, row_number() OVER (PARTITION BY f, a ORDER BY cls, back, line_no) AS apply_seq FROM (
  SELECT orig_idx AS line_no, f, CASE kind WHEN 4 THEN 'x' WHEN 9 THEN 'gone' ELSE article_id END AS a,
    CASE WHEN kind IN (1, 2) THEN 1 WHEN kind = 8 THEN 2 ELSE 0 END AS cls, CASE WHEN kind IN (1, 2) THEN -rank ELSE 0 END AS back
  FROM routed WHERE kind NOT IN (3, 5, 10))""")
def decision_order(spark: SparkSession, sf: str) -> DataFrame:
    return D.application_order(routed(spark, sf)).select("line_no", "apply_seq")


@query("apply_decisions", fx.with_ctes("products", more=SHELF + "," + ROUTED) + """,
acts AS (SELECT orig_idx, would FROM routed WHERE outcome = 'processed' AND would IN ('replace', 'delete')),
touched AS (SELECT DISTINCT article_id FROM routed JOIN acts USING (orig_idx) WHERE acts.would = 'delete'),
kept AS (SELECT r.*, a.would AS act, row_number() OVER (PARTITION BY r.article_id ORDER BY r.orig_idx) AS nr FROM ranked3 r LEFT JOIN acts a USING (orig_idx) WHERE a.would IS DISTINCT FROM 'delete')
SELECT orig_idx, CASE WHEN article_id IN (SELECT article_id FROM touched) THEN nr ELSE rank END AS rank,
  CASE WHEN act = 'replace' AND orig_idx % 4 = 0 THEN concat(name, ' v2') ELSE name END AS name,
  CASE WHEN act = 'replace' THEN price + 1 ELSE price END AS price, review_count,
  CASE WHEN act = 'replace' THEN 'https://x.example/1' ELSE base_url END AS base_url FROM kept""")
def apply_decisions(spark: SparkSession, sf: str) -> DataFrame:
    products, _ = D.apply_decisions(shelf_ranked(spark, sf), routed(spark, sf))
    return products.select("orig_idx", "rank", "name", "price", "review_count", "base_url")


@query("deletion_history", fx.with_ctes("products", more=SHELF + "," + ROUTED) + """
SELECT '2024-03-10' AS deleted_at, article_id, 'ai-review' AS reason, rank, name, base_url AS direct_url, replace(name, ' ', '') AS identity_key
FROM routed WHERE outcome = 'processed' AND would = 'delete'""")
def deletion_history(spark: SparkSession, sf: str) -> DataFrame:
    _, deleted = D.apply_decisions(shelf_ranked(spark, sf), routed(spark, sf))
    rows = W.deletion_rows(
        deleted, F.lit("2024-03-10").cast("date"), "ai-review", U.direct_item_url(F.col("base_url")),
        T.identity_key(nfkc_lower(F.col("name"))))
    path = scratch_path(spark, "deleted")
    W.append_deletions(rows, path)
    return spark.read.parquet(path).select(
        F.col("deleted_at").cast("string").alias("deleted_at"), "article_id", "reason", "rank", "name", "direct_url", "identity_key")


@query("file_finalization", fx.with_ctes("products", more=SHELF + "," + ROUTED) + """
SELECT f, bool_or(outcome = 'pending') AS has_pending, bool_or(outcome = 'failed') AS has_failed,
  count(*) FILTER (WHERE outcome = 'processed') AS processed,
  CASE WHEN bool_or(outcome = 'pending') THEN 'pending' WHEN bool_or(outcome = 'failed') THEN 'failed' ELSE 'processed' END AS status FROM routed GROUP BY f""")
def file_finalization(spark: SparkSession, sf: str) -> DataFrame:
    return D.finalize_files(routed(spark, sf)).select(
        F.regexp_extract("file", r"f(\d)\.jsonl", 1).cast("bigint").alias("f"), "has_pending", "has_failed",
        "processed", "status")


@query("rag_decisions", fx.with_ctes("products", more=SHELF + "," + ROUTED) + """
SELECT orig_idx % 3 + 1 AS rank, name AS current_name, concat('r', CAST(orig_idx AS VARCHAR)) AS reason,
  CASE f WHEN 0 THEN 'processed' WHEN 1 THEN 'review' WHEN 2 THEN 'failed' WHEN 3 THEN 'review_done' ELSE 'unknown' END AS status
FROM (SELECT * REPLACE (CASE WHEN kind = 6 THEN 'wrong' ELSE name END AS name) FROM routed) WHERE kind NOT IN (3, 5, 10)""")
def rag_decisions(spark: SparkSession, sf: str) -> DataFrame:
    return X.decision_records(match_lines(spark, sf)).select("rank", "current_name", "reason", "status")


@query("decision_history", fx.with_ctes("products", more=SHELF) + """,
d AS (SELECT article_id, orig_idx AS decision_id, orig_idx % 2 + 1 AS rank, name AS current_name FROM shelf)
SELECT p.orig_idx, decision_id FROM (SELECT *, orig_idx % 3 + 1 AS rank FROM shelf) p JOIN d ON d.article_id = p.article_id AND (d.rank = p.rank OR d.current_name = p.name)""")
def decision_history(spark: SparkSession, sf: str) -> DataFrame:
    made = shelf(spark, sf).select(
        "article_id", F.col("orig_idx").alias("decision_id"), (F.col("orig_idx") % 2 + 1).alias("rank"),
        F.col("name").alias("current_name"))
    return D.decision_history(shelf_ranked(spark, sf), made)


# -- pack-size decisions: thirteen kinds -------------------------------------

_SIZE_LINES = """
SELECT concat('f', CAST(orig_idx % 5 AS STRING), '.jsonl') AS file, orig_idx AS line_no,
  to_json(named_struct('articleFile', concat('src/content/articles/', article_id, '.md'), 'rank', IF(kind = 11, 9, rank),
    'decision', CASE kind WHEN 1 THEN 'keep' WHEN 2 THEN 'clear' WHEN 3 THEN 'review' WHEN 12 THEN 'maybe' ELSE 'apply' END,
    'current', named_struct('name', IF(kind = 5, 'wrong', name), 'capacity', CASE kind WHEN 6 THEN '1巻' WHEN 7 THEN concat(CAST(amount * packs * IF(unit IN ('L', 'kg'), 1000, 1) AS STRING), CASE unit WHEN 'L' THEN 'mL' WHEN 'kg' THEN 'g' ELSE unit END) ELSE capacity END,
      'price', IF(kind = 4, price + 1, price), 'rakutenUrl', IF(kind = 10, 'https://item.rakuten.co.jp/a/b/', base_url)),
    'basis', IF(kind = 8, NULL, named_struct('apiPrice', IF(kind = 9, price + 2, price), 'itemUrl', upper_host, 'affiliateUrl', concat('https://hb.afl.rakuten.co.jp/x/?pc=', url_encode(base_url)))),
    'newCapacity', IF(orig_idx % 2 = 0, capacity, IF(orig_idx % 7 = 0, 'unreadable', concat(CAST(amount + 1 AS STRING), unit))))) AS raw
FROM (SELECT *, orig_idx % 13 AS kind, replace(base_url, '/shop', '/SHOP') AS upper_host FROM {p})
"""
SIZE_SQL = """g AS (SELECT *, orig_idx % 3 + 1 AS rank, orig_idx % 13 AS kind FROM shelf),
o AS (SELECT *, CASE WHEN kind = 12 THEN 'failed' WHEN kind IN (3, 4, 5, 6, 8, 9, 10, 11) THEN 'review' ELSE 'processed' END AS outcome,
  CASE kind WHEN 12 THEN 'unsupported decision' WHEN 3 THEN 'review' WHEN 4 THEN 'current.price mismatch' WHEN 5 THEN 'rank/current.name mismatch'
    WHEN 6 THEN 'current.capacity mismatch' WHEN 8 THEN 'basis is required for auto apply' WHEN 9 THEN 'basis.apiPrice mismatch'
    WHEN 10 THEN 'current.rakutenUrl points to a different item' WHEN 11 THEN 'rank not found' ELSE 'ok' END AS message FROM g)"""


def size_lines(spark: SparkSession, sf: str) -> DataFrame:
    return J.tolerant(spark.sql(_SIZE_LINES, p=shelf_ranked(spark, sf)))


@query("stale_guard", fx.with_ctes("products", more=SHELF + "," + SIZE_SQL) + "SELECT orig_idx AS line_no, outcome, message FROM o")
def stale_guard(spark: SparkSession, sf: str) -> DataFrame:
    return D.stale_guard(size_lines(spark, sf), shelf_ranked(spark, sf)).select("line_no", "outcome", "message")


@query("apply_capacity_decisions", fx.with_ctes("products", more=SHELF + "," + SIZE_SQL) + f""",
n AS (SELECT *, CASE WHEN outcome = 'processed' AND kind IN (0, 7) AND orig_idx % 2 = 0 THEN CAST(price AS DOUBLE) / (amount * packs)
    WHEN outcome = 'processed' AND kind IN (0, 7) AND orig_idx % 7 <> 0 THEN CAST(price AS DOUBLE) / (amount + 1) END AS v FROM o)
SELECT orig_idx, CASE WHEN kind = 2 THEN '-' WHEN v IS NOT NULL AND orig_idx % 2 = 1 THEN concat(CAST(amount + 1 AS VARCHAR), unit) ELSE capacity END AS capacity,
  CASE WHEN kind = 2 THEN '-' WHEN v IS NOT NULL THEN concat('約', {fixed_text_sql('v')}, '円/', unit) END AS price_per_unit FROM n""")
def apply_capacity_decisions(spark: SparkSession, sf: str) -> DataFrame:
    products = shelf_ranked(spark, sf).withColumn("price_per_unit", F.lit(None).cast("string"))
    updates = D.size_updates(D.stale_guard(size_lines(spark, sf), products))
    return D.apply_size_updates(products, updates).select("orig_idx", "capacity", "price_per_unit")


@query("frozen_products", fx.with_ctes("products", more=SHELF + "," + SIZE_SQL) + """
SELECT article_id, rank, name, concat('shop', CAST(orig_idx % 7 AS VARCHAR), ':item', CAST(orig_idx AS VARCHAR)) AS item_key
FROM o WHERE kind = 1 OR kind IN (0, 4, 6, 7, 8, 9) AND
  (orig_idx % 2 = 0 OR (orig_idx % 7 <> 0 AND amount + 1 = amount * packs))""")
def frozen_products(spark: SparkSession, sf: str) -> DataFrame:
    return D.frozen_products(size_lines(spark, sf), shelf_ranked(spark, sf))


# -- merges ------------------------------------------------------------------

_STATUS = "CASE orig_idx % 6 WHEN 1 THEN 'matched' WHEN 3 THEN 'pending' WHEN 4 THEN 'rejected' WHEN 5 THEN 'review' END"
UPSERT = f"""u AS (SELECT orig_idx, CASE WHEN orig_idx % 5 = 0 THEN 'amazon' ELSE 'yahoo' END AS provider, orig_idx % 6 <> 0 AS had, {_STATUS} AS st,
  orig_idx // 6 % 2 = 0 AS same, orig_idx // 12 % 2 = 0 AS verified, orig_idx // 24 % 2 = 0 AS strict, orig_idx // 48 % 2 = 0 AS force,
  price, CASE WHEN orig_idx % 7 <> 0 THEN price + 3 END AS new_price FROM products),
a AS (SELECT *, CASE WHEN NOT had THEN 'insert' WHEN st IN ('review', 'rejected') THEN 'locked'
  WHEN coalesce(st, 'matched') = 'matched' THEN CASE WHEN same THEN 'refresh' WHEN force THEN 'replace' ELSE 'other_url' END
  ELSE CASE WHEN same THEN 'refresh' WHEN verified THEN 'replace' ELSE 'pending_other_url' END END AS action FROM u)"""


@query("offer_upsert", fx.with_ctes("products", more=UPSERT) + """
SELECT orig_idx, provider, action, CASE WHEN action IN ('insert', 'replace') THEN 'pending'
    WHEN action = 'refresh' AND st = 'pending' AND verified AND strict THEN 'matched' ELSE st END AS match_status,
  CASE WHEN action IN ('insert', 'refresh', 'replace') THEN
    CASE WHEN provider <> 'amazon' THEN CASE action WHEN 'refresh' THEN coalesce(new_price, price) ELSE new_price END END ELSE price END AS price,
  CASE WHEN action IN ('insert', 'replace') AND NOT (had AND same) THEN CASE WHEN same THEN 'https://s.example/1' ELSE 'https://s.example/2' END ELSE 'https://s.example/1' END AS url,
  CASE WHEN action IN ('insert', 'replace') OR (action = 'refresh' AND st = 'pending') THEN 'new' ELSE 'old' END AS label,
  action IN ('insert', 'refresh', 'replace') AS changed FROM a""")
def offer_upsert(spark: SparkSession, sf: str) -> DataFrame:
    i, none = F.col("orig_idx"), F.lit(None)
    provider = F.when(i % 5 == 0, "amazon").otherwise("yahoo")
    common = {"provider": provider, "rating": none.cast("double"), "image_url": none.cast("string"),
              "catalogue_id": none.cast("string"), "available": F.lit(True)}
    base = fx.products(spark, sf).withColumns(common)
    current = base.filter("orig_idx % 6 <> 0").withColumns({
        "label": F.lit("old"), "url": F.lit("https://s.example/1"), "match_status": F.expr(_STATUS),
        "updated_at": F.lit("2024-01-01").cast("date")})
    incoming = base.withColumns({
        "label": F.lit("new"), "updated_at": F.lit("2024-03-10").cast("date"),
        "url": F.when(F.floor(i / 6) % 2 == 0, "https://s.example/1").otherwise("https://s.example/2"),
        "price": F.when(i % 7 != 0, F.col("price") + 3),
        "verified": F.floor(i / 12) % 2 == 0, "strict": F.floor(i / 24) % 2 == 0, "force": F.floor(i / 48) % 2 == 0})
    return O.upsert_offers(current, incoming, ["orig_idx"]).select(
        "orig_idx", "provider", "action", "match_status", "price", "url", "label", "changed")


@query("offer_invalidate", fx.with_ctes("offers") + """
SELECT orig_idx, pos, provider, hit AS changed, CASE WHEN hit THEN 'review' ELSE match_status END AS match_status,
  CASE WHEN hit THEN false ELSE available END AS available
FROM (SELECT *, orig_idx % 4 = 0 AND provider = 'yahoo' AND coalesce(match_status, '') <> 'rejected' AS hit FROM offers)""")
def offer_invalidate(spark: SparkSession, sf: str) -> DataFrame:
    changes = fx.products(spark, sf).filter("orig_idx % 4 = 0").select(
        "orig_idx", F.concat(F.lit("capacity changed: "), "capacity").alias("notes"))
    offers = fx.offers(spark, sf).withColumn("match_notes", F.lit(None).cast("string"))
    return O.invalidate_offers(offers, changes, ["orig_idx"], "yahoo").select(
        "orig_idx", "pos", "provider", "changed", "match_status", "available")


@query("guarded_update", fx.with_ctes("products", more=SHELF) + """
SELECT article_id, CASE WHEN orig_idx % 10 = 4 THEN 7 ELSE orig_idx % 3 + 1 END AS rank, CASE WHEN orig_idx % 10 = 4 THEN NULL WHEN orig_idx % 5 <> 0 THEN CASE WHEN orig_idx % 3 = 0 THEN price ELSE price + 2 END ELSE price END AS price,
  CASE WHEN orig_idx % 10 = 4 THEN false ELSE orig_idx % 5 <> 0 AND orig_idx % 3 <> 0 END AS changed,
  CASE WHEN orig_idx % 10 = 4 THEN 'rank not found' WHEN orig_idx % 5 = 0 THEN 'expected fields mismatch' END AS reason FROM shelf""")
def guarded_update(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("orig_idx")
    updates = shelf_ranked(spark, sf).select(
        "article_id", F.when(i % 10 == 4, 7).otherwise(F.col("rank")).alias("rank"),
        F.when(i % 3 != 0, F.col("price") + 2).alias("new_price"),
        F.lit(True).alias("check_name"), F.when(i % 5 != 0, F.col("name")).alias("expect_name"))
    return D.guarded_update(shelf_ranked(spark, sf), updates, ["price"], ["name"]).select(
        "article_id", "rank", "price", "changed", "reason")


@query("append_missing", fx.with_ctes("products") + """
SELECT DISTINCT concat(name, ' ', CAST(packs AS VARCHAR)) AS line FROM products WHERE concat(name, ' ', CAST(packs AS VARCHAR)) NOT IN
  (SELECT concat(name, ' ', CAST(packs AS VARCHAR)) FROM products WHERE orig_idx % 20 = 0)""")
def append_missing(spark: SparkSession, sf: str) -> DataFrame:
    lines = fx.products(spark, sf).select("orig_idx", F.concat("name", F.lit(" "), F.col("packs").cast("string")).alias("line"))
    return W.missing_lines(lines.select("line"), lines.filter("orig_idx % 20 = 0").select("line"))


@query("apply_snapshot", fx.with_ctes("products") + """
SELECT orig_idx, CASE WHEN orig_idx % 4 = 0 THEN price + 10 ELSE price END AS price,
  CASE WHEN orig_idx % 4 = 0 THEN '2024-03-10' ELSE '2024-03-01' END AS updated_at FROM products""")
def apply_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    """Two runs; the second writes its changed rows only."""
    path = scratch_path(spark, "snapshot")
    first = fx.products(spark, sf).select("orig_idx", "price")
    day = F.lit("2024-03-01").cast("date")
    W.append_snapshot(first.withColumn("updated_at", day), path, "2024-03-01")
    second = first.withColumn("price", F.when(F.col("orig_idx") % 4 == 0, F.col("price") + 10).otherwise(F.col("price")))
    changed = W.changed_rows(first, second, ["orig_idx"], ["price"], F.lit("2024-03-10").cast("date"))
    W.append_snapshot(changed, path, "2024-03-10")
    return W.latest_snapshot(spark.read.parquet(path), ["orig_idx"]).select(
        "orig_idx", "price", F.col("updated_at").cast("string").alias("updated_at"))


# -- exports -----------------------------------------------------------------

REC = SHELF + "," + """
recs AS (SELECT s.*, a.category_id AS category, CASE WHEN orig_idx % 9 = 0 THEN '要更新' ELSE NULL END AS ppu
  FROM shelf s JOIN articles a USING (article_id) WHERE coalesce(article_type, 'comparison') <> 'review' AND orig_idx % 31 <> 0)"""


def records(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("orig_idx")
    products = shelf_ranked(spark, sf).withColumns({
        "rank": F.when(i % 31 != 0, F.col("rank")),
        "capacity": F.when(i % 8 == 1, "-").when(i % 8 == 3, "箱入り").otherwise(F.col("capacity")),
        "name": F.when(i % 6 == 0, F.concat("name", F.lit(" お試し"))).otherwise(F.col("name")),
        "price_per_unit": F.when(i % 9 == 0, "要更新")})
    articles = fx.articles(spark, sf).withColumn(
        "article_file", F.concat(F.lit("src/content/articles/"), "article_id", F.lit(".md")))
    return X.product_records(products, articles, fx.offers(spark, sf))


@query("rag_products", fx.with_ctes("products", "articles", "offers", more=REC) + """
SELECT orig_idx, category, CASE WHEN orig_idx % 8 = 1 THEN '-' WHEN orig_idx % 8 = 3 THEN '箱入り' ELSE capacity END AS capacity,
  CASE WHEN orig_idx % 8 NOT IN (1, 3) THEN CAST(amount * packs AS DOUBLE) * CASE WHEN unit IN ('L', 'kg') THEN 1000 ELSE 1 END END AS total,
  concat_ws('|', CASE WHEN orig_idx % 8 = 1 THEN 'capacity未設定' WHEN orig_idx % 8 = 3 THEN 'capacity抽出不可' END, CASE WHEN orig_idx % 9 = 0 THEN 'pricePerUnit要確認' END) AS reasons,
  orig_idx % 8 IN (1, 3) OR orig_idx % 9 = 0 AS needs_review FROM recs""")
def rag_products(spark: SparkSession, sf: str) -> DataFrame:
    return records(spark, sf).select(
        "orig_idx", "category", "capacity", F.col("capacity_total.total").alias("total"),
        F.array_join("review_reasons", "|").alias("reasons"), "needs_review")


def patterns(spark: SparkSession, sf: str) -> DataFrame:
    from_articles = X.capacity_patterns(records(spark, sf), "article")
    reported = fx.products(spark, sf).select(
        F.concat(F.lit("report/"), "article_id").alias("article_file"), "name",
        F.concat(F.col("amount").cast("string"), F.lit("袋入り")).alias("capacity"), "price",
        F.lit(None).cast("string").alias("price_per_unit"))
    return from_articles.unionByName(X.capacity_patterns(reported, "report"))


@query("capacity_patterns", fx.with_ctes("products", "articles", more=REC) + """
SELECT 'article' AS source, count(*) AS n, count(*) FILTER (WHERE orig_idx % 8 IN (1, 3) OR orig_idx % 9 = 0) AS review,
  count(*) FILTER (WHERE orig_idx % 8 IN (1, 3)) AS unreadable FROM recs
UNION ALL SELECT 'report', count(*), 0, 0 FROM products""")
def capacity_patterns(spark: SparkSession, sf: str) -> DataFrame:
    return patterns(spark, sf).groupBy("source").agg(
        F.count("*").alias("n"), F.count_if("needs_review").alias("review"),
        F.count_if(F.col("extracted").isNull()).alias("unreadable"))


@query("category_rules", fx.with_ctes("products", "articles", more=REC) + """,
n AS (SELECT *, CASE unit WHEN 'L' THEN 'mL' WHEN 'kg' THEN 'g' ELSE unit END AS u, (concat('src/content/articles/', article_id, '.md'), orig_idx) AS spot FROM recs),
uc AS (SELECT category, u, count(*) AS c, min(spot) AS first FROM n WHERE orig_idx % 8 NOT IN (1, 3) GROUP BY ALL),
us AS (SELECT category, string_agg(u, ',' ORDER BY c DESC, first) AS units FROM uc GROUP BY ALL),
bc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY c DESC, first) AS r FROM (SELECT category, brand, count(*) AS c, min(spot) AS first FROM n GROUP BY ALL) WHERE c >= 2) WHERE r <= 10),
bs AS (SELECT category, string_agg(brand, ',' ORDER BY r) AS brands FROM bc GROUP BY ALL)
SELECT category, coalesce(units, '') AS units, coalesce(brands, '') AS brands, CASE WHEN bool_or(orig_idx % 6 = 0) THEN 'お試し' ELSE '' END AS signals, count(*) AS product_count
FROM n LEFT JOIN us USING (category) LEFT JOIN bs USING (category) GROUP BY ALL""")
def category_rules(spark: SparkSession, sf: str) -> DataFrame:
    rules = X.category_rules(records(spark, sf))
    return rules.select("category", F.array_join("units", ",").alias("units"),
                        F.array_join("common_brands", ",").alias("brands"),
                        F.array_join("review_signals", ",").alias("signals"), "product_count")


@query("export_summary", fx.with_ctes("products", "articles", more=REC) + """
SELECT 'product' AS "table", count(*) AS "rows", count(*) FILTER (WHERE orig_idx % 8 IN (1, 3) OR orig_idx % 9 = 0) AS needs_review FROM recs
UNION ALL SELECT 'category-rule', count(DISTINCT category), NULL FROM recs""")
def export_summary(spark: SparkSession, sf: str) -> DataFrame:
    found = records(spark, sf)
    return X.export_summary({"product": found, "category-rule": X.category_rules(found)})


@query("search_records", fx.with_ctes("products", "articles", more=REC) + """
SELECT 'product' AS "table", concat(article_id, '/', CAST(orig_idx AS VARCHAR)) AS record_key FROM recs
WHERE contains(concat(lower(name), CASE WHEN orig_idx % 6 = 0 THEN ' お試し' ELSE '' END), 'widget お試し') ORDER BY 2 LIMIT 20""")
def search_records(spark: SparkSession, sf: str) -> DataFrame:
    found = records(spark, sf)
    tables = {"product": found.drop("offer_summary"), "category-rule": X.category_rules(found)}
    order = {"product": ["article_id", "orig_idx"], "category-rule": ["category"]}
    return X.search_records(tables, order, "Widget お試し").select("table", "record_key")


@query("sink_jsonl", fx.with_ctes("products") + "SELECT orig_idx, name, capacity, price, rating FROM products")
def sink_jsonl(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "records")
    df = fx.products(spark, sf).select("orig_idx", "name", "capacity", "price", "rating")
    W.write_jsonl(df, path)
    return spark.read.schema(df.schema).json(path)


@query("product_documents", fx.with_ctes("products", "offers", more=VISIBLE_SQL) + """
SELECT p.orig_idx, coalesce(lowest_price, price) AS offer_price, CAST(p.rating AS DOUBLE) AS rating, p.name
FROM products p LEFT JOIN low USING (orig_idx) WHERE p.rating IS NOT NULL""")
def product_documents(spark: SparkSession, sf: str) -> DataFrame:
    low = O.lowest_offer(O.comparable(visible(spark, sf)), "orig_idx").select(
        "orig_idx", F.col("price").alias("_low"), F.col("url").alias("_url"))
    shown = fx.products(spark, sf).join(low, "orig_idx", "left").withColumns({
        "offer_price": F.coalesce("_low", F.when(F.col("price") > 0, F.col("price"))),
        "offer_url": F.coalesce("_url", "base_url")})
    docs = X.product_documents(shown)
    return docs.select(
        "orig_idx", F.get_json_object("document", "$.offers.price").cast("bigint").alias("offer_price"),
        F.get_json_object("document", "$.aggregateRating.ratingValue").cast("double").alias("rating"),
        F.get_json_object("document", "$.name").alias("name"))


@query("article_documents", fx.with_ctes("articles", "categories") + """
SELECT article_id, title AS headline, CAST(coalesce(updated_at, published_at) AS VARCHAR) AS modified,
  concat('https://site.example/category/', slug) AS crumb FROM articles a JOIN categories c USING (category_id)""")
def article_documents(spark: SparkSession, sf: str) -> DataFrame:
    heads = fx.articles(spark, sf).join(
        fx.categories(spark, sf).select("category_id", F.col("name").alias("category_name"), "slug"), "category_id")
    docs = X.article_documents(heads.withColumn("description", F.col("source")), "https://site.example")
    return docs.select(
        "article_id", F.get_json_object("article", "$.headline").alias("headline"),
        F.get_json_object("article", "$.dateModified").alias("modified"),
        F.get_json_object("breadcrumb", "$.itemListElement[1].item").alias("crumb"))


@query("faq_documents", PAIRS_SQL + """
SELECT doc, n AS questions, first AS first_answer FROM per JOIN (SELECT doc, arg_min(a, pos) AS first FROM kept GROUP BY doc) USING (doc)""")
def faq_documents(spark: SparkSession, sf: str) -> DataFrame:
    rows = Q.with_faqs(faq_articles(spark, sf), "faqs").withColumn("article_id", F.col("doc"))
    docs = X.faq_documents(rows)
    return docs.select(
        F.col("article_id").alias("doc"),
        F.size(F.from_json(F.get_json_object("document", "$.mainEntity"), "array<string>")).alias("questions"),
        F.get_json_object("document", "$.mainEntity[0].acceptedAnswer.text").alias("first_answer"))


@query("latest_reports", """
SELECT DISTINCT concat('reports/addition-candidates-', strftime(o_orderdate, '%Y-%m'), '-01.md') AS file, 'addition-candidates' AS kind,
  concat(strftime(o_orderdate, '%Y-%m'), '-01') AS date, true AS written FROM orders ORDER BY file DESC LIMIT 5""")
def latest_reports(spark: SparkSession, sf: str) -> DataFrame:
    """Newest report files of a folder of exports written by day."""
    path = scratch_path(spark, "reports")
    days = F.date_format("o_orderdate", "yyyy-MM")
    totals = fx.table(spark, sf, "orders").groupBy(days.alias("month")).agg(F.count("*").alias("n"))
    totals.write.partitionBy("month").json(path)
    files = W.list_files(spark, path)
    month = F.regexp_extract("path", r"month=(\d{4}-\d{2})", 1)
    named = files.filter(F.col("path").endswith(".json")).select(
        F.concat(F.lit("reports/addition-candidates-"), month, F.lit("-01.md")).alias("path"), "length")
    newest = W.latest_reports(named, "addition-candidates", 5)
    return newest.select("file", "kind", "date", (F.col("size") > 0).alias("written"))


@query("ga_format_rows", """
SELECT event_id, event_type AS kind, CASE WHEN event_id % 3 = 0 THEN '' ELSE CAST(user_id AS VARCHAR) END AS who, '' AS extra FROM events""")
def ga_format_rows(spark: SparkSession, sf: str) -> DataFrame:
    user = F.when(F.col("event_id") % 3 != 0, F.col("user_id").cast("string"))
    rows = fx.table(spark, sf, "events").select(
        "event_id", F.array(F.lit("kind"), F.lit("who"), F.lit("extra")).alias("headers"),
        F.array(F.col("event_type"), user).alias("values"))
    named = W.named_values(rows, "headers", "values")
    return named.select("event_id", *[F.col("named")[k].alias(k) for k in ("kind", "who", "extra")])


# -- analytics ---------------------------------------------------------------

def events(spark: SparkSession, sf: str) -> DataFrame:
    return fx.table(spark, sf, "events").withColumns({
        "day": F.to_date("ts"), "page": F.concat(F.lit("/p/"), F.get_json_object("props", "$.k")),
        "device": F.when(F.col("user_id") % 2 == 0, "mobile").otherwise("desktop")})


EVENTS = """e AS (SELECT *, CAST(ts AS DATE) AS day, concat('/p/', json_extract_string(props, '$.k')) AS page,
  CASE WHEN user_id % 2 = 0 THEN 'mobile' ELSE 'desktop' END AS device, CAST(round(value * 100) AS BIGINT) AS cents FROM events)"""


@query("search_analytics", f"WITH {EVENTS}" + """
SELECT page, device, count(*) FILTER (WHERE event_type = 'click') AS clicks, count(*) AS impressions,
  floor(CAST(count(*) FILTER (WHERE event_type = 'click') AS DOUBLE) / count(*) * 10000 + 0.5) / 100 AS ctr,
  floor(CAST(sum(cents) AS DOUBLE) / 100 / count(*) * 10 + 0.5) / 10 AS position
FROM e WHERE day BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' GROUP BY ALL ORDER BY clicks DESC, page, device LIMIT 100""")
def search_analytics(spark: SparkSession, sf: str) -> DataFrame:
    return A.search_analytics(events(spark, sf), "2024-01-05", "2024-01-20", ["page", "device"])


@query("traffic_report", f"WITH {EVENTS}" + """
SELECT CAST(day AS VARCHAR) AS day, device, count(*) FILTER (WHERE event_type = 'view') AS screenPageViews, count(DISTINCT user_id) AS activeUsers,
  count(DISTINCT (user_id, day)) AS sessions, count(DISTINCT (user_id, day)) FILTER (WHERE event_type IN ('click', 'purchase')) AS engagedSessions,
  count(*) AS eventCount, CAST(sum(cents) AS DOUBLE) / 100 / count(DISTINCT (user_id, day)) AS averageSessionDuration
FROM e WHERE e.day BETWEEN DATE '2024-01-01' AND DATE '2024-01-30' GROUP BY e.day, device""")
def traffic_report(spark: SparkSession, sf: str) -> DataFrame:
    report = A.traffic_report(
        events(spark, sf), "30daysAgo", "yesterday", "2024-01-31", ["day", "device"],
        ["screenPageViews", "activeUsers", "sessions", "engagedSessions", "eventCount", "averageSessionDuration"])
    return report.withColumn("day", F.col("day").cast("string"))


@query("zero_runs", """
WITH n AS (SELECT user_id, event_type = 'error' AS z, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS a FROM events),
m AS (SELECT *, a - row_number() OVER (PARTITION BY user_id ORDER BY a) AS island FROM n WHERE z)
SELECT user_id, min(a) AS start_pos, count(*) AS run_length FROM m GROUP BY user_id, island HAVING count(*) >= 3""")
def zero_runs(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type")
    return R.long_runs(rows, "user_id", [F.col("ts"), F.col("event_id")], F.col("event_type") == "error")


# -- price refresh -----------------------------------------------------------

@query("unit_price_sync", fx.with_ctes("products", more=NUMBERS) + f""",
v AS (SELECT *, CAST(price AS DOUBLE) / total AS v FROM sized)
SELECT orig_idx, CASE WHEN orig_idx % 4 = 0 THEN 'old' ELSE concat('約', {fixed_text_sql('v')}, '円/', unit) END AS price_per_unit,
  orig_idx % 4 <> 0 AS unit_price_changed FROM v""")
def unit_price_sync(spark: SparkSession, sf: str) -> DataFrame:
    df = fx.products(spark, sf).withColumn("price_per_unit", F.lit("old"))
    return P.sync_unit_prices(df, None, F.col("orig_idx") % 4 == 0).select(
        "orig_idx", "price_per_unit", "unit_price_changed")


REFRESH = NAMED_SQL + """,
w AS (SELECT *, orig_idx % 11 = 4 AS frozen, form IN (0, 2) AND packs = 1 OR form = 4 OR form = 8 OR (form = 6 AND amount = 1) AS low,
  CAST(amount * packs AS DOUBLE) * CASE WHEN unit IN ('L', 'kg') THEN 1000 ELSE 1 END AS t1,
  CASE unit WHEN 'L' THEN 'mL' WHEN 'kg' THEN 'g' ELSE unit END AS u1,
  CAST(found_amount AS DOUBLE) * CASE WHEN found_unit IN ('L', 'kg') THEN 1000 ELSE 1 END AS t2,
  CASE found_unit WHEN 'L' THEN 'mL' WHEN 'kg' THEN 'g' ELSE found_unit END AS u2 FROM read)"""


def decided(spark: SparkSession, sf: str) -> DataFrame:
    """Products beside an item that carries the composed name."""
    df = spark.sql(_NAMED.replace("FROM products", "FROM {p}"), p=fx.products(spark, sf)).withColumns({
        "item_price": F.col("price") + 4, "exact": F.lit(True), "frozen": F.col("orig_idx") % 11 == 4,
        "price_per_unit": F.lit("old"), "item_url": F.col("base_url"), "target_unit": F.lit(None).cast("string")})
    return P.decide_fields(df, F.col("target_unit"))


@query("capacity_review", fx.with_ctes("products", more=REFRESH) + """
SELECT orig_idx, NOT frozen AND (low OR form = 8 OR (found IS NOT NULL AND (t1 <> t2 OR u1 <> u2))) AS needs_review,
  CASE WHEN frozen THEN 'frozen' WHEN found IS NULL THEN 'no_size' END AS special FROM w""")
def capacity_review(spark: SparkSession, sf: str) -> DataFrame:
    special = F.when(F.col("rule").isin("frozen", "no_size"), F.col("rule"))
    return decided(spark, sf).select("orig_idx", "needs_review", special.alias("special"))


@query("review_inputs", fx.with_ctes("products", more=REFRESH) + """
SELECT orig_idx, capacity, price + 4 AS price, price + 4 AS api_price, found FROM w
WHERE NOT frozen AND (low OR form = 8 OR (found IS NOT NULL AND (t1 <> t2 OR u1 <> u2)))""")
def review_inputs(spark: SparkSession, sf: str) -> DataFrame:
    items = P.review_inputs(decided(spark, sf).filter("needs_review"))
    return items.select("orig_idx", "current.capacity", "current.price", F.col("basis.apiPrice").alias("api_price"),
                        F.col("ruleAnalysis.extractedCapacity").alias("found"))


@query("review_report", fx.with_ctes("products", more=REFRESH) + """
SELECT count(*) AS items, count(*) FILTER (WHERE found IS NULL) AS without_size FROM w
WHERE NOT frozen AND (low OR form = 8 OR (found IS NOT NULL AND (t1 <> t2 OR u1 <> u2)))""")
def review_report(spark: SparkSession, sf: str) -> DataFrame:
    lines = P.review_lines(decided(spark, sf).filter("needs_review"))
    return lines.agg(F.count_if(F.col("line_no") == 0).alias("items"),
                     F.count_if(F.col("line") == "- API extracted capacity: -").alias("without_size"))


@query("price_refresh", fx.with_ctes("products", more=REFRESH) + f""",
v AS (SELECT *, CAST(price + 4 AS DOUBLE) / CAST(amount * packs AS DOUBLE) AS v FROM w),
s AS (SELECT *, CAST({fixed_text_sql('v')} AS DOUBLE) AS shown FROM v),
b AS (SELECT *, CASE WHEN shown > 0 THEN shown / CASE WHEN unit IN ('L', 'kg') THEN 1000 ELSE 1 END END AS bv, CASE WHEN shown > 0 THEN u1 END AS bu FROM s),
placed AS (SELECT *, row_number() OVER (PARTITION BY article_id, bu ORDER BY bv, price, orig_idx) AS place FROM b),
gs AS (SELECT article_id, bu, count(*) AS n, list(review_count ORDER BY place) AS reviews, min(CASE WHEN place = 1 THEN price END) AS p1, min(orig_idx) AS f1 FROM placed GROUP BY ALL),
go AS (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY bu IS NULL, n DESC, reviews DESC, p1, f1) AS g FROM gs),
rk AS (SELECT p.*, row_number() OVER (PARTITION BY p.article_id ORDER BY g, place) AS new_rank FROM placed p JOIN go o ON p.article_id = o.article_id AND p.bu IS NOT DISTINCT FROM o.bu)
SELECT article_id, orig_idx, new_rank AS rank, price + 4 AS price, concat('約', {fixed_text_sql('v')}, '円/', unit) AS price_per_unit FROM rk WHERE new_rank <= 10""")
def price_refresh(spark: SparkSession, sf: str) -> DataFrame:
    titles = fx.products(spark, sf).select("article_id", F.concat(F.lit("T 10選 "), "article_id").alias("title")).distinct()
    out = P.refresh_articles(decided(spark, sf), titles)
    return out["products"].select("article_id", "orig_idx", "rank", "price", "price_per_unit")


@query("run_stats", fx.with_ctes("products", more=FOUND_HITS) + """,
f AS (SELECT orig_idx, min(CASE WHEN NOT donated THEN pos END) AS pos, arg_min(hit_price, pos) FILTER (WHERE NOT donated) AS hp FROM hits GROUP BY 1)
SELECT count(*) AS products, count(*) FILTER (WHERE pos IS NOT NULL AND hp <> price) AS changed, count(*) FILTER (WHERE pos IS NOT NULL AND hp = price) AS unchanged,
  count(*) FILTER (WHERE pos IS NULL) AS failed, 0 AS deleted, count(*) FILTER (WHERE p.orig_idx % 10 = 0) AS capacity_changed FROM products p LEFT JOIN f ON f.orig_idx = p.orig_idx""")
def run_stats(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.matching import first_hits

    found = first_hits(fx.products(spark, sf), found_hits(spark, sf), "orig_idx")
    changes = found.select(
        F.when(F.col("hit").isNull(), "failed").when(F.col("hit.price") != F.col("price"), "changed")
        .otherwise("unchanged").alias("outcome"), (F.col("orig_idx") % 10 == 0).alias("capacity_changed"))
    return P.run_stats(changes)


