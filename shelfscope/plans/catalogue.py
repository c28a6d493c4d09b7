"""Queries over articles, categories and site search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import catalogue as K
from ..operators.numbering import first_per
from ..operators.phrases import gram_index, write_index
from ..session import cut_lineage, scratch_path
from . import fixtures as fx
from .registry import query

# products placed in document articles: three per article
SHELF = """shelf AS (SELECT * REPLACE (concat('doc-', CAST(orig_idx // 3 AS VARCHAR)) AS article_id) FROM products)"""


def shelf(spark: SparkSession, sf: str) -> DataFrame:
    doc = F.concat(F.lit("doc-"), F.floor(F.col("orig_idx") / 3).cast("string"))
    return fx.products(spark, sf).withColumn("article_id", doc)


@query("list_articles", fx.with_ctes("products", "offers", "articles", more=SHELF) + """,
counts AS (SELECT article_id, count(*) AS n, bool_or(orig_idx IN (SELECT orig_idx FROM offers WHERE provider = 'yahoo')) AS h FROM shelf GROUP BY 1)
SELECT a.article_id, title, category_id, coalesce(article_type, 'comparison') AS article_type,
  coalesce(n, 0) AS product_count, coalesce(h, false) AS has_offer
FROM articles a LEFT JOIN counts USING (article_id)
WHERE coalesce(article_type, 'comparison') = 'comparison' AND coalesce(n, 0) < 3""")
def list_articles(spark: SparkSession, sf: str) -> DataFrame:
    rows = K.list_articles(fx.articles(spark, sf), shelf(spark, sf), fx.offers(spark, sf),
                           article_kind="comparison", product_count_lt=3, provider="yahoo")
    return rows.select("article_id", "title", "category_id", "article_type", "product_count", "has_offer")


SUMMARY = """,
marks AS (SELECT orig_idx, count(*) AS n, bool_or(coalesce(match_status IN ('review', 'pending'), false)) AS r
  FROM (SELECT * REPLACE (CASE WHEN pos % 50 = 0 THEN 'pending' ELSE match_status END AS match_status) FROM offers) GROUP BY 1),
summary AS (SELECT s.article_id, s.orig_idx, s.name, CASE WHEN s.orig_idx % 5 = 0 THEN row_number() OVER (PARTITION BY article_id ORDER BY s.orig_idx) ELSE s.orig_idx % 3 + 1 END AS rank,
  coalesce(n, 0) AS offer_count, coalesce(r, false) AS needs_review FROM shelf s LEFT JOIN marks m ON m.orig_idx = s.orig_idx)
"""


def summary(spark: SparkSession, sf: str) -> DataFrame:
    products = shelf(spark, sf).withColumn(
        "rank", F.when(F.col("orig_idx") % 5 != 0, F.col("orig_idx") % 3 + 1))
    offers = fx.offers(spark, sf).withColumn(
        "match_status", F.when(F.col("pos") % 50 == 0, "pending").otherwise(F.col("match_status")))
    return K.product_summary(products, offers)


@query("product_summary", fx.with_ctes("products", "offers", more=SHELF) + SUMMARY + "SELECT * FROM summary")
def product_summary(spark: SparkSession, sf: str) -> DataFrame:
    return summary(spark, sf).select("article_id", "orig_idx", "name", "rank", "offer_count", "needs_review")


@query("product_lookup", fx.with_ctes("products", "offers", more=SHELF) + SUMMARY + """
SELECT article_id, orig_idx, name, rank, offer_count, needs_review FROM summary
WHERE article_id = 'doc-7' AND rank = 2 ORDER BY orig_idx LIMIT 1""")
def product_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return K.product_lookup(summary(spark, sf), "doc-7", rank=2, name="ignored").select(
        "article_id", "orig_idx", "name", "rank", "offer_count", "needs_review")


@query("file_filter", fx.with_ctes("articles") + """
SELECT concat('articles/', article_id, '.md') AS file FROM articles WHERE article_id LIKE 'doc-_7'""")
def file_filter(spark: SparkSession, sf: str) -> DataFrame:
    files = fx.articles(spark, sf).select(
        F.concat(F.lit("articles/"), "article_id", F.lit(".md")).alias("file"))
    return K.file_filter(files, "file", "doc-?7.md")


@query("article_feed", fx.with_ctes("articles") + """
SELECT title, CAST(published_at AS VARCHAR) AS published_at, concat('https://site.example/articles/', article_id, '/') AS link FROM articles WHERE NOT draft""")
def article_feed(spark: SparkSession, sf: str) -> DataFrame:
    feed = K.article_feed(fx.articles(spark, sf), "https://site.example")
    return feed.withColumn("published_at", F.col("published_at").cast("string"))


@query("article_category", fx.with_ctes("articles", "categories") + """
SELECT article_id, a.category_id, coalesce(name, a.category_id) AS category_name FROM articles a LEFT JOIN categories c ON a.category_id = c.category_id""")
def article_category(spark: SparkSession, sf: str) -> DataFrame:
    return K.article_category(fx.articles(spark, sf), fx.categories(spark, sf)).select(
        "article_id", "category_id", "category_name")


@query("category_articles", fx.with_ctes("articles", "categories") + """,
rows AS (SELECT category_id, CASE WHEN article_type = 'review' THEN 'review' ELSE 'comparison' END AS kind, article_id, published_at FROM articles WHERE NOT draft)
SELECT c.category_id, c.name, kind, article_id, CAST(published_at AS VARCHAR) AS published_at,
  CASE WHEN article_id IS NOT NULL THEN row_number() OVER (PARTITION BY c.category_id, kind ORDER BY published_at DESC, article_id) END AS place
FROM categories c LEFT JOIN rows USING (category_id)""")
def category_articles(spark: SparkSession, sf: str) -> DataFrame:
    rows = K.category_articles(fx.articles(spark, sf), fx.categories(spark, sf))
    return rows.withColumn("published_at", F.col("published_at").cast("string"))


@query("popular_articles", fx.with_ctes("articles") + """
SELECT pos, article_id, title FROM articles JOIN (SELECT quality + 2 * doc_id AS pos, concat('doc-', CAST(doc_id AS VARCHAR)) AS article_id FROM labels) USING (article_id)
WHERE NOT draft ORDER BY pos LIMIT 6""")
def popular_articles(spark: SparkSession, sf: str) -> DataFrame:
    ids = fx.table(spark, sf, "labels").select(
        (F.col("quality") + 2 * F.col("doc_id")).alias("pos"),
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("article_id"))
    return K.popular_articles(fx.articles(spark, sf), ids).select("pos", "article_id", "title")


@query("newest_articles", fx.with_ctes("articles") + """
SELECT article_id, CAST(coalesce(updated_at, published_at) AS VARCHAR) AS shown_at FROM articles WHERE NOT draft
ORDER BY coalesce(updated_at, published_at) DESC, article_id LIMIT 6""")
def newest_articles(spark: SparkSession, sf: str) -> DataFrame:
    return K.newest_articles(fx.articles(spark, sf), 6, by_update=True).select(
        "article_id", F.coalesce("updated_at", "published_at").cast("string").alias("shown_at"))


@query("category_order", fx.with_ctes("categories") + """
SELECT category_id, name, sort_order FROM categories ORDER BY sort_order, category_id LIMIT 18""")
def category_order(spark: SparkSession, sf: str) -> DataFrame:
    return K.categories_in_order(fx.categories(spark, sf)).select("category_id", "name", "sort_order")


@query("dedupe_first", fx.with_ctes("products") + """
SELECT article_id, name, min(orig_idx) AS orig_idx, arg_min(price, orig_idx) AS price FROM products GROUP BY article_id, name""")
def dedupe_first(spark: SparkSession, sf: str) -> DataFrame:
    return first_per(fx.products(spark, sf).select("article_id", "name", "orig_idx", "price"),
                     ["article_id", "name"], [F.col("orig_idx")])


TAGGED = """tagged AS (SELECT article_id, published_at, concat('c', CAST(doc_id // 3 AS VARCHAR)) AS category_id,
  list_distinct([lang, concat('s', CAST(doc_id % 5 AS VARCHAR)), concat('k', CAST(n_chars % 4 AS VARCHAR)), concat('m', CAST(doc_id % 7 AS VARCHAR))]) AS tags
  FROM articles WHERE NOT draft)"""


@query("related_articles", fx.with_ctes("articles", more=TAGGED) + """,
pairs AS (SELECT a.article_id AS of, b.article_id AS related_id, b.published_at,
  CASE WHEN a.category_id = b.category_id THEN 1 WHEN len(list_intersect(a.tags, b.tags)) > 0 THEN 2 ELSE 3 END AS tier,
  CASE WHEN a.category_id = b.category_id THEN 0 ELSE len(list_intersect(a.tags, b.tags)) END AS overlap
  FROM tagged a JOIN tagged b ON a.article_id <> b.article_id)
SELECT * FROM (SELECT of AS article_id, related_id, row_number() OVER (PARTITION BY of ORDER BY tier, overlap DESC, published_at DESC, related_id) AS place FROM pairs) WHERE place <= 3""")
def related_articles(spark: SparkSession, sf: str) -> DataFrame:
    def mark(letter: str, value: F.Column) -> F.Column:
        return F.concat(F.lit(letter), value.cast("string"))

    tagged = fx.articles(spark, sf).withColumns({
        "category_id": mark("c", F.floor(F.col("doc_id") / 3)),
        "tags": F.array(F.col("lang"), mark("s", F.col("doc_id") % 5),
                        mark("k", F.col("n_chars") % 4), mark("m", F.col("doc_id") % 7)),
    })
    return K.related_articles(tagged)


# beside the shelf, one article lists every order as a product; brands are often missing or empty
WIDE = SHELF + """, wide AS (SELECT article_id, orig_idx, name, brand FROM shelf
  UNION ALL SELECT 'doc-1', 1000000000 + o_orderkey, concat(o_orderpriority, ' ', o_orderstatus),
    CASE o_orderstatus WHEN 'P' THEN concat('By ', CAST(o_custkey AS VARCHAR)) WHEN 'F' THEN '' END FROM orders)"""

HEADS = """heads AS (SELECT a.*, coalesce(c.name, a.category_id) AS category_name FROM articles a LEFT JOIN categories c USING (category_id))"""

FOUND = f"""{HEADS},
found AS (SELECT s.article_id, s.orig_idx, concat_ws(' ', s.name, s.brand, capacity, category_name, lang, concat('for ', source)) AS keywords FROM shelf s JOIN heads USING (article_id))"""

ENTRIES = f"""{HEADS},
entries AS (SELECT article_id, '1 title' AS field, 0 AS place, title AS text FROM heads UNION ALL SELECT article_id, '2 description', 1, source FROM heads
  UNION ALL SELECT article_id, '3 category', 2, category_name FROM heads UNION ALL SELECT article_id, '4 tag', 3, lang FROM heads
  UNION ALL SELECT article_id, '5 name', orig_idx, name FROM wide UNION ALL SELECT article_id, '6 brand', orig_idx, brand FROM wide),
held AS (SELECT * FROM entries SEMI JOIN articles USING (article_id) WHERE text <> ''),
placed AS (SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY article_id ORDER BY field, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM held),
whole AS (SELECT article_id, lower(string_agg(text, ' ' ORDER BY field, place)) AS keywords FROM held GROUP BY 1)"""


def _searchable(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    articles = fx.articles(spark, sf).withColumns({
        "description": F.col("source"), "tags": F.array("lang")})
    return articles, shelf(spark, sf), fx.categories(spark, sf)


def _entries(spark: SparkSession, sf: str) -> DataFrame:
    """Placed search entries; one article holds a product for every order."""
    articles, products, categories = _searchable(spark, sf)
    status = F.col("o_orderstatus")
    ordered = fx.table(spark, sf, "orders").select(
        F.lit("doc-1").alias("article_id"), (F.lit(1_000_000_000) + F.col("o_orderkey")).alias("orig_idx"),
        F.concat("o_orderpriority", F.lit(" "), status).alias("name"),
        F.when(status == "P", F.concat(F.lit("By "), F.col("o_custkey").cast("string"))).when(status == "F", "").alias("brand"))
    wide = products.select("article_id", "orig_idx", "name", "brand").unionByName(ordered)
    return cut_lineage(K.placed_entries(K.search_entries(articles, wide, categories)))


def _product_rows(spark: SparkSession, sf: str) -> DataFrame:
    articles, products, categories = _searchable(spark, sf)
    more = articles.select("article_id", F.col("tags").alias("features"),
                           F.concat(F.lit("for "), "source").alias("recommended_for"))
    featured = products.join(more, "article_id").withColumn("price_per_unit", F.lit(None).cast("string"))
    return K.search_products(featured, articles, categories)


@query("search_index", fx.with_ctes("articles", "categories", "products", more=WIDE) + f""",
{ENTRIES}
SELECT article_id, field, place, text, start AS "at" FROM placed""")
def search_index(spark: SparkSession, sf: str) -> DataFrame:
    """The search table: each article's text entry by entry, with the place of each in the whole."""
    placed = _entries(spark, sf)
    lead = F.length("piece") - F.length(F.lower("text"))
    return placed.select("article_id", "field", "place", "text", (F.col("at") + lead).alias("at"))


# over the border of two entries, short, long, and in no text; none can overlap itself
PHRASES = ["LOW o 2-high F", " ED Wid ", "ur", "x", "2-HIGH F 2-HIGH F 2-HIGH O 3-MEDIUM", "not there"]


@query("phrase_search", fx.with_ctes("articles", "categories", "products", more=WIDE) + f""",
{ENTRIES},
phrases AS (SELECT lower(trim(unnest({PHRASES}))) AS phrase),
hit AS (SELECT phrase, article_id, strpos(keywords, phrase) - 1 AS hit_at,
  (length(keywords) - length(replace(keywords, phrase, ''))) // length(phrase) AS hits FROM whole, phrases WHERE contains(keywords, phrase))
SELECT phrase, article_id, hits, hit_at, field, place, text FROM hit JOIN placed USING (article_id)
WHERE hit_at >= greatest(start - 1, 0) AND hit_at < start + length(text)""")
def phrase_search(spark: SparkSession, sf: str) -> DataFrame:
    placed = _entries(spark, sf)
    index = write_index(gram_index(placed, "article_id"), scratch_path(spark, "grams"))
    found = [K.article_hits(placed, index, p).withColumn("phrase", F.lit(p.strip().lower())) for p in PHRASES]
    return reduce(DataFrame.unionByName, found).select("phrase", "article_id", "hits", "hit_at", "field", "place", "text")


@query("product_hits", fx.with_ctes("products", "articles", "categories", more=SHELF) + f""",
{FOUND}
SELECT * FROM found WHERE contains(lower(keywords), 'ed wid')""")
def product_hits(spark: SparkSession, sf: str) -> DataFrame:
    return K.matching(_product_rows(spark, sf), " ED Wid ").select("article_id", "orig_idx", "keywords")


@query("product_search", fx.with_ctes("products", "articles", "categories", more=SHELF) + f""",
{FOUND}
SELECT article_id, orig_idx, keywords FROM found WHERE contains(lower(keywords), 'for src1')
ORDER BY article_id, orig_idx LIMIT 30""")
def product_search(spark: SparkSession, sf: str) -> DataFrame:
    return K.product_hits(_product_rows(spark, sf), "For src1").select("article_id", "orig_idx", "keywords")
