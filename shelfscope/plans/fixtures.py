"""Catalogue tables derived from the driver tables, in Spark and in oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.patterns import BASE_PROVIDER
from ..session import prepare

UNIT_OF = "CASE p_partkey % 5 WHEN 0 THEN 'mL' WHEN 1 THEN 'L' WHEN 2 THEN 'g' WHEN 3 THEN 'kg' ELSE '枚' END"
PROVIDER_OF = "CASE l_suppkey % 3 WHEN 0 THEN 'rakuten' WHEN 1 THEN 'yahoo' ELSE 'amazon' END"

_PRODUCTS = f"""
SELECT p_brand AS article_id, p_type AS category_id, p_partkey AS orig_idx, p_name AS name,
  p_brand AS brand, CAST(floor(p_retailprice) AS BIGINT) AS price,
  {UNIT_OF} AS unit, CAST(p_size AS BIGINT) AS amount, 1 + p_partkey % 4 AS packs,
  concat(CAST(p_size AS STRING), {UNIT_OF}, '×', CAST(1 + p_partkey % 4 AS STRING), '個') AS capacity,
  CASE WHEN p_partkey % 13 <> 0 THEN CAST(p_partkey % 51 AS DOUBLE) / 10 END AS rating,
  p_partkey % 1200 AS review_count,
  concat('https://item.rakuten.co.jp/shop', CAST(p_partkey % 7 AS STRING), '/item', CAST(p_partkey AS STRING), '/') AS base_url
FROM part
"""

_OFFERS = f"""
SELECT l_partkey AS orig_idx, {PROVIDER_OF} AS provider,
  CASE WHEN l_linenumber = 7 THEN 0 ELSE CAST(floor(l_extendedprice / l_quantity) AS BIGINT) END AS price,
  CASE l_returnflag WHEN 'A' THEN 'matched' WHEN 'R' THEN 'rejected' END AS match_status,
  l_linestatus = 'F' AS available, l_shipdate AS updated_at,
  l_orderkey * 10 + l_linenumber AS pos,
  concat('https://shop.example.com/', CAST(l_orderkey AS STRING), '/', CAST(l_suppkey AS STRING), '.html') AS url
FROM lineitem
"""

_ARTICLES = """
SELECT concat('doc-', CAST(doc_id AS STRING)) AS article_id, doc_id,
  CASE WHEN doc_id % 6 = 0 THEN 'review' WHEN doc_id % 6 < 4 THEN 'comparison' END AS article_type,
  concat('Guide ', CAST(doc_id AS STRING), ' 10選') AS title,
  concat('n', CAST(doc_id % 29 AS STRING)) AS category_id,
  doc_id % 11 = 0 AS draft, lang, source, n_chars,
  {date} AS published_at, {updated} AS updated_at
FROM documents
"""

_CATEGORIES = """
SELECT concat('n', CAST(n_nationkey AS STRING)) AS category_id, n_name AS name,
  lower(n_name) AS slug, (n_nationkey * 7) % 25 AS sort_order
FROM nation
"""


def _duck(sql: str) -> str:
    return sql.replace("AS STRING)", "AS VARCHAR)")


ARTICLE_DAY = ("date_add(DATE'2020-01-01', CAST(doc_id * 37 % 1500 AS INT))",
               "CASE WHEN doc_id % 4 = 1 THEN date_add(DATE'2021-01-01', CAST(doc_id % 900 AS INT)) END")
ARTICLE_DAY_DUCK = ("(DATE '2020-01-01' + CAST(doc_id * 37 % 1500 AS INTEGER))",
                    "CASE WHEN doc_id % 4 = 1 THEN (DATE '2021-01-01' + CAST(doc_id % 900 AS INTEGER)) END")

CTE = {
    "products": _duck(_PRODUCTS),
    "offers": _duck(_OFFERS),
    "articles": _duck(_ARTICLES.format(date=ARTICLE_DAY_DUCK[0], updated=ARTICLE_DAY_DUCK[1])),
    "categories": _duck(_CATEGORIES),
}


def with_ctes(*names: str, more: str = "") -> str:
    """``WITH`` clause of the derived tables for an oracle statement."""
    parts = [f"{n} AS ({CTE[n]})" for n in names]
    if more:
        parts.append(more)
    return "WITH " + ", ".join(parts) + "\n"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Spread a scan with fewer splits than cores; text parsing costs far more than the move.

    A large input has splits enough and is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _derive(spark: SparkSession, sf_dir: str, source: str, sql: str) -> DataFrame:
    df = table(spark, sf_dir, source)
    if source in ("part", "documents"):
        df = spread(df)
    return spark.sql(sql.replace(f"FROM {source}", "FROM {src}"), src=df)


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derive(spark, sf_dir, "part", _PRODUCTS)


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derive(spark, sf_dir, "lineitem", _OFFERS)


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derive(spark, sf_dir, "documents",
                   _ARTICLES.format(date=ARTICLE_DAY[0], updated=ARTICLE_DAY[1]))


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derive(spark, sf_dir, "nation", _CATEGORIES)


def ranked_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.numbering import row_numbers

    return row_numbers(products(spark, sf_dir), ["article_id"], [F.col("orig_idx")], "rank")


RANKED = ("ranked AS (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY orig_idx) AS rank"
          " FROM products)")

__all__ = ["BASE_PROVIDER", "CTE", "RANKED", "articles", "categories", "offers", "products",
           "ranked_products", "table", "with_ctes"]
