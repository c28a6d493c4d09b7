"""Queries over pack sizes, unit prices and rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import capacity as C
from ..operators import ranking as R
from ..session import checked_broadcast
from . import fixtures as fx
from .registry import query

# oracle: the pack-size total from the numbers the text was composed of
NUMBERS = """
sized AS (SELECT *, CAST(amount * packs AS DOUBLE) AS total,
  CASE unit WHEN 'L' THEN 'mL' WHEN 'kg' THEN 'g' ELSE unit END AS norm_unit,
  CAST(amount * packs AS DOUBLE) * CASE WHEN unit IN ('L', 'kg') THEN 1000 ELSE 1 END AS norm_total
  FROM products)"""


def fixed_text_sql(v: str) -> str:
    """Oracle text of a unit price: nearest digit of the binary value, ties up."""
    one = f"((CAST({v} * 4503599627370496.0 AS HUGEINT) * 20 + 4503599627370496) // 9007199254740992)"
    two = f"((CAST({v} * 4611686018427387904.0 AS HUGEINT) * 200 + 4611686018427387904) // 9223372036854775808)"
    return (f"CASE WHEN {v} >= 10 THEN CAST(CAST(floor({v} + 0.5) AS BIGINT) AS VARCHAR) "
            f"WHEN {v} >= 1 THEN concat(CAST({one} // 10 AS VARCHAR), '.', CAST({one} % 10 AS VARCHAR)) "
            f"ELSE concat(CAST({two} // 100 AS VARCHAR), '.', lpad(CAST({two} % 100 AS VARCHAR), 2, '0')) END")


def sized(spark: SparkSession, sf: str) -> DataFrame:
    return C.with_total(fx.products(spark, sf), "capacity", "size")


@query("capacity_total", fx.with_ctes("products", more=NUMBERS) + """
SELECT orig_idx, capacity, total, unit FROM sized""")
def capacity_total(spark: SparkSession, sf: str) -> DataFrame:
    return sized(spark, sf).select("orig_idx", "capacity", "size.total", "size.unit")


@query("capacity_normalize", fx.with_ctes("products", more=NUMBERS) + """
SELECT orig_idx, norm_total AS total, norm_unit AS unit FROM sized""")
def capacity_normalize(spark: SparkSession, sf: str) -> DataFrame:
    return (sized(spark, sf).withColumn("norm", C.normalized(F.col("size")))
            .select("orig_idx", "norm.total", "norm.unit"))


# policy table: the target unit per category
POLICY_SQL = """
policy AS (SELECT * FROM (VALUES ('ECONOMY', 'mL'), ('SMALL', 'g'), ('STANDARD', '組')) AS t(category_id, target_unit))"""
PRICED_SQL = NUMBERS + "," + POLICY_SQL + """,
targeted AS (SELECT s.*, CASE WHEN target_unit = norm_unit THEN norm_total
    WHEN target_unit = '組' AND unit = '枚' THEN total / 2 ELSE total END AS t_total,
  CASE WHEN target_unit = norm_unit THEN norm_unit
    WHEN target_unit = '組' AND unit = '枚' THEN '組' ELSE unit END AS t_unit
  FROM sized s LEFT JOIN policy USING (category_id)),
priced AS (SELECT *, CAST(price AS DOUBLE) / t_total AS unit_value FROM targeted),
labelled AS (SELECT *, concat('約', """ + fixed_text_sql("unit_value") + """, '円/', t_unit) AS label FROM priced)"""


def policy(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [("ECONOMY", "mL"), ("SMALL", "g"), ("STANDARD", "組")], "category_id string, target_unit string")


def priced(spark: SparkSession, sf: str) -> DataFrame:
    """Products with the unit price in the unit of their category's policy."""
    df = sized(spark, sf).join(checked_broadcast(policy(spark)), "category_id", "left")
    return C.with_unit_price(df, "price", "size", "ppu", F.col("target_unit"))


@query("unit_price", fx.with_ctes("products", more=PRICED_SQL) + """
SELECT orig_idx, unit_value, t_unit AS unit, label FROM labelled""")
def unit_price(spark: SparkSession, sf: str) -> DataFrame:
    return priced(spark, sf).select(
        "orig_idx", F.col("ppu.value").alias("unit_value"), "ppu.unit", "ppu.label")


@query("unit_price_parse", fx.with_ctes("products", more=PRICED_SQL) + """,
shown AS (SELECT *, CAST(""" + fixed_text_sql("unit_value") + """ AS DOUBLE) AS shown FROM labelled)
SELECT orig_idx, CASE WHEN shown > 0 THEN shown END AS sort_value,
  CASE WHEN shown > 0 THEN shown / CASE t_unit WHEN 'L' THEN 1000 WHEN 'kg' THEN 1000 WHEN '組' THEN 2 ELSE 1 END END AS rank_value,
  CASE WHEN shown > 0 THEN CASE t_unit WHEN 'L' THEN 'mL' WHEN 'kg' THEN 'g' WHEN '組' THEN '枚' ELSE t_unit END END AS rank_unit
FROM shown""")
def unit_price_parse(spark: SparkSession, sf: str) -> DataFrame:
    label = F.col("ppu.label")
    return priced(spark, sf).withColumn("parsed", R.parsed_unit_price(label)).select(
        "orig_idx", R.display_sort_value(F.col("price"), label).alias("sort_value"),
        F.col("parsed.value").alias("rank_value"), F.col("parsed.unit").alias("rank_unit"))


@query("unit_price_visible", fx.with_ctes("products", more=PRICED_SQL) + """
SELECT orig_idx, CASE WHEN orig_idx % 9 = 0 THEN false WHEN orig_idx % 10 = 1 THEN false
  ELSE CAST(""" + fixed_text_sql("unit_value") + """ AS DOUBLE) > 0 END AS visible FROM labelled""")
def unit_price_visible(spark: SparkSession, sf: str) -> DataFrame:
    price = F.when(F.col("orig_idx") % 9 == 0, 0).otherwise(F.col("price"))
    label = F.when(F.col("orig_idx") % 10 == 1, "-").otherwise(F.col("ppu.label"))
    return priced(spark, sf).select("orig_idx", R.shows_unit_price(price, label).alias("visible"))


@query("known_price", fx.with_ctes("products") + """
SELECT orig_idx, p > 0 AS known,
  CASE WHEN p > 0 THEN concat('¥', format('{:,}', p)) ELSE '価格確認' END AS label
FROM (SELECT orig_idx, CASE WHEN orig_idx % 9 = 0 THEN 0 ELSE price * 7 END AS p FROM products)""")
def known_price(spark: SparkSession, sf: str) -> DataFrame:
    p = F.when(F.col("orig_idx") % 9 == 0, 0).otherwise(F.col("price") * 7)
    return fx.products(spark, sf).select(
        "orig_idx", (p > 0).alias("known"),
        F.when(p > 0, F.concat(F.lit("¥"), F.format_number(p, 0))).otherwise("価格確認").alias("label"))


# -- ranking -----------------------------------------------------------------

RANKED_SQL = PRICED_SQL + """,
base AS (SELECT *, unit_value / CASE t_unit WHEN 'L' THEN 1000 WHEN 'kg' THEN 1000 WHEN '組' THEN 2 ELSE 1 END AS v,
    CASE t_unit WHEN 'L' THEN 'mL' WHEN 'kg' THEN 'g' WHEN '組' THEN '枚' ELSE t_unit END AS u
  FROM priced WHERE orig_idx % 17 <> 0
  UNION ALL SELECT *, NULL, NULL FROM priced WHERE orig_idx % 17 = 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY article_id, u ORDER BY v, price, orig_idx) AS place FROM base),
unit_groups AS (SELECT article_id, u, count(*) AS n, list(review_count ORDER BY place) AS reviews,
    min(CASE WHEN place = 1 THEN price END) AS p1, min(orig_idx) AS f1 FROM placed GROUP BY ALL),
group_order AS (SELECT *, row_number() OVER (PARTITION BY article_id
    ORDER BY u IS NULL, n DESC, reviews DESC, p1, f1) AS g FROM unit_groups),
unit_ranked AS (SELECT placed.*, row_number() OVER (PARTITION BY placed.article_id ORDER BY g, place) AS new_rank
  FROM placed JOIN group_order o ON placed.article_id = o.article_id AND placed.u IS NOT DISTINCT FROM o.u)"""


def unit_ranked(spark: SparkSession, sf: str) -> DataFrame:
    known = F.col("orig_idx") % 17 != 0
    base = priced(spark, sf).withColumn(
        "base", F.when(known, R.base_unit_price(F.col("ppu.value"), F.col("ppu.unit"))))
    return R.rank_by_unit_price(base.select(
        "article_id", "orig_idx", "name", "price", "review_count",
        F.col("base.value").alias("unit_value"), F.col("base.unit").alias("unit")))


@query("rank_by_unit_price", fx.with_ctes("products", more=RANKED_SQL) + """
SELECT article_id, orig_idx, v AS unit_value, u AS unit, new_rank FROM unit_ranked""")
def rank_by_unit_price(spark: SparkSession, sf: str) -> DataFrame:
    return unit_ranked(spark, sf).select("article_id", "orig_idx", "unit_value", "unit", "new_rank")


@query("limit_rank", fx.with_ctes("products", more=fx.RANKED) + """
SELECT article_id, orig_idx, rank, CASE WHEN rank <= 10 THEN
  row_number() OVER (PARTITION BY article_id, rank <= 10 ORDER BY orig_idx) END AS new_rank
FROM (SELECT * REPLACE ((orig_idx * 31) % 40 AS rank) FROM ranked)""")
def limit_rank(spark: SparkSession, sf: str) -> DataFrame:
    df = fx.products(spark, sf).withColumn("rank", F.col("orig_idx") * 31 % 40)
    kept, removed = R.limit_rank(df.select("article_id", "orig_idx", "rank"))
    return kept.unionByName(removed.withColumn("new_rank", F.lit(None).cast("int")))


@query("remove_renumber", fx.with_ctes("products", more="""
hit AS (SELECT article_id, min(orig_idx) AS orig_idx FROM products
  WHERE name IN ('red widget', 'hot gear') GROUP BY article_id, name),
counts AS (SELECT article_id, count(*) AS n FROM products GROUP BY article_id),
doomed AS (SELECT article_id, count(*) AS gone, max(orig_idx) AS last FROM hit GROUP BY article_id),
drops AS (SELECT h.* FROM hit h JOIN counts c USING (article_id) JOIN doomed d USING (article_id)
  WHERE NOT (d.gone >= c.n AND h.orig_idx = d.last))""") + """
SELECT article_id, orig_idx, name, row_number() OVER (PARTITION BY article_id ORDER BY orig_idx) AS new_rank
FROM products p WHERE NOT EXISTS (SELECT 1 FROM drops d WHERE d.article_id = p.article_id AND d.orig_idx = p.orig_idx)""")
def remove_renumber(spark: SparkSession, sf: str) -> DataFrame:
    df = fx.products(spark, sf).select("article_id", "orig_idx", "name")
    removals = df.filter(F.col("name").isin("red widget", "hot gear")).select("article_id", "name")
    return R.remove_and_renumber(df, removals)


@query("price_ranking", fx.with_ctes("products", more=RANKED_SQL) + """
SELECT article_id, new_rank, orig_idx, v AS unit_value, u AS unit FROM unit_ranked WHERE new_rank <= 10""")
def price_ranking(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: parse sizes, price per unit, rank, keep ten per article."""
    return unit_ranked(spark, sf).filter("new_rank <= 10").select(
        "article_id", "new_rank", "orig_idx", "unit_value", "unit")
