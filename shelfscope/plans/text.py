"""Queries over item names, keywords, links, prose and questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import capacity as C
from ..functions import names as N
from ..functions import text as T
from ..functions import urls as U
from ..functions.arrow import nfkc, nfkc_lower, with_nfkc_lower
from ..operators import quality as Q
from . import fixtures as fx
from .catalogue import SHELF, shelf
from .registry import query

# Item names are composed from numbers in ten notations.
_NAMED = """
SELECT *, CASE form
  WHEN 0 THEN concat(name, ' ', a, unit, '×', k, '個')
  WHEN 1 THEN concat(name, ' ', a, unit)
  WHEN 2 THEN concat('【', k, '個】', name, ' ', a, unit)
  WHEN 3 THEN concat(name, ' ', a, unit, '（', ak, '枚）')
  WHEN 4 THEN concat(name, ' ', a, 'mL ', k1, '個セット')
  WHEN 5 THEN concat(name, ' ', a, 'm ', k1, 'ロール ダブル')
  WHEN 6 THEN concat(name, ' ', k1, 'ロール×', a, 'パック')
  WHEN 7 THEN concat(name, ' 30cm×', a, 'm(', k1, '本)')
  WHEN 8 THEN name
  ELSE concat(name, ' ', a, '枚（', ak, '枚：', a, '枚×', k, 'パック）') END AS item_name
FROM (SELECT *, (orig_idx div 5) % 10 AS form, CAST(amount AS STRING) AS a, CAST(packs AS STRING) AS k,
  CAST(packs + 1 AS STRING) AS k1, CAST(amount * packs AS STRING) AS ak FROM products)
"""
NAMED_SQL = "named AS (" + _NAMED.replace(" div ", " // ").replace("AS STRING)", "AS VARCHAR)") + """),
read AS (SELECT *, CASE form WHEN 0 THEN concat(a, unit, '×', k, '個') WHEN 1 THEN concat(a, unit)
    WHEN 2 THEN concat(a, unit, '×', k, '個') WHEN 3 THEN concat('（', ak, '枚）') WHEN 4 THEN concat(a, 'mL×', k1, '個')
    WHEN 5 THEN concat(a, 'm×', k1, 'ロール') WHEN 6 THEN concat(k1, 'ロール×', a, 'パック') WHEN 7 THEN concat(a, 'm×', k1, '個')
    WHEN 9 THEN concat('（', ak, '枚）') END AS found,
  CASE WHEN form IN (0, 2, 3, 9) THEN amount * packs WHEN form = 1 THEN amount WHEN form <> 8 THEN amount * (packs + 1) END AS found_amount,
  CASE WHEN form IN (0, 1, 2) THEN unit WHEN form IN (3, 9) THEN '枚' WHEN form = 4 THEN 'mL' WHEN form IN (5, 7) THEN 'm' WHEN form = 6 THEN 'ロール' END AS found_unit
  FROM named)"""


def named(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(_NAMED.replace("FROM products", "FROM {p}"), p=fx.products(spark, sf))


READ = fx.with_ctes("products", more=NAMED_SQL)


@query("capacity_from_name", READ + "SELECT orig_idx, item_name, found FROM read")
def capacity_from_name(spark: SparkSession, sf: str) -> DataFrame:
    return N.with_name_capacity(named(spark, sf), "item_name", "found").select("orig_idx", "item_name", "found")


@query("capacity_analysis", READ + """
SELECT orig_idx, found, CAST(found_amount AS DOUBLE) * CASE WHEN found_unit IN ('L', 'kg') THEN 1000 ELSE 1 END AS total,
  CASE found_unit WHEN 'L' THEN 'mL' WHEN 'kg' THEN 'g' ELSE found_unit END AS unit,
  CASE WHEN form IN (4, 8) THEN 'low' WHEN form IN (0, 2) AND packs = 1 AND NOT (unit = '個') THEN 'low'
    WHEN form = 6 AND amount = 1 THEN 'low' ELSE 'high' END AS confidence,
  CASE WHEN form = 8 THEN 'API商品名からcapacityを抽出できない' WHEN form = 4 THEN '曖昧語を含む: セット'
    WHEN form IN (0, 2) AND packs = 1 THEN '複数のcapacity候補を含む' WHEN form = 6 AND amount = 1 THEN '複数のcapacity候補を含む'
    ELSE '単一のcapacity候補として解析可能' END AS reason
FROM read""")
def capacity_analysis(spark: SparkSession, sf: str) -> DataFrame:
    return N.with_capacity_analysis(named(spark, sf), "item_name").select(
        "orig_idx", "found", "found_norm.total", "found_norm.unit", "confidence",
        F.array_join("reasons", "|").alias("reason"))


@query("variant_flags", fx.with_ctes("products") + """
SELECT orig_idx, orig_idx % 3 = 0 AND packs <> 2 AS count_choice,
  orig_idx % 3 = 1 AND amount <> packs AS multi_measure FROM products""")
def variant_flags(spark: SparkSession, sf: str) -> DataFrame:
    k, a = F.col("packs").cast("string"), F.col("amount").cast("string")
    name = (
        F.when(F.col("orig_idx") % 3 == 0, F.concat("name", F.lit(" ("), k, F.lit("個,2個)")))
        .when(F.col("orig_idx") % 3 == 1, F.concat("name", F.lit(" "), k, F.lit("kg "), a, F.lit("000g")))
        .otherwise(F.concat("name", F.lit(" "), a, F.lit("枚×"), k, F.lit("箱"))))
    return fx.products(spark, sf).select(
        "orig_idx", C.is_count_choice(name).alias("count_choice"),
        C.is_multi_measure(name).alias("multi_measure"))


@query("capacity_kind", READ + """
SELECT orig_idx, coalesce(found_unit = '枚' AND form IN (1, 3, 9), false) OR (form IN (0, 2) AND unit = '枚') AS sales_quantity,
  coalesce(form IN (4) OR (form IN (0, 1, 2) AND unit <> '枚'), false) AS measured,
  coalesce(found_unit = '枚' AND form = 3 AND unit <> '枚', false) AS misread
FROM read""")
def capacity_kind(spark: SparkSession, sf: str) -> DataFrame:
    df = C.with_total(N.with_name_capacity(named(spark, sf), "item_name", "found"), "found", "total")
    found, total = F.col("found"), F.col("total")
    return df.select(
        "orig_idx", C.is_sales_quantity(found, total).alias("sales_quantity"),
        C.has_measure(found).alias("measured"),
        C.is_likely_misread(F.col("item_name"), found, total).alias("misread"))


@query("capacity_merge", fx.with_ctes("products") + """
SELECT orig_idx, CASE WHEN unit <> '枚' THEN concat(CAST(amount AS VARCHAR), unit, '×', CAST(packs + 2 AS VARCHAR), '個') END AS merged,
  unit <> '枚' AS same_base FROM products""")
def capacity_merge(spark: SparkSession, sf: str) -> DataFrame:
    df = fx.products(spark, sf).withColumn("extracted", F.concat((F.col("packs") + 2).cast("string"), F.lit("個")))
    df = C.with_total(df, "extracted", "total")
    piece = F.concat(F.col("amount").cast("string"), "unit")
    return df.select(
        "orig_idx", C.merged_quantity(F.col("capacity"), F.col("extracted"), F.col("total")).alias("merged"),
        C.same_measure_base(F.col("capacity"), piece).alias("same_base"))


@query("capacity_equal", fx.with_ctes("products") + """
SELECT orig_idx, CASE WHEN orig_idx % 2 = 0 THEN true ELSE false END AS same FROM products""")
def capacity_equal(spark: SparkSession, sf: str) -> DataFrame:
    # the same amount written in the base unit, one piece more on odd rows
    base = F.when(F.col("unit").isin("L", "kg"), F.col("amount") * F.col("packs") * 1000).otherwise(
        F.col("amount") * F.col("packs")) + F.col("orig_idx") % 2
    name = F.when(F.col("unit") == "L", "mL").when(F.col("unit") == "kg", "g").otherwise(F.col("unit"))
    df = fx.products(spark, sf).withColumn("other", F.concat(base.cast("string"), name))
    df = C.with_norm(C.with_norm(df, "capacity", "t1"), "other", "t2")
    return df.select("orig_idx", C.same_total(F.col("t1"), F.col("t2")).alias("same"))


@query("name_cleanup", READ + """
SELECT orig_idx, trim(CASE WHEN found IS NULL THEN item_name WHEN contains(item_name, found) THEN
  regexp_replace(replace(item_name, found, ''), '  +', ' ') ELSE item_name END) AS clean FROM read""")
def name_cleanup(spark: SparkSession, sf: str) -> DataFrame:
    df = N.with_name_capacity(named(spark, sf), "item_name", "found")
    return df.select("orig_idx", N.name_without_capacity(
        F.col("item_name"), F.col("found"), F.lit(None).cast("string")).alias("clean"))


@query("name_conflicts", READ + """
SELECT orig_idx, concat(name, ' ', CAST(amount + 5 AS VARCHAR), unit) AS fixed_name FROM read WHERE form = 1
UNION ALL SELECT orig_idx, concat(name, ' ', a, unit, CAST(amount + 5 AS VARCHAR), unit) FROM read
WHERE form = 3 AND unit = '枚' AND amount * packs <> amount + 5""")
def name_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    df = named(spark, sf).withColumn(
        "stored", F.concat((F.col("amount") + 5).cast("string"), F.col("unit")))
    df = N.with_name_capacity(df, "item_name", "found")
    df = C.with_total(C.with_total(df, "found", "inside"), "stored", "total")
    return df.withColumn("fixed_name", N.fixed_name(
        F.col("item_name"), F.col("found"), F.col("inside"), F.col("stored"), F.col("total"))
    ).filter("fixed_name IS NOT NULL").select("orig_idx", "fixed_name")


@query("dimension_match", fx.with_ctes("products") + """
SELECT orig_idx, orig_idx % 3 <> 1 AND packs = 1 AS same, CAST(amount AS DOUBLE) AS width FROM products""")
def dimension_match(spark: SparkSession, sf: str) -> DataFrame:
    a, b = F.col("amount").cast("string"), (F.col("amount") + 7).cast("string")
    other = F.when(F.col("orig_idx") % 3 == 1, (F.col("amount") + 8).cast("string")).otherwise(b)
    df = fx.products(spark, sf).select(
        "orig_idx",
        F.lower(F.concat(a, F.lit("×"), b, F.lit("cm 1枚"))).alias("stored"),
        F.concat("name", F.lit(" "), other, F.lit(" x "), a, F.lit("CM"),
                 F.when(F.col("packs") > 1, F.concat(F.lit(" "), F.col("packs").cast("string"), F.lit("枚")))
                 .otherwise("")).alias("candidate"),
        F.concat("name", F.lit(" "), a, F.lit("cm")).alias("wide"))
    sides = T.single_item_sides(F.col("stored"), True)
    return df.select(
        "orig_idx",
        F.coalesce(sides == T.single_item_sides(nfkc_lower(F.col("candidate")), False), F.lit(False)).alias("same"),
        T.width_cm(nfkc(F.col("wide"))).alias("width"))


# -- keywords and tokens -----------------------------------------------------

@query("search_keyword", fx.with_ctes("products") + """
SELECT orig_idx, CASE WHEN orig_idx % 4 = 0 THEN concat(name, ' case')
  WHEN orig_idx % 4 = 1 AND unit = 'kg' THEN concat(name, ' ', CAST(amount AS VARCHAR), 'kg×') ELSE name END AS keyword FROM products""")
def search_keyword(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("name")
    text = (
        F.when(F.col("orig_idx") % 4 == 0, F.concat(F.lit("【特価】"), n, F.lit(" 大容量 case A (本体)")))
        .when(F.col("orig_idx") % 4 == 1, F.concat(n, F.lit(" "), F.col("capacity")))
        .when(F.col("orig_idx") % 4 == 2, F.concat(n, F.lit(" × "), F.col("packs").cast("string")))
        .otherwise(F.concat(n, F.lit("　99.9%除去 [a b]"))))
    return fx.products(spark, sf).select("orig_idx", T.search_keyword(text).alias("keyword"))


@query("article_keyword", fx.with_ctes("products") + """
SELECT orig_idx, name AS keyword FROM products""")
def article_keyword(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("name")
    title = F.when(F.col("orig_idx") % 2 == 0, F.concat(n, F.lit("【2026年版】10選"))).otherwise(
        F.concat(n, F.lit("　コスパ最強ランキング")))
    return fx.products(spark, sf).select("orig_idx", T.article_keyword(title).alias("keyword"))


def tokens_of(name: Column) -> Column:
    return T.name_tokens(nfkc_lower(T.search_keyword(name)))


@query("nfkc_lower", fx.with_ctes("products") + """
SELECT orig_idx, concat(lower(brand), ' ', name, ' ', 'カ', CAST(packs AS VARCHAR), 'ml') AS folded FROM products""")
def nfkc_lower_query(spark: SparkSession, sf: str) -> DataFrame:
    wide = F.concat(F.translate("brand", "BbrandN#0123456789", "ＢｂｒａｎｄＮ＃０１２３４５６７８９"),
                    F.lit("　"), F.col("name"), F.lit(" ｶ"), F.col("packs").cast("string"), F.lit("㎖"))
    return fx.products(spark, sf).select("orig_idx", nfkc_lower(wide).alias("folded"))


@query("name_tokens", fx.with_ctes("products") + """
SELECT orig_idx, concat(replace(name, ' ', '|'), '|', lower(replace(brand, '#', '')), '|soft|バスマット') AS tokens FROM products""")
def name_tokens(spark: SparkSession, sf: str) -> DataFrame:
    name = F.concat("name", F.lit("・"), F.replace(F.col("brand"), F.lit("#"), F.lit("")), F.lit(" softバスマット 3.5x"))
    return fx.products(spark, sf).select("orig_idx", F.array_join(tokens_of(name), "|").alias("tokens"))


@query("identity_key", fx.with_ctes("products") + """
SELECT orig_idx, concat(replace(name, ' ', ''), 'ジェル洗剤') AS identity, replace(name, ' ', '') AS distinct_part FROM products""")
def identity_key(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(F.lit("【送料無料】"), F.initcap("name"), F.lit(" ジェル洗剤 ポイント10倍 "),
                    F.col("amount").cast("string"), F.lit("ml"))
    key = T.identity_key(nfkc_lower(text))
    return fx.products(spark, sf).select(
        "orig_idx", key.alias("identity"), T.distinct_key(key).alias("distinct_part"))


@query("match_keywords", fx.with_ctes("products") + """
SELECT orig_idx, concat_ws('|', name, concat(name, ' L'), lower(category_id), 'guide to all') AS keywords FROM products""")
def match_keywords(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat("name", F.lit(" L （本体） "), F.col("amount").cast("string"), F.lit("枚入"))
    rows = fx.products(spark, sf).select(
        "orig_idx", T.match_keywords(
            text, nfkc(text), F.array(F.lower("category_id"), F.col("name")), F.lit("guide to all 比較")
        ).alias("k"))
    return rows.select("orig_idx", F.array_join("k", "|").alias("keywords"))


@query("supplemental_query", fx.with_ctes("products") + """
SELECT orig_idx, concat(lower(brand), ' ', name, ' ', CAST(amount AS VARCHAR), unit, ' ', CAST(packs AS VARCHAR), '個') AS query FROM products""")
def supplemental_query(spark: SparkSession, sf: str) -> DataFrame:
    name = F.col("name")
    long_name = F.concat(name, F.lit(" averyveryveryveryverylongtrailingword"))
    # composed forms are columns of their own: Python functions cannot sit in a lambda
    df = with_nfkc_lower(fx.products(spark, sf), {
        "primary": T.search_keyword(name), "kw": T.search_keyword(long_name),
        "b": F.concat("brand", F.lit(" (x)"))}).withColumn("size", nfkc(F.col("capacity")))
    q = T.supplemental_query(F.col("b"), T.name_tokens(F.col("kw")), F.col("size"), F.col("primary"))
    return df.select("orig_idx", q.alias("query"))


@query("name_check", fx.with_ctes("products") + """
SELECT orig_idx, true AS loose, orig_idx % 2 = 0 AS strict FROM products""")
def name_check(spark: SparkSession, sf: str) -> DataFrame:
    tokens = T.distinctive_tokens(F.concat("name", F.lit(" セット "), F.col("amount").cast("string"), F.lit("枚")))
    first = F.split("name", " ")[0]
    api = F.when(F.col("orig_idx") % 2 == 0, F.upper("name")).otherwise(F.concat(first, F.lit(" other")))
    return fx.products(spark, sf).select(
        "orig_idx", T.same_name(tokens, api).alias("loose"), T.same_name(tokens, api, strict=True).alias("strict"))


# -- links -------------------------------------------------------------------

@query("item_code", fx.with_ctes("products") + """
SELECT orig_idx, base_url AS direct, concat('shop', CAST(orig_idx % 7 AS VARCHAR), ':item', CAST(orig_idx AS VARCHAR)) AS code,
  concat('item', CAST(orig_idx AS VARCHAR)) AS item, true AS same FROM products""")
def item_code(spark: SparkSession, sf: str) -> DataFrame:
    wrapped = F.concat(F.lit(f"https://{U.AFFILIATE_HOST}/x/?pc="), F.url_encode("base_url"), F.lit("&m=1"))
    return fx.products(spark, sf).withColumn("w", wrapped).select(
        "orig_idx", U.direct_item_url(F.col("w")).alias("direct"), U.affiliate_code(F.col("w")).alias("code"),
        U.base_item_code(F.col("w")).alias("item"), U.same_item(F.col("w"), F.col("base_url")).alias("same"))


@query("code_identity", fx.with_ctes("products") + """
SELECT orig_idx, concat('code', CAST(orig_idx AS VARCHAR)) AS code FROM products WHERE orig_idx % 3 = 0""")
def code_identity(spark: SparkSession, sf: str) -> DataFrame:
    """Products whose item code another marketplace lists; all-digit codes do not identify."""
    n = F.col("orig_idx").cast("string")
    code = F.when(F.col("orig_idx") % 3 == 0, F.concat(F.lit("Code"), n)).otherwise(n)
    rows = fx.products(spark, sf).withColumn("c", code)
    left = rows.select("orig_idx", U.base_item_code(F.concat(
        F.lit("https://item.rakuten.co.jp/s/"), "c", F.lit("/"))).alias("code"))
    target = F.concat(F.lit("https://store.shopping.yahoo.co.jp/s/"), F.upper("c"), F.lit(".html"))
    right = rows.select(U.offer_item_code(F.concat(
        F.lit("https://ck.example/r?vc_url="), F.url_encode(target))).alias("code"))
    return left.filter(~F.col("code").rlike(r"^\d+$")).join(right, "code", "left_semi").select("orig_idx", "code")


@query("url_multiplier", fx.with_ctes("products") + """
SELECT orig_idx, CASE WHEN packs >= 2 THEN packs ELSE 1 END AS times FROM products""")
def url_multiplier(spark: SparkSession, sf: str) -> DataFrame:
    page = F.concat(F.lit("https://store.example/s/"), F.lpad(F.col("orig_idx").cast("string"), 13, "4"),
                    F.lit("x"), F.col("packs").cast("string"), F.lit(".html"))
    wrapped = F.when(F.col("orig_idx") % 2 == 0, page).otherwise(
        F.concat(F.lit("https://ck.example/r?sid=1&vc_url="), F.url_encode(page)))
    return fx.products(spark, sf).select("orig_idx", U.quantity_multiplier(wrapped).alias("times"))


@query("asin_extract", """
WITH p AS (SELECT page_id, url, upper(concat('b0', lpad(CAST(page_id AS VARCHAR), 8, '0'))) AS id FROM pages)
SELECT page_id, CASE WHEN page_id % 4 < 3 THEN id END AS id,
  CASE page_id % 4 WHEN 0 THEN concat('https://www.amazon.co.jp/dp/', id, '?tag=t-22') WHEN 1 THEN concat('https://x.example/dp/', id, '/ref=1?tag=t-22')
    WHEN 2 THEN concat('https://x.example/q?ASIN=', id, '&tag=own') ELSE
      CASE WHEN contains(split_part(url, '#', 1), '?') THEN concat(split_part(url, '#', 1), '&tag=t-22') ELSE concat(split_part(url, '#', 1), '?tag=t-22') END
      || CASE WHEN contains(url, '#') THEN concat('#', split_part(url, '#', 2)) ELSE '' END END AS link FROM p""")
def asin_extract(spark: SparkSession, sf: str) -> DataFrame:
    code = F.concat(F.lit("b0"), F.lpad(F.col("page_id").cast("string"), 8, "0"))
    kind = F.col("page_id") % 4
    text = (
        F.when(kind == 0, F.concat(F.lit(" "), code, F.lit(" ")))
        .when(kind == 1, F.concat(F.lit("https://x.example/dp/"), F.upper(code), F.lit("/ref=1")))
        .when(kind == 2, F.concat(F.lit("https://x.example/q?ASIN="), F.upper(code), F.lit("&tag=own")))
        .otherwise(F.col("url")))
    return fx.table(spark, sf, "pages").select(
        "page_id", U.catalogue_id(text).alias("id"), U.tagged_url(text, "t-22").alias("link"))


@query("page_path", """
WITH s AS (SELECT page_id, regexp_replace(url, '^https?://[^/]+', '') AS p FROM pages),
c AS (SELECT *, regexp_extract(p, '^[^#?]*') AS page FROM s)
SELECT page_id, concat('/base', page, CASE WHEN page LIKE '%/' OR contains(regexp_extract(page, '[^/]*$'), '.') THEN '' ELSE '/' END, substr(p, length(page) + 1)) AS path FROM c""")
def page_path(spark: SparkSession, sf: str) -> DataFrame:
    target = F.regexp_replace("url", "^https?://[^/]+", "")
    return fx.table(spark, sf, "pages").select("page_id", U.site_path(target, "/base").alias("path"))


@query("failure_stage", """
SELECT page_id, CASE WHEN contains(url, 'example.com') THEN 'placeholder-url' WHEN page_id % 5 = 0 THEN 'search-zero-result'
  WHEN page_id % 5 = 1 THEN 'search-keyword-invalid' WHEN page_id % 5 = 2 THEN 'item-name-mismatch'
  WHEN page_id % 5 = 3 THEN 'item-update-failed' ELSE 'update-failed' END AS stage FROM pages""")
def failure_stage(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("page_id") % 5
    message = (
        F.when(kind == 0, "検索結果が0件です").when(kind == 1, "keyword is not valid")
        .when(kind == 2, "既存の商品名が現在の商品と一致しません").otherwise("HTTP 500"))
    ref = F.when(kind == 3, "shop:item")
    return fx.table(spark, sf, "pages").select(
        "page_id", T.failure_stage(message, ref, F.col("url")).alias("stage"))


# -- prose -------------------------------------------------------------------

_TAIL = """CASE doc_id % 7 WHEN 0 THEN '| item | 1,280円 |' WHEN 1 THEN '  約2.6円/枚 です' WHEN 2 THEN '価格は 12,800円 です'
  WHEN 3 THEN '価格 980円 <!-- lint-allow-number -->' WHEN 4 THEN '30〜50% 以上' ELSE '円錐の形' END"""


@query("lint_prose", f"""
WITH t AS (SELECT doc_id, text, {_TAIL} AS tail FROM documents),
f AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '単価は 9円 / g です' WHEN doc_id % 3 = 1 THEN 'およそ 1,500円 です' END AS answer FROM documents)
SELECT concat('doc-', CAST(doc_id AS VARCHAR)) AS article_id, 'body' AS area, length(text) - length(replace(text, chr(10), '')) + 2 + 4 AS line_no,
  CASE doc_id % 7 WHEN 0 THEN 'price-table' WHEN 1 THEN 'unit-price' ELSE 'price' END AS kind,
  CASE doc_id % 7 WHEN 2 THEN 'warn' ELSE 'error' END AS severity, trim(tail) AS snippet FROM t WHERE doc_id % 7 < 3
UNION ALL SELECT concat('doc-', CAST(doc_id AS VARCHAR)), 'faq', NULL, CASE doc_id % 3 WHEN 0 THEN 'unit-price' ELSE 'price' END,
  CASE doc_id % 3 WHEN 0 THEN 'error' ELSE 'warn' END, answer FROM f WHERE answer IS NOT NULL""")
def lint_prose(spark: SparkSession, sf: str) -> DataFrame:
    docs = fx.table(spark, sf, "documents").withColumn(
        "article_id", F.concat(F.lit("doc-"), F.col("doc_id").cast("string")))
    body = docs.select("article_id", F.lit(4).alias("first_line"),
                       F.concat("text", F.lit("\n"), F.expr(_TAIL)).alias("body"))
    answer = F.when(F.col("doc_id") % 3 == 0, "単価は 9円 / g です").when(
        F.col("doc_id") % 3 == 1, "およそ 1,500円 です")
    faqs = docs.select("article_id", answer.alias("answer"))
    return Q.lint_prose(body).unionByName(Q.lint_answers(faqs))


# question articles: at most two pairs each, in one of the three notations
_PAIRS = """
SELECT u.conv_id * 100 + u.turn div 4 AS doc, u.turn AS turn, (u.conv_id + u.turn div 4) % 4 AS form,
  trim(regexp_replace(u.text, '[^A-Za-z ]', ''{g})) AS q, trim(regexp_replace(a.text, '[^A-Za-z ]', ''{g})) AS a
FROM {{c}} u JOIN {{c}} a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1
WHERE u.role = 'user' AND a.role = 'assistant'
"""
PAIRS_SQL = "WITH pairs AS (" + _PAIRS.format(g=", 'g'").replace("{c}", "conversations").replace(" div ", " // ") + """),
kept AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY turn) - 1 AS pos FROM pairs WHERE form < 3 AND q <> '' AND a <> ''),
docs AS (SELECT doc, min(form) AS form FROM pairs GROUP BY doc),
per AS (SELECT doc, count(*) AS n FROM kept GROUP BY doc)
"""


def faq_articles(spark: SparkSession, sf: str) -> DataFrame:
    pairs = spark.sql(_PAIRS.format(g=""), c=fx.table(spark, sf, "conversations"))
    text = (
        F.when(F.col("form") == 0, F.concat(F.lit("**Q. "), "q", F.lit("**\n\n**A.** "), "a", F.lit("\n\n")))
        .when(F.col("form") == 1, F.concat(F.lit("### "), "q", F.lit("\n\n"), "a", F.lit("\n\n")))
        .when(F.col("form") == 2, F.concat(F.lit("**"), "q", F.lit("？**\n\nA. "), "a", F.lit("\n\n")))
        .otherwise("none\n"))
    # four turns hold two pairs at most
    docs = pairs.groupBy("doc").agg(
        F.min("form").alias("form"),
        F.array_sort(F.collect_list(F.struct("turn", text.alias("t"), "q", "a"))).alias("parts"))
    body = F.concat(
        F.lit("# Top\n\n**Q. outside**\n\nno\n\n## よくある質問（FAQ）\n\n"),
        F.array_join(F.transform("parts", lambda p: p["t"]), ""), F.lit("\n## まとめ\n\n### not this\n\nend\n"))
    return docs.select("doc", "form", "parts", body.alias("body"))


@query("extract_qa", PAIRS_SQL + """
SELECT doc, pos, CASE WHEN form = 2 THEN concat(q, '？') ELSE q END AS question, a AS answer FROM kept""")
def extract_qa(spark: SparkSession, sf: str) -> DataFrame:
    rows = Q.with_faqs(faq_articles(spark, sf), "faqs")
    return rows.select("doc", F.posexplode("faqs").alias("pos", "f")).select(
        "doc", "pos", "f.question", "f.answer")


def stored_faqs(spark: SparkSession, sf: str) -> DataFrame:
    """Every second article already holds its pairs."""
    rows = Q.with_faqs(faq_articles(spark, sf), "found")
    return rows.withColumn("faqs", F.when(F.col("doc") % 2 == 0, F.col("found"))).drop("found")


@query("faq_pending", PAIRS_SQL + "SELECT doc, n AS pairs FROM per WHERE doc % 2 = 1")
def faq_pending(spark: SparkSession, sf: str) -> DataFrame:
    return Q.pending_faqs(stored_faqs(spark, sf)).select("doc", F.size("faqs_new").alias("pairs"))


@query("faq_coverage", PAIRS_SQL + """
SELECT count(*) AS articles, count(n) AS extracted, count(*) - count(n) AS heading_only,
  count(n) FILTER (WHERE docs.doc % 2 = 1) AS to_update FROM docs LEFT JOIN per USING (doc)""")
def faq_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return Q.faq_coverage(stored_faqs(spark, sf))


@query("title_count", fx.with_ctes("products", "articles", more=SHELF) + """,
n AS (SELECT article_id, count(*) AS n FROM shelf GROUP BY 1)
SELECT article_id, concat('Guide ', CAST(doc_id AS VARCHAR), ' ', CAST(n AS VARCHAR), '選') AS title FROM articles JOIN n USING (article_id)""")
def title_count(spark: SparkSession, sf: str) -> DataFrame:
    counts = shelf(spark, sf).groupBy("article_id").agg(F.count("*").alias("n"))
    return fx.articles(spark, sf).join(counts, "article_id").select(
        "article_id", T.with_count(F.col("title"), F.col("n")).alias("title"))


@query("article_toc", fx.with_ctes("products", "articles", more=SHELF) + """,
n AS (SELECT article_id, count(*) AS n FROM shelf GROUP BY 1),
x AS (SELECT article_id, doc_id, coalesce(n, 0) > 0 AS p, coalesce(article_type, 'comparison') <> 'review' AS c, lang, source FROM articles LEFT JOIN n USING (article_id)),
items AS (SELECT article_id, 0 AS o, 2 AS depth, '商品比較表' AS text FROM x WHERE p AND c
  UNION ALL SELECT article_id, 1, 2, concat('About ', lang) FROM x
  UNION ALL SELECT article_id, 2, 3, source FROM x
  UNION ALL SELECT article_id, 3, 2, 'よくある質問' FROM x WHERE doc_id % 2 = 0
  UNION ALL SELECT article_id, 4, 2, CASE WHEN c THEN '各商品の詳細' ELSE '商品情報' END FROM x WHERE p)
SELECT article_id, row_number() OVER (PARTITION BY article_id ORDER BY o) - 1 AS pos, depth, text FROM items""")
def article_toc(spark: SparkSession, sf: str) -> DataFrame:
    counts = shelf(spark, sf).groupBy("article_id").agg(F.count("*").alias("n"))
    body = F.concat(F.lit("# Title\n\n## About "), "lang", F.lit("\nx\n### "), "source",
                    F.lit("\n#### deep\n## About "), "lang", F.lit("\n"))
    articles = fx.articles(spark, sf).join(counts, "article_id", "left").select(
        "article_id", "article_type", body.alias("body"), F.coalesce("n", F.lit(0)).alias("product_count"),
        (1 - F.col("doc_id") % 2).alias("faq_count"))
    return Q.article_toc(articles)


# -- record rules and changes ------------------------------------------------

@query("dq_violations", fx.with_ctes("products", "offers", "articles", "categories", more=SHELF) + """,
t AS (SELECT article_id, doc_id, article_type, category_id, CASE WHEN doc_id % 40 = 3 THEN repeat('x', 61) ELSE title END AS title FROM articles)
SELECT concat('p', CAST(orig_idx AS VARCHAR)) AS record, 'price_not_negative' AS rule, '-5' AS value FROM products WHERE orig_idx % 50 = 0
UNION ALL SELECT concat('p', CAST(orig_idx AS VARCHAR)), 'rank_positive', '0' FROM products WHERE orig_idx % 70 = 0
UNION ALL SELECT concat('p', CAST(orig_idx AS VARCHAR)), 'rating_0_to_5', '7.5' FROM products WHERE orig_idx % 60 = 1
UNION ALL SELECT concat('p', CAST(orig_idx AS VARCHAR)), 'url_valid', 'nowhere' FROM products WHERE orig_idx % 80 = 2
UNION ALL SELECT concat('o', CAST(orig_idx AS VARCHAR), '-', CAST(pos AS VARCHAR)), 'status_known', 'odd' FROM offers WHERE pos % 1000 = 0
UNION ALL SELECT article_id, 'title_length', title FROM t WHERE doc_id % 40 = 3
UNION ALL SELECT article_id, 'type_known', NULL FROM t WHERE article_type IS NULL
UNION ALL SELECT article_id, 'category_known', category_id FROM t WHERE category_id NOT IN (SELECT category_id FROM categories)
UNION ALL SELECT article_id, 'comparison_has_products', '0' FROM t WHERE article_type = 'comparison' AND article_id NOT IN (SELECT article_id FROM shelf)""")
def dq_violations(spark: SparkSession, sf: str) -> DataFrame:
    idx = F.col("orig_idx")
    products = fx.products(spark, sf).withColumns({
        "price": F.when(idx % 50 == 0, -5).otherwise(F.col("price")),
        "rank": F.when(idx % 70 == 0, 0).otherwise(1),
        "rating": F.when(idx % 60 == 1, 7.5).otherwise(F.col("rating")),
        "base_url": F.when(idx % 80 == 2, "nowhere").otherwise(F.col("base_url")),
    })
    offers = fx.offers(spark, sf).withColumn(
        "match_status", F.when(F.col("pos") % 1000 == 0, "odd").otherwise(F.col("match_status")))
    articles = fx.articles(spark, sf).withColumns({
        "title": F.when(F.col("doc_id") % 40 == 3, "x" * 61).otherwise(F.col("title")),
        "description": F.lit("short"),
    })
    return (
        Q.violations(products, F.concat(F.lit("p"), idx.cast("string")), Q.product_rules())
        .unionByName(Q.violations(
            offers, F.concat(F.lit("o"), idx.cast("string"), F.lit("-"), F.col("pos").cast("string")),
            Q.offer_rules()))
        .unionByName(Q.article_violations(articles, fx.categories(spark, sf), shelf(spark, sf)))
    )


@query("field_changes", fx.with_ctes("products") + """
SELECT orig_idx, 'price' AS field, CAST(price AS VARCHAR) AS before, CAST(price + 10 AS VARCHAR) AS after FROM products WHERE orig_idx % 4 = 0
UNION ALL SELECT orig_idx, 'name', name, concat(name, ' 2') FROM products WHERE orig_idx % 6 = 0
UNION ALL SELECT orig_idx, 'capacity', capacity, NULL FROM products WHERE orig_idx % 10 = 5""")
def field_changes(spark: SparkSession, sf: str) -> DataFrame:
    before = fx.products(spark, sf)
    idx = F.col("orig_idx")
    after = before.withColumns({
        "price": F.when(idx % 4 == 0, F.col("price") + 10).otherwise(F.col("price")),
        "name": F.when(idx % 6 == 0, F.concat("name", F.lit(" 2"))).otherwise(F.col("name")),
        "capacity": F.when(idx % 10 != 5, F.col("capacity")),
    })
    return Q.field_changes(before, after, ["orig_idx"], ["name", "price", "capacity", "review_count"])
