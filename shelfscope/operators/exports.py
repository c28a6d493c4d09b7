"""Search-ready and retrieval-ready tables with their summary."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import capacity as C
from ..functions import urls as U
from ..functions.patterns import REVIEW_SIGNALS
from ..functions.text import plain_answer
from ..sources.jsonl import number_at, text_at
from .numbering import top_per
from .offers import offer_summary


def _price_needs_review(label: Column) -> Column:
    """A dash, a due update, or a unit price of zero."""
    return F.coalesce(
        (label == "-") | label.contains("要更新") | label.rlike(r"^約?0(?:\.0+)?円/"), F.lit(False))


def product_records(products: DataFrame, articles: DataFrame, offers: DataFrame) -> DataFrame:
    """Retrieval records of comparison products with all required fields."""
    heads = articles.filter(F.coalesce("article_type", F.lit("comparison")) != "review").select(
        "article_id", "article_file", F.coalesce("title", F.lit("")).alias("article_title"),
        F.col("category_id").alias("category"))
    df = products.filter(
        "rank IS NOT NULL AND name <> '' AND price IS NOT NULL AND base_url IS NOT NULL").join(heads, "article_id")
    df = C.with_total(df, "capacity", "_total")
    df = C.with_unit_price(df, "price", "_total", "_ppu")
    no_size = F.coalesce(F.col("capacity").isin("", "-"), F.lit(True))
    reasons = F.array_compact(F.array(
        F.when(no_size, "capacity未設定").when(F.col("_total").isNull(), "capacity抽出不可"),
        F.when(_price_needs_review(F.col("price_per_unit")), "pricePerUnit要確認"),
    ))
    summary = offer_summary(offers, "orig_idx")
    return (
        df.join(summary, "orig_idx", "left")
        .withColumn("review_reasons", reasons)
        .select(
            F.lit("product").alias("type"), "article_id", "article_file", "article_title", "category", "orig_idx",
            "rank", "name", F.coalesce("brand", F.lit("")).alias("brand"),
            F.coalesce("capacity", F.lit("-")).alias("capacity"),
            F.coalesce(C.normalized(F.col("_total")), "_total").alias("capacity_total"), "price",
            F.coalesce("price_per_unit", "_ppu.label").alias("price_per_unit"), "base_url",
            U.affiliate_code(F.col("base_url")).alias("item_code"), "offer_summary",
            (F.size("review_reasons") > 0).alias("needs_review"), "review_reasons")
    )


def capacity_patterns(rows: DataFrame, source: str) -> DataFrame:
    """Size patterns of products or reports: ``article_file, name, capacity, price, price_per_unit``."""
    df = C.with_total(rows.filter("name IS NOT NULL AND capacity <> ''"), "capacity", "extracted")
    df = C.with_unit_price(df, "price", "extracted", "_ppu")
    df = df.withColumn("price_per_unit", F.coalesce("price_per_unit", "_ppu.label"))
    none = F.col("extracted").isNull()
    review = none | (F.col("capacity") == "-") | _price_needs_review(F.col("price_per_unit"))
    return df.select(
        F.lit("capacity-pattern").alias("type"), F.lit(source).alias("source"), "article_file", "name",
        "capacity", "extracted", "price_per_unit", review.alias("needs_review"),
        F.when(none, "capacity抽出不可").when(review, "pricePerUnit要確認").alias("reason"))


def decision_records(lines: DataFrame) -> DataFrame:
    """Match decisions from tolerant lines; lines without article, name or action are left out."""
    b = F.col("body")
    return lines.select(
        F.lit("match-decision").alias("type"), F.col("file").alias("source_file"),
        text_at(b, "$.articleFile").alias("article_file"), number_at(b, "$.rank").cast("bigint").alias("rank"),
        F.coalesce(text_at(b, "$.currentName"), text_at(b, "$.current.name"), text_at(b, "$.name"))
        .alias("current_name"),
        text_at(b, "$.action").alias("action"), text_at(b, "$.confidence").alias("confidence"),
        F.coalesce(text_at(b, "$.selectedItemUrl"), text_at(b, "$.url")).alias("selected_item_url"),
        text_at(b, "$.reason").alias("reason"),
        F.coalesce(text_at(b, "$.status"), U.status_of(F.col("file"))).alias("status"),
    ).filter("article_file <> '' AND current_name <> '' AND action <> ''")


def _frequent(records: DataFrame, value: Column, n: int, at_least: int, out: str) -> DataFrame:
    """Per category the ``n`` most frequent values, ties by first appearance."""
    counts = (
        records.withColumn("_v", value).filter("_v <> ''").groupBy("category", "_v")
        .agg(F.count("*").alias("_n"), F.min(F.struct("article_file", "orig_idx")).alias("_first"))
        .filter(F.col("_n") >= at_least)
    )
    best = top_per(counts, ["category"], [F.col("_n").desc(), F.col("_first"), F.col("_v")], n, "_at")
    return best.groupBy("category").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_at", "_v"))), lambda s: s["_v"]).alias(out))


def category_rules(records: DataFrame) -> DataFrame:
    """Per category: product count, top 5 units, up to 10 brands seen twice, review signals."""
    signals = [
        F.bool_or(F.col("name").contains(s) | F.col("capacity").contains(s)).alias(f"_s{i}")
        for i, s in enumerate(REVIEW_SIGNALS)
    ]
    base = records.groupBy("category").agg(F.count("*").alias("product_count"), *signals)
    found = F.array_compact(F.array(*[F.when(F.col(f"_s{i}"), s) for i, s in enumerate(REVIEW_SIGNALS)]))
    none = F.array().cast("array<string>")
    units = _frequent(records, F.col("capacity_total.unit"), 5, 1, "units")
    brands = _frequent(records, F.col("brand"), 10, 2, "common_brands")
    return (
        base.join(units, "category", "left").join(brands, "category", "left")
        .select(F.lit("category-rule").alias("type"), "category", F.coalesce("units", none).alias("units"),
                F.coalesce("common_brands", none).alias("common_brands"),
                found.alias("review_signals"), "product_count")
    )


def export_summary(tables: dict[str, DataFrame], review: str = "needs_review") -> DataFrame:
    """One row per exported table with its row count and rows under review."""
    counted = [
        df.agg(F.count("*").alias("rows"), (
            F.count_if(F.col(review)) if review in df.columns else F.lit(None).cast("bigint")).alias("needs_review"))
        .select(F.lit(name).alias("table"), "rows", "needs_review")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counted)


def search_records(tables: dict[str, DataFrame], order: dict[str, list[str]], text: str, limit: int = 20) -> DataFrame:
    """First records whose JSON text holds the query, in table and key order."""
    parts = []
    for place, (name, df) in enumerate(tables.items()):
        record = F.to_json(F.struct(*df.columns))
        parts.append(df.select(
            F.lit(place).alias("_t"), F.lit(name).alias("table"),
            F.concat_ws("/", *order[name]).alias("record_key"), record.alias("record"),
        ).filter(F.contains(F.lower("record"), F.lit(text.lower()))).orderBy("record_key").limit(limit))
    return reduce(DataFrame.unionByName, parts).orderBy("_t", "record_key").limit(limit).drop("_t")


def product_documents(shown: DataFrame) -> DataFrame:
    """Structured product documents; only products with a rating and a price.

    ``shown``: name, brand, capacity, rating, review_count, offer_price, offer_url.
    """
    rating = F.when(
        F.col("rating").isNotNull() & F.col("review_count").isNotNull(),
        F.struct(F.col("rating").alias("ratingValue"), F.col("review_count").alias("reviewCount")))
    doc = F.struct(
        F.lit("Product").alias("@type"), F.col("name").alias("name"), F.struct(F.col("brand").alias("name")).alias("brand"),
        F.struct(F.lit("JPY").alias("priceCurrency"), F.col("offer_price").alias("price"),
                 F.col("offer_url").alias("url")).alias("offers"),
        rating.alias("aggregateRating"))
    return shown.filter("rating IS NOT NULL AND offer_price > 0").withColumn("document", F.to_json(doc))


def faq_documents(articles: DataFrame) -> DataFrame:
    """Structured question documents of articles with stored pairs."""
    entry = F.transform("faqs", lambda f: F.struct(
        F.lit("Question").alias("@type"), f["question"].alias("name"),
        F.struct(F.lit("Answer").alias("@type"), plain_answer(f["answer"]).alias("text")).alias("acceptedAnswer")))
    return articles.filter(F.size("faqs") > 0).select("article_id", F.to_json(F.struct(
        F.lit("FAQPage").alias("@type"), entry.alias("mainEntity"))).alias("document"))


def article_documents(articles: DataFrame, site: str) -> DataFrame:
    """Structured article and breadcrumb documents."""
    link = F.concat(F.lit(f"{site}/articles/"), "article_id")
    crumbs = F.array(
        F.struct(F.lit(1).alias("position"), F.lit("ホーム").alias("name"), F.lit(site).alias("item")),
        F.struct(F.lit(2).alias("position"), F.col("category_name").alias("name"),
                 F.concat(F.lit(f"{site}/category/"), "slug").alias("item")),
        F.struct(F.lit(3).alias("position"), F.col("title").alias("name"), link.alias("item")))
    return articles.select(
        "article_id",
        F.to_json(F.struct(
            F.lit("Article").alias("@type"), F.col("title").alias("headline"), "description",
            F.col("published_at").alias("datePublished"),
            F.coalesce("updated_at", "published_at").alias("dateModified"), link.alias("url"))).alias("article"),
        F.to_json(F.struct(F.lit("BreadcrumbList").alias("@type"), crumbs.alias("itemListElement"))).alias("breadcrumb"))
