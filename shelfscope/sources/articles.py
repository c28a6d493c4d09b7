"""Markdown articles and categories with YAML front matter."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType

OFFER = ("struct<provider:string,label:string,asin:string,price:bigint,rating:double,reviewCount:bigint,"
         "url:string,imageUrl:string,available:boolean,updatedAt:string,matchStatus:string,matchNotes:string>")
PRODUCT = ("struct<rank:bigint,name:string,brand:string,price:bigint,capacity:string,pricePerUnit:string,"
           "rating:double,reviewCount:bigint,features:array<string>,pros:array<string>,cons:array<string>,"
           f"recommendedFor:string,rakutenUrl:string,imageUrl:string,offers:array<{OFFER}>>")
ARTICLE = ("struct<title:string,description:string,category:string,publishedAt:string,updatedAt:string,"
           f"articleType:string,tags:array<string>,draft:boolean,products:array<{PRODUCT}>,"
           "faqs:array<struct<question:string,answer:string>>>")
CATEGORY = "struct<name:string,slug:string,description:string,icon:string,order:int>"
_FRONT = r"(?s)^---\r?\n(.*?)\r?\n---(.*)\z"


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """``path, content`` of all Markdown files below a folder."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.{md,mdx}").load(path)
        .select("path", F.col("content").cast("string").alias("content"))
    )


@F.pandas_udf(StringType())
def _yaml_to_json(front: pd.Series) -> pd.Series:
    """YAML blocks to JSON text; NULL for a broken block."""
    import json
    import re

    import yaml

    class Loader(getattr(yaml, "CSafeLoader", yaml.SafeLoader)):
        """Scalars of the JSON schema only: null, true and false, integers, floats; all else stays text."""

    kinds = {
        "null": r"null|Null|NULL|~|",
        "bool": r"true|True|TRUE|false|False|FALSE",
        "int": r"[-+]?(?:0b[01]+|0o[0-7]+|0x[0-9a-fA-F]+|[0-9]+)",
        "float": r"[-+]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][-+]?[0-9]+)?|[-+]?\.(?:inf|Inf|INF)|\.(?:nan|NaN|NAN)",
    }
    Loader.yaml_implicit_resolvers = {
        None: [(f"tag:yaml.org,2002:{kind}", re.compile(f"(?:{rx})$")) for kind, rx in kinds.items()]}

    def integer(loader: yaml.Loader, node: yaml.Node) -> int:
        text = loader.construct_scalar(node).lower()
        base = next((b for mark, b in (("0b", 2), ("0o", 8), ("0x", 16)) if mark in text[:3]), 10)
        return int(text, base)

    def real(loader: yaml.Loader, node: yaml.Node) -> float | None:
        # JSON has no infinity and no NaN
        text = loader.construct_scalar(node)
        return None if text.lstrip("+-.").lower() in ("inf", "nan") else float(text)

    Loader.add_constructor("tag:yaml.org,2002:int", integer)
    Loader.add_constructor("tag:yaml.org,2002:float", real)

    def convert(text: str) -> str | None:
        try:
            return json.dumps(yaml.load(text, Loader) or {}, ensure_ascii=False)
        except (yaml.YAMLError, TypeError, ValueError):
            return None

    return front.map(convert, na_action="ignore")


def parse_front_matter(files: DataFrame, schema: str = ARTICLE) -> tuple[DataFrame, DataFrame]:
    """Records (``path, data, body, first_line``) and the rejected paths.

    Only the YAML block goes to Python; the record takes a fixed type.
    """
    split = files.select(
        "path", F.when(F.col("content").rlike(_FRONT), F.regexp_extract("content", _FRONT, 1)).alias("front"),
        F.regexp_extract("content", _FRONT, 2).alias("body"))
    parsed = split.withColumn("json", _yaml_to_json("front"))
    # the generator keeps the filters below from parsing each block again
    rows = parsed.select("path", "body", "front", F.explode(F.array(F.struct("json"))).alias("one")).select(
        # the body starts with the rest of the closing line
        "path", "body", (F.size(F.split("front", "\n")) + 1).alias("first_line"),
        F.from_json("one.json", schema).alias("data"))
    return rows.filter("data IS NOT NULL"), rows.filter("data IS NULL").select("path")


def article_table(records: DataFrame) -> DataFrame:
    d = F.col("data")
    return records.select(
        F.regexp_extract("path", r"([^/]+)\.mdx?$", 1).alias("article_id"), "path",
        d["articleType"].alias("article_type"), d["title"].alias("title"),
        d["description"].alias("description"), d["category"].alias("category_id"), d["tags"].alias("tags"),
        F.coalesce(d["draft"], F.lit(False)).alias("draft"),
        F.try_to_date(d["publishedAt"]).alias("published_at"), F.try_to_date(d["updatedAt"]).alias("updated_at"),
        d["faqs"].alias("faqs"), "body", "first_line", d["products"].alias("products"))


def explode_products(articles: DataFrame) -> DataFrame:
    """One row per product; ``orig_idx`` is the place in the list."""
    p = F.col("p")
    return articles.select("article_id", F.posexplode("products").alias("orig_idx", "p")).select(
        "article_id", "orig_idx", p["rank"].alias("rank"), p["name"].alias("name"),
        F.nullif(p["brand"], F.lit("")).alias("brand"), p["price"].alias("price"),
        p["capacity"].alias("capacity"), p["pricePerUnit"].alias("price_per_unit"),
        p["rating"].alias("rating"), p["reviewCount"].alias("review_count"), p["features"].alias("features"),
        p["pros"].alias("pros"), p["cons"].alias("cons"), p["recommendedFor"].alias("recommended_for"),
        p["rakutenUrl"].alias("base_url"), p["imageUrl"].alias("image_url"), p["offers"].alias("offers"))


def explode_offers(products: DataFrame) -> DataFrame:
    o = F.col("o")
    return products.select("article_id", "orig_idx", F.posexplode("offers").alias("pos", "o")).select(
        "article_id", "orig_idx", "pos", o["provider"].alias("provider"), o["label"].alias("label"),
        o["asin"].alias("catalogue_id"), o["price"].alias("price"), o["rating"].alias("rating"),
        o["reviewCount"].alias("review_count"), o["url"].alias("url"), o["imageUrl"].alias("image_url"),
        o["available"].alias("available"), F.try_to_timestamp(o["updatedAt"]).alias("updated_at"),
        o["matchStatus"].alias("match_status"), o["matchNotes"].alias("match_notes"))


def product_offers(products: DataFrame) -> DataFrame:
    """All product columns beside each offer ``offer``, in one pass; a product without offers is one row without."""
    return products.select("*", F.explode_outer("offers").alias("offer")).drop("offers")


def category_table(records: DataFrame) -> DataFrame:
    d = F.col("data")
    return records.select(
        F.regexp_extract("path", r"([^/]+)\.mdx?$", 1).alias("category_id"), d["name"].alias("name"),
        d["slug"].alias("slug"), d["description"].alias("description"), d["order"].alias("sort_order"))
