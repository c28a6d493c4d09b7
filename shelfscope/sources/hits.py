"""Landed marketplace search responses to candidate rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

OFFER_RESPONSE = (
    "hits array<struct<name:string,url:string,price:bigint,inStock:boolean,"
    "review:struct<rate:double,count:bigint>,image:struct<small:string,medium:string>,"
    "exImage:struct<url:string>,seller:struct<name:string>>>"
)
BASE_RESPONSE = (
    "Items array<struct<itemName:string,itemPrice:bigint,itemUrl:string,affiliateUrl:string,"
    "mediumImageUrls:array<string>,reviewCount:string,reviewAverage:string,shopName:string,shopUrl:string>>"
)


def offer_hits(responses: DataFrame, body: str = "body") -> DataFrame:
    """Hits of the offer marketplace; rows without name or link are dropped.

    A response without hits (an error, an empty search) gives no rows.
    """
    keys = [c for c in responses.columns if c != body]
    hits = responses.select(*keys, F.posexplode(F.from_json(body, OFFER_RESPONSE)["hits"]).alias("pos", "h"))
    return hits.filter("h.name <> '' AND h.url <> ''").select(
        *keys, "pos", "h.name", "h.price", F.col("h.review.rate").alias("rating"),
        F.col("h.review.count").alias("review_count"), "h.url",
        F.coalesce("h.exImage.url", "h.image.medium", "h.image.small").alias("image_url"),
        F.coalesce("h.inStock", F.lit(True)).alias("available"),
        F.col("h.seller.name").alias("seller_name"))


def base_hits(responses: DataFrame, body: str = "body") -> DataFrame:
    """Items of the base marketplace; a zero rating or review count is unknown."""
    keys = [c for c in responses.columns if c != body]
    items = responses.select(*keys, F.posexplode(F.from_json(body, BASE_RESPONSE)["Items"]).alias("pos", "h"))

    def known(column: str, kind: str) -> F.Column:
        return F.nullif(F.col(column).try_cast(kind), F.lit(0).cast(kind))

    return items.select(
        *keys, "pos", F.col("h.itemName").alias("name"), F.col("h.itemPrice").alias("price"),
        known("h.reviewAverage", "double").alias("rating"), known("h.reviewCount", "bigint").alias("review_count"),
        F.col("h.itemUrl").alias("item_url"), F.col("h.affiliateUrl").alias("affiliate_url"),
        F.get("h.mediumImageUrls", F.lit(0)).alias("image_url"),
        F.col("h.shopName").alias("shop_name"), F.col("h.shopUrl").alias("shop_url"))
