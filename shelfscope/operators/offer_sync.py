"""Offer sync: evaluated search hits decide, stored offers change, a report tells why."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage
from .numbering import first_per, top_per
from .offers import invalidate_offers, offer_decisions, upsert_offers

PROVIDER = "yahoo"
HIT = ("name", "price", "rating", "review_count", "image_url")
REJECTIONS = 5  # a report shows the first ones


def decide(evaluated: DataFrame, offers: DataFrame, key: str) -> DataFrame:
    """Decisions of one run, written once, so that offers and report follow from the same rows."""
    return cut_lineage(offer_decisions(evaluated, offers, key, HIT))


def apply_decisions(decided: DataFrame, offers: DataFrame, key: str, as_of: Column, label: str) -> DataFrame:
    """All stored offers after the run, and those it adds.

    ``offers``: key, pos, provider, label, url, match_status, match_notes, price, rating, review_count,
    image_url, available, updated_at, catalogue_id.  Adds ``action`` (keep, insert, refresh, replace, locked,
    other_url, pending_other_url, unknown_status or review), ``changed`` and the ``reason`` of a skipped write.
    A new offer stands after the last one of its product.  Offers of products that were not searched are kept.
    """
    last = offers.groupBy(key).agg(F.max("pos").alias("_last"))
    text = F.lit(None).cast("string")
    incoming = decided.filter("action = 'upsert'").join(last, key, "left").select(
        key, F.lit(PROVIDER).alias("provider"), F.lit(label).alias("label"), F.col("selected_url").alias("url"),
        *[F.col(f"selected.{c}").alias(c) for c in HIT if c != "name"], F.lit(True).alias("available"),
        as_of.alias("updated_at"), text.alias("catalogue_id"), F.lit(True).alias("verified"), "strict", "force",
        F.coalesce(F.col("_last") + 1, F.lit(0)).alias("pos"), text.alias("match_notes"))
    merged = upsert_offers(offers, incoming, [key], ("pos", "match_notes")).withColumnRenamed("changed", "_written")
    doubted = decided.filter("action = 'review'").select(
        key, F.concat(F.lit("capacity不一致: "), "rejected_reason").alias("notes"))
    out = invalidate_offers(merged, doubted, [key], PROVIDER)
    return out.withColumns({
        "action": F.when(F.col("changed"), "review").otherwise(F.col("action")),
        "changed": F.col("changed") | F.col("_written"),
    }).drop("_written")


def report(evaluated: DataFrame, decided: DataFrame, synced: DataFrame, key: str) -> DataFrame:
    """One row per searched product: decision, the accepted hit, the first rejected ones and what was not written.

    Only hits up to the accepted one were looked at; they are counted, and of the rejected ones the first five
    are listed with name and reason.
    """
    order = [F.col("query_idx"), F.col("pos")]
    seen = first_per(evaluated, [key, "url"], order)
    accepted = seen.filter("ok").groupBy(key).agg(F.min(F.struct(*order)).alias("_end"))
    looked = seen.join(accepted, key, "left").filter(
        F.coalesce(F.struct(*order) <= F.col("_end"), F.lit(True))).drop("_end")
    counts = looked.groupBy(key).agg(F.count("*").alias("candidates"))
    shown = top_per(looked.filter("NOT ok"), [key], order, REJECTIONS, "_nth").groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("_nth", "name", "reason"))).alias("_r"))
    rejected = F.transform("_r", lambda r: F.struct(r["name"].alias("name"), r["reason"].alias("reason")))
    skipped = synced.filter(f"provider = '{PROVIDER}' AND reason IS NOT NULL").groupBy(key).agg(
        F.min_by("reason", "pos").alias("write_skipped"))
    took = F.col("action") == "upsert"
    return (
        decided.join(counts, key).join(shown, key, "left").join(skipped, key, "left").select(
            key, F.when(took, "auto").otherwise("review").alias("decision"), "candidates",
            F.when(took, F.col("selected.name")).alias("candidate"), F.when(took, F.col("selected.price")).alias("price"),
            F.col("selected_url").alias("url"), "strict",
            F.coalesce(rejected, F.array().cast("array<struct<name:string,reason:string>>")).alias("rejected"),
            F.when(F.col("force"), "replace").when(F.col("action") == "review", "downgrade").alias("change"),
            "rejected_reason", "write_skipped"))
