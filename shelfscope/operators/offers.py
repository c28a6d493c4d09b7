"""Offers: visibility, fallbacks, lowest prices, upserts and invalidation.

Offers: ``<key>, provider, pos, price, url, match_status, available,
updated_at, label``; products carry the same key.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.patterns import (
    BASE_PROVIDER, PROVIDER_LABELS, PROVIDER_SHORT, PROVIDERS, UNPRICED_PROVIDER,
)
from ..functions.urls import amazon_search_url, is_url, yahoo_search_url
from .numbering import first_per, row_numbers, top_per

PLACE = ["provider_order", "seq", "pos"]


def _lookup(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain(*values.items())])


def provider_order(provider: Column) -> Column:
    """Fixed display order; unknown providers last."""
    order = F.try_element_at(_lookup({p: i for i, p in enumerate(PROVIDERS)}), provider)
    return F.coalesce(order, F.lit(len(PROVIDERS)))


def provider_label(provider: Column) -> Column:
    return F.try_element_at(_lookup(PROVIDER_LABELS), provider)


def provider_short(provider: Column) -> Column:
    return F.try_element_at(_lookup(PROVIDER_SHORT), provider)


def known_price(price: Column) -> Column:
    return F.coalesce(price > 0, F.lit(False))


def is_visible(enabled: list[str]) -> Column:
    """Not sold out, a real link, matched (or from before matching), enabled provider."""
    return (
        F.coalesce(F.col("available"), F.lit(True)) & is_url(F.col("url"))
        & (F.coalesce(F.nullif(F.col("match_status"), F.lit("")), F.lit("matched")) == "matched")
        & F.col("provider").isin(enabled)
    )


def is_fresh(as_of: Column, provider: str = UNPRICED_PROVIDER) -> Column:
    """Cached prices of one provider hold for less than 24 hours."""
    recent = F.col("updated_at") > as_of - F.expr("INTERVAL 24 HOURS")
    return (F.col("provider") != provider) | F.coalesce(recent, F.lit(False))


def visible_offers(
    products: DataFrame, offers: DataFrame, key: str, enabled: list[str] | None = None,
    yahoo: tuple[str, str] | None = None, amazon_tag: str | None = None,
) -> DataFrame:
    """Offers shown for each product, with fallback rows, one per provider and link.

    The base provider falls back to the product's own link and price.  A search
    link is added for one provider without a visible offer and for another
    provider without any offer at all.
    """
    enabled = enabled or [BASE_PROVIDER]
    shown = is_visible(enabled)
    columns = [key, "provider", "label", "price", "url", "seq", "pos"]
    rows = offers.filter(shown).select(
        key, "provider", F.coalesce("label", provider_label(F.col("provider"))).alias("label"),
        "price", "url", F.lit(0).alias("seq"), F.col("pos").cast("bigint").alias("pos"))
    flags = offers.groupBy(key).agg(
        F.bool_or(shown & (F.col("provider") == BASE_PROVIDER)).alias("_base"),
        F.bool_or(shown & (F.col("provider") == "yahoo")).alias("_yahoo"),
        F.bool_or(F.col("provider") == "amazon").alias("_amazon"),
    )
    none = F.lit(False)
    bare = products.select(key, "name", "price", "base_url").join(flags, key, "left")

    def fallback(provider: str, label: str, url: Column, price: Column, seq: int) -> Column:
        return F.struct(
            F.lit(provider).alias("provider"), F.lit(label).alias("label"), price.alias("price"),
            url.alias("url"), F.lit(seq).alias("seq"), F.lit(0).cast("bigint").alias("pos"))

    no_price = F.lit(None).cast("bigint")
    named = F.coalesce(F.col("name") != "", none)
    extra = [F.when(
        ~F.coalesce("_base", none) & is_url(F.col("base_url")),
        fallback(BASE_PROVIDER, PROVIDER_LABELS[BASE_PROVIDER], F.col("base_url"), F.col("price"), 1))]
    if yahoo and "yahoo" in enabled:
        extra.append(F.when(
            ~F.coalesce("_yahoo", none) & named,
            fallback("yahoo", "Yahoo!で探す", yahoo_search_url(F.col("name"), *yahoo), no_price, 2)))
    if amazon_tag and "amazon" in enabled:
        extra.append(F.when(
            ~F.coalesce("_amazon", none) & named,
            fallback("amazon", "Amazonで探す", amazon_search_url(F.col("name"), amazon_tag), no_price, 3)))
    added = bare.select(key, F.inline(F.array_compact(F.array(*extra))))
    merged = rows.unionByName(added.select(*columns))
    return first_per(merged, [key, "provider", "url"], [F.col("seq"), F.col("pos"), F.col("price")]).withColumn(
        "provider_order", provider_order(F.col("provider")))


def comparable_price(allow_unpriced: bool = False) -> Column:
    known = known_price(F.col("price"))
    return known if allow_unpriced else known & (F.col("provider") != UNPRICED_PROVIDER)


def comparable(visible: DataFrame, allow_unpriced: bool = False) -> DataFrame:
    """Visible offers whose price may be compared."""
    return visible.filter(comparable_price(allow_unpriced))


def lowest_offer(priced: DataFrame, key: str) -> DataFrame:
    """Cheapest offer per product; ties by provider order, then position."""
    best = F.min_by(F.struct("provider", "label", "price", "url"), F.struct("price", *PLACE))
    return priced.groupBy(key).agg(best.alias("_o")).select(key, "_o.*")


def price_gap(priced: DataFrame, key: str) -> DataFrame:
    """Difference between the two cheapest offers; NULL label with one offer only."""
    two = top_per(priced, [key], [F.col(c) for c in ("price", *PLACE)], 2, "_rn")
    first = F.col("_rn") == 1
    return (
        two.groupBy(key).agg(
            F.max(F.when(first, F.col("price"))).alias("lowest_price"),
            F.max(F.when(first, F.col("provider"))).alias("lowest_provider"),
            F.max(F.when(~first, F.col("price"))).alias("_second"))
        .withColumn("gap", F.col("_second") - F.col("lowest_price"))
        .withColumn("gap_label", F.when(F.col("gap") == 0, "同価格").when(
            F.col("gap") > 0,
            F.concat(provider_short(F.col("lowest_provider")), F.lit("が"),
                     F.format_number("gap", 0), F.lit("円安い"))))
        .drop("_second")
    )


def price_summary(priced: DataFrame, key: str) -> DataFrame:
    """Lowest price and provider, number of price rows, difference label.

    The price rows themselves stay rows (``offer_rows``): a product may have
    any number of them.
    """
    counts = priced.groupBy(key).agg(F.count("*").alias("price_rows"))
    return counts.join(price_gap(priced, key), key)


def display_price(products: DataFrame, lowest: DataFrame, key: str) -> DataFrame:
    """Lowest price, else the known base price, else NULL."""
    low = lowest.select(key, F.col("price").alias("lowest_price"))
    return products.join(low, key, "left").withColumn(
        "display_price", F.coalesce("lowest_price", F.when(F.col("price") > 0, F.col("price"))))


def offer_rows(visible: DataFrame, products: DataFrame, key: str) -> DataFrame:
    """Offers with the price shown for their provider and a mark on the lowest.

    The shown price is the first comparable price of the provider; the base
    provider falls back to the product's price.
    """
    usable = comparable_price()
    # every visible provider has a row, so that the lowest price comes along in the same join
    shops = visible.groupBy(F.col(key).alias("_key"), F.col("provider").alias("_provider")).agg(
        F.min_by("price", F.when(usable, F.struct("seq", "pos"))).alias("_row_price"),
        F.min(F.when(usable, F.col("price"))).alias("_low"),
    ).withColumn("lowest_price", F.min("_low").over(Window.partitionBy("_key")))
    here = (F.col(key) == F.col("_key")) & F.col("provider").eqNullSafe(F.col("_provider"))
    base = products.select(key, F.col("price").alias("_base"))
    shown = F.coalesce(
        F.col("_row_price"),
        F.when((F.col("provider") == BASE_PROVIDER) & (F.col("_base") > 0), F.col("_base")))
    return (
        visible.join(shops, here, "left").join(base, key, "left")
        .withColumn("shown_price", shown)
        .withColumn("is_lowest", F.coalesce(F.col("shown_price") == F.col("lowest_price"), F.lit(False)))
        .drop("_row_price", "_base", "_low", "_key", "_provider")
    )


def display_order(visible: DataFrame, key: str) -> DataFrame:
    """Cheapest first; the unpriced provider and unknown prices last."""
    value = F.when((F.col("provider") != UNPRICED_PROVIDER) & (F.col("price") > 0), F.col("price"))
    return row_numbers(
        visible, [key], [value.asc_nulls_last(), *map(F.col, PLACE)], "place")


def primary_offer(visible: DataFrame, key: str) -> DataFrame:
    """The base provider's offer if visible, else the first one."""
    order = F.struct(F.col("provider") != BASE_PROVIDER, *PLACE)
    best = F.min_by(F.struct("provider", "label", "price", "url"), order)
    return visible.groupBy(key).agg(best.alias("_o")).select(key, "_o.*")


def offer_summary(offers: DataFrame, key: str) -> DataFrame:
    """Per product a map of provider to offer count and distinct statuses.

    Counted per status first, so a hot product reaches the second step with
    one row per provider and status.
    """
    unknown = F.lit("unknown")
    by_status = (
        offers.groupBy(key, F.coalesce("provider", unknown).alias("provider"),
                       F.coalesce("match_status", unknown).alias("status"))
        .agg(F.count("*").alias("n"))
    )
    by_provider = by_status.groupBy(key, "provider").agg(
        F.sum("n").alias("count"), F.array_sort(F.collect_set("status")).alias("statuses"))
    return by_provider.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(
        "provider", F.struct("count", "statuses")))).alias("offer_summary"))


# -- changes -----------------------------------------------------------------

_FIELDS = ["price", "rating", "review_count", "image_url", "available"]


def upsert_offers(current: DataFrame, incoming: DataFrame, key: list[str], carry: tuple[str, ...] = ()) -> DataFrame:
    """Merge incoming offers into the current ones; ``carry`` names columns that an inserted offer brings and others keep.

    Of several offers of one key and provider the first one, by ``pos`` where the table has it, else by
    its values, takes part on either side; other current offers pass through unchanged.

    ``current``: key, provider, label, url, match_status, price, rating,
    review_count, image_url, available, updated_at, catalogue_id.
    ``incoming``: the same without status, plus ``verified``, ``strict`` and
    ``force``.  Adds ``changed`` and the ``reason`` of a skipped change.
    """
    keys = [*key, "provider"]
    names = ["label", "url", "match_status", *_FIELDS, "updated_at", "catalogue_id"]
    flags = ["verified", "strict", "force"]

    def places(df: DataFrame) -> DataFrame:
        order = ["pos"] if "pos" in df.columns else [x for x in [*names, *flags] if x in df.columns]
        return df.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))

    cur = places(current).select(*keys, "_place", F.struct(*names, *carry).alias("c"))
    new = places(incoming).where("_place = 1").select(
        *keys, "_place", F.struct(*[n for n in names if n != "match_status"], *flags, *carry).alias("n"))
    # only first places meet; a later current offer finds no partner and is kept
    both = cur.join(new, [*keys, "_place"], "full_outer")
    c, n = F.col("c"), F.col("n")
    yes = {f: F.coalesce(n[f], F.lit(False)) for f in flags}
    status = F.coalesce(F.nullif(c["match_status"], F.lit("")), F.lit("matched"))
    same = c["url"].eqNullSafe(n["url"])
    action = (
        F.when(n.isNull(), "keep")
        .when(c.isNull(), "insert")
        .when(status.isin("review", "rejected"), "locked")
        .when(status == "matched", F.when(same, "refresh").when(yes["force"], "replace").otherwise("other_url"))
        .when(status == "pending", F.when(same, "refresh").when(yes["verified"], "replace")
              .otherwise("pending_other_url"))
        .otherwise("unknown_status")
    )
    a = F.col("action")
    written = a.isin("insert", "refresh", "replace")
    unpriced = F.col("provider") == UNPRICED_PROVIDER
    promoted = (a == "refresh") & (status == "pending") & yes["verified"] & yes["strict"]

    def field(name: str) -> Column:
        taken = n[name] if name == "available" else F.coalesce(n[name], c[name])
        value = F.when(a == "refresh", taken).when(written, n[name])
        return F.when(written, F.when(~unpriced, value)).otherwise(c[name]).alias(name)

    # a refreshed matched offer keeps its label, a refreshed pending one takes the new label
    relabel = a.isin("insert", "replace") | ((a == "refresh") & (status == "pending"))
    # replacing a matched offer leaves the catalogue id alone
    new_id = (a == "insert") | (written & (status == "pending") & c.isNotNull())
    return both.withColumn("action", action).select(
        *keys, "action",
        F.when(relabel, n["label"]).otherwise(c["label"]).alias("label"),
        F.when(written, n["url"]).otherwise(c["url"]).alias("url"),
        F.when(a.isin("insert", "replace"), "pending").when(promoted, "matched")
        .otherwise(c["match_status"]).alias("match_status"),
        *[field(f) for f in _FIELDS],
        F.when(written, n["updated_at"]).otherwise(c["updated_at"]).alias("updated_at"),
        F.when(new_id, F.coalesce(n["catalogue_id"], c["catalogue_id"]))
        .otherwise(c["catalogue_id"]).alias("catalogue_id"),
        *[F.when(a == "insert", n[x]).otherwise(c[x]).alias(x) for x in carry],
        written.alias("changed"),
        F.when(a == "locked", F.concat(F.lit("offer is in "), status))
        .when(a == "other_url", "matched offer keeps its link")
        .when(a == "pending_other_url", "pending offer keeps its link")
        .when(a == "unknown_status", F.concat(F.lit("unknown status "), status)).alias("reason"),
    )


def invalidate_offers(offers: DataFrame, changes: DataFrame, key: list[str], provider: str) -> DataFrame:
    """Put one provider's offers of changed products under review.

    ``changes``: key and ``notes``.  Offers in review or rejected stay as they are.
    """
    joined = offers.join(changes.select(*key, F.col("notes").alias("_notes")), key, "left")
    hit = (
        F.col("_notes").isNotNull() & (F.col("provider") == provider)
        & ~F.coalesce(F.col("match_status"), F.lit("")).isin("review", "rejected"))
    return joined.withColumns({
        "changed": hit,
        "available": F.when(hit, F.lit(False)).otherwise(F.col("available")),
        "match_notes": F.when(hit, F.col("_notes")).otherwise(F.col("match_notes")),
        "match_status": F.when(hit, "review").otherwise(F.col("match_status")),
    }).drop("_notes")


def offer_decisions(evaluated: DataFrame, existing: DataFrame, key: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """What to do with each searched product: upsert, review or nothing.

    ``evaluated``: key, query_idx, pos, url, ok, reason, strict.  Of several hits with one link the first
    counts, and the search ends with the first accepted one.  A matched offer whose link was rejected until
    then goes to review, or is replaced when another candidate was taken.  ``carry`` names columns of the
    accepted hit that come along as ``selected``.
    """
    order = [F.col("query_idx"), F.col("pos")]
    seen = first_per(evaluated, [key, "url"], order)
    place = F.struct(*order)
    matched = existing.filter(
        (F.col("provider") == "yahoo")
        & (F.coalesce(F.nullif(F.col("match_status"), F.lit("")), F.lit("matched")) == "matched")
    ).groupBy(key).agg(F.min_by("url", "pos").alias("matched_url"))
    # hits are read once; a link stands once per product, so at most one hit is the matched one
    held = ~F.col("ok") & (F.col("url") == F.col("matched_url"))
    both = seen.join(matched, key, "left").groupBy(key).agg(
        F.min_by(F.struct("url", "strict", place.alias("place"), *carry), F.when(F.col("ok"), place)).alias("_t"),
        F.max("matched_url").alias("matched_url"),
        F.max(F.when(held, F.struct(place.alias("place"), "reason"))).alias("_held"),
    ).withColumn("_t", F.when(F.col("_t.place").isNotNull(), F.col("_t")))
    both = both.withColumn("rejected_reason", F.col("_held.reason"))
    was = F.col("rejected_reason").isNotNull() & F.coalesce(F.col("_held.place") < F.col("_t.place"), F.lit(True))
    url = F.col("_t.url")
    out = both.select(
        key,
        F.when(url.isNotNull(), "upsert").when(was, "review").otherwise("none").alias("action"),
        url.alias("selected_url"),
        F.when(url.isNotNull(), F.coalesce(F.col("_t.strict"), F.lit(False))).alias("strict"),
        (was & F.coalesce(url != F.col("matched_url"), F.lit(False))).alias("force"),
        F.when(was, F.col("rejected_reason")).alias("rejected_reason"),
        *([F.struct(*[F.col(f"_t.{c}") for c in carry]).alias("selected")] if carry else []),
    )
    return out
