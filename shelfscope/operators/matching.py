"""Matching of marketplace candidates to catalogue products."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import capacity as C
from ..functions import names as N
from ..functions import text as T
from ..functions import urls as U
from ..functions.arrow import nfkc_lower, with_nfkc_lower
from ..functions.patterns import TIMES, WS, WS_SET
from .numbering import first_per, top_per

_SEP = "\u0001"


# -- landed search hits ------------------------------------------------------

# Donation listings
_DONATION_SHOP = r"/f\d{4,}-[a-z]"
_DONATION_NAME = "ふるさと納税|ふるさと|寄付|寄附|返礼品"
_DONATION_SHOP_NAME = "ふるさと納税|furusato"


def is_regular() -> Column:
    """Not a donation listing, by shop link, item name and shop name."""
    blank = F.lit("")

    def found(column: str, pattern: str) -> Column:
        return F.coalesce(F.col(column), blank).rlike(pattern)

    return ~(
        found("shop_url", _DONATION_SHOP) | found("item_url", _DONATION_SHOP)
        | found("name", _DONATION_NAME) | found("shop_name", _DONATION_SHOP_NAME))


def regular_listings(hits: DataFrame) -> DataFrame:
    """Drop donation listings."""
    return hits.filter(is_regular())


def first_hits(products: DataFrame, hits: DataFrame, key: str) -> DataFrame:
    """First regular hit per product; ``status`` says why there is none."""
    any_hit = hits.groupBy(key).agg(F.count("*").alias("_n"))
    fields = [c for c in hits.columns if c != key]
    best = regular_listings(hits).groupBy(key).agg(F.min_by(F.struct(*fields), "pos").alias("hit"))
    return (
        products.join(any_hit, key, "left").join(best, key, "left")
        .withColumn("status", F.when(F.col("hit").isNotNull(), "found")
                    .when(F.col("_n") > 0, "only excluded").otherwise("none found"))
        .drop("_n")
    )


def _leads_to(want: Column, column: str) -> Column:
    """A link, decoded if need be, goes to the item."""
    fragment = F.concat(F.lit("/"), want["shop"], F.lit("/"), want["item"])
    link = F.coalesce(F.try_url_decode(column), F.col(column))
    return F.coalesce(F.contains(link, F.concat(fragment, F.lit("/"))) | F.endswith(link, fragment), F.lit(False))


def found_items(wanted: DataFrame, hits: DataFrame, key: str) -> DataFrame:
    """Per product with hits: how many (``_n``), its first regular one (``_first``), its own item (``_own``).

    ``wanted``: the key and ``_want``, the item of the product's link or NULL.  Hits move once, to their product,
    by a merge join: Spark would judge them by the size of the compressed files they come from.
    """
    hit = F.struct(*[c for c in hits.columns if c != key])
    regular = is_regular()
    own = F.coalesce(regular & F.col("_want").isNotNull() & (
        _leads_to(F.col("_want"), "item_url") | _leads_to(F.col("_want"), "affiliate_url")), F.lit(False))
    marked = hits.hint("merge").join(wanted, key).select(
        key, hit.alias("_hit"), F.when(regular, F.struct("pos")).alias("_at"), F.when(own, F.struct("stage", "pos")).alias("_own_at"))
    return marked.groupBy(key).agg(
        F.count("*").alias("_n"), F.min_by("_hit", "_at").alias("_first"), F.min_by("_hit", "_own_at").alias("_own"))


def staged_lookup(products: DataFrame, hits: DataFrame, key: str) -> DataFrame:
    """The product's own item among landed searches; the earliest stage wins.

    A hit counts if its item or affiliate link leads to the product's item.
    """
    wanted = products.select(key, U.item_parts(F.col("base_url")).alias("_want")).filter("_want IS NOT NULL")
    want = F.col("_want")
    own = regular_listings(hits).join(wanted, key).filter(_leads_to(want, "item_url") | _leads_to(want, "affiliate_url"))
    fields = [c for c in hits.columns if c != key]
    return own.groupBy(key).agg(
        F.min_by(F.struct(*fields), F.struct("stage", "pos")).alias("_h")).select(key, "_h.*")


def reconcile(products: DataFrame, hits: DataFrame, key: str) -> DataFrame:
    """Each product beside its own hit, else the first hit marked as another item.

    Both joins are merge joins: hits grow with the products, but Spark would judge them by the size of the
    compressed files they are derived from and send all of them through the driver.
    """
    wanted = products.withColumn("code", U.listed_code(F.col("base_url")))
    mine = hits.select(key, "pos", F.col("name").alias("hit_name"), F.col("price").alias("hit_price"),
                       U.listed_code(F.col("item_url")).alias("_code"))
    joined = wanted.filter("code IS NOT NULL").select(key, "code").join(mine.hint("merge"), key)
    other = ~F.coalesce(F.col("_code") == F.col("code"), F.lit(False))
    best = joined.groupBy(key).agg(F.min_by(
        F.struct("hit_name", "hit_price", other.alias("_other")), F.struct(other, "pos")).alias("_b"))
    return (
        wanted.join(best.hint("merge"), key, "left")
        .withColumn("hit_name", F.when(F.col("code").isNull(), "URLエラー")
                    .otherwise(F.coalesce("_b.hit_name", F.lit("ERROR: 0件"))))
        .withColumn("hit_price", F.col("_b.hit_price"))
        .withColumn("match", F.when(F.col("_b").isNull(), "").when(F.col("_b._other"), "△(別商品)").otherwise("○"))
        .drop("_b", "code")
    )


# -- candidate evaluation ----------------------------------------------------

def prepare_products(products: DataFrame, key: str) -> DataFrame:
    """Product side: tokens, brand tokens, total and sides, once per product."""
    variants = F.transform(F.coalesce("brand_variants", F.array().cast("array<string>")), T.search_keyword)
    df = with_nfkc_lower(products.select(
        key, F.col("name").alias("p_name"), F.col("capacity").alias("p_capacity"),
        F.nullif("brand", F.lit("")).alias("p_brand"), F.col("brand").alias("_brand"), "brand_variants", "base_url",
    ), {
        "_kw": T.search_keyword(F.col("p_name")), "_b1": T.search_keyword(F.col("_brand")),
        "_b2": F.col("_brand"), "_b3": F.array_join(variants, _SEP), "_size": F.col("p_capacity"),
    })
    df = C.with_norm(df, "p_capacity", "p_norm")
    long_enough = [
        F.filter(F.transform(F.regexp_extract_all("_b2", F.lit(r"\(([^)]+)\)"), 1), N.trimmed),
                 lambda a: (F.length(a) >= 2) & ~a.eqNullSafe(F.col("_b1"))),
        F.filter(F.split("_b3", _SEP), lambda v: F.length(v) >= 2),
    ]
    none = F.array().cast("array<string>")
    primary = F.when(F.col("_b1") != "", F.array("_b1")).otherwise(none)
    return df.select(
        key, "p_name", "p_capacity", "p_brand", "p_norm", "base_url",
        T.name_tokens(F.col("_kw")).alias("tokens"),
        F.concat(primary, *[F.coalesce(x, none) for x in long_enough]).alias("brand_tokens"),
        F.coalesce(F.filter(F.split("_b1", rf"[{WS_SET}・_\-]+"), lambda t: F.length(t) >= 2), none)
        .alias("brand_parts"),
        T.single_item_sides(F.col("_size"), True).alias("p_sides"), U.base_item_code(F.col("base_url")).alias("p_code"),
    )


def prepare_candidates(candidates: DataFrame) -> DataFrame:
    """Candidate side: composed text, size, link multiplier, once per row."""
    df = N.with_name_capacity(candidates, "name", "found")
    df = C.with_total(df, "found", "_raw").withColumns({
        "text": nfkc_lower(F.col("name")), "times": U.quantity_multiplier(F.col("url")),
        "c_code": U.offer_item_code(F.col("url"))})
    held = F.array_contains(
        F.regexp_extract_all("found", F.lit(rf"[{TIMES}]{WS}*(\d+)"), 1), F.col("times").cast("string"))
    scaled = F.when((F.col("times") > 1) & ~held, C.size(
        F.col("_raw.total") * F.col("times"), F.col("_raw.unit"))).otherwise(F.col("_raw"))
    df = df.withColumns({"_eff": F.when(F.col("_raw").isNotNull(), scaled), "_held": held})
    text = F.when((F.col("times") > 1) & ~F.col("_held") & F.col("_raw").isNotNull(), F.concat(
        C.plain_number(F.col("_eff.total")), F.col("_eff.unit"))).otherwise(F.col("found"))
    return df.withColumns({
        "c_norm": C.normalized(F.col("_eff")), "effective": text,
        "c_sides": T.single_item_sides(F.col("text"), False),
    }).drop("_raw", "_eff", "_held")


def match_candidates(products: DataFrame, candidates: DataFrame, key: str) -> DataFrame:
    """Candidates of a product's own searches whose name may be the product's.

    Candidates come with the query they were found by, so the name test runs
    on an equi-join; nothing is compared across queries.
    """
    df = prepare_products(products, key).join(
        candidates.withColumn("text", nfkc_lower(F.col("name"))), key)
    return df.filter(T.likely_same(F.col("tokens"), F.col("text")))


def brand_checks(tokens: Column, brand_tokens: Column, brand_parts: Column, text: Column) -> dict[str, Column]:
    """``all_tokens``, ``brand`` and ``distinctive`` checks on a joined pair."""
    def variant_hit(token: Column) -> Column:
        hit = F.lit(False)
        for word, others in T.SPELLING_VARIANTS.items():
            for other in others:
                hit = hit | ((token == word) & F.contains(text, F.lit(other)))
        return hit

    generic = F.array(*map(F.lit, T.GENERIC_PRODUCT_TOKENS))
    return {
        "all_tokens": (F.size(tokens) > 0) & F.forall(
            tokens, lambda t: F.contains(text, t) | variant_hit(t)),
        "brand": (F.size(brand_tokens) == 0) | F.exists(brand_tokens, lambda t: F.contains(text, t))
        | ((F.size(brand_parts) > 1) & F.forall(brand_parts, lambda t: F.contains(text, t))),
        "distinctive": F.exists(tokens, lambda t: (F.length(t) >= 6) & ~F.array_contains(generic, t)
                                & F.contains(text, t)),
    }


def evaluate_candidates(products: DataFrame, candidates: DataFrame, key: str) -> DataFrame:
    """Verdict on each candidate: ``ok, reason, strict`` and what led to it."""
    df = prepare_products(products, key).join(prepare_candidates(candidates), key)
    checks = brand_checks(F.col("tokens"), F.col("brand_tokens"), F.col("brand_parts"), F.col("text"))
    df = df.withColumns({
        "likely": T.likely_same(F.col("tokens"), F.col("text")),
        "same_sides": F.coalesce(
            (F.col("times") == 1) & (F.col("p_sides") == F.col("c_sides")), F.lit(False)),
        "same_size": C.same_total(F.col("p_norm"), F.col("c_norm")),
        "url_identity": U.is_same_code(F.col("p_code"), F.col("c_code")),
        **{f"_{k}": v for k, v in checks.items()},
    })
    no_size = F.coalesce(F.col("p_capacity") == "", F.lit(True))
    reason = (
        F.when(~F.col("likely"), "商品名トークン不一致")
        .when(no_size, "既存capacityなし")
        .when(F.col("found").isNull() & ~F.col("same_sides"), "Yahoo候補からcapacity抽出不可")
        .when(F.col("same_sides") | F.col("same_size"), "capacity一致")
        .when(F.col("times") > 1, F.concat(
            F.lit("capacity不一致（URL倍率×"), F.col("times").cast("string"), F.lit("考慮: "),
            F.coalesce("effective", F.lit("null")), F.lit(" vs "), "p_capacity", F.lit("）")))
        .otherwise("capacity不一致")
    )
    df = df.withColumn("reason", reason).withColumn("ok", F.col("reason") == "capacity一致")
    proven = F.col("_brand") | F.col("_distinctive") | F.col("url_identity")
    unproven = F.col("ok") & F.col("_all_tokens") & ~proven
    return df.withColumns({
        "strict": F.when(F.col("ok"), F.col("_all_tokens") & proven),
        "brand_match": F.when(F.col("ok"), F.col("_brand")),
        "alias_suggestions": F.when(
            unproven, T.alias_suggestions(F.col("p_name"), F.col("p_brand"), F.col("name"))),
    })


def first_accepted(evaluated: DataFrame, key: str) -> DataFrame:
    """First accepted candidate in query order, one per link considered."""
    order = F.struct("query_idx", "pos")
    seen = first_per(evaluated, [key, "url"], [F.col("query_idx"), F.col("pos")])
    best = F.min_by(F.struct("query_idx", "pos", "name", "url", "strict"), order)
    return seen.filter("ok").groupBy(key).agg(best.alias("_b")).select(key, "_b.*")


# -- other listings ----------------------------------------------------------

def replacement_candidates(products: DataFrame, hits: DataFrame, key: str, times: int) -> DataFrame:
    """First hits of another item with at least ``times`` the reviews.

    Without current reviews any reviewed hit counts.
    """
    found = first_hits(products, hits, key).filter("hit IS NOT NULL")
    now, then = F.coalesce("review_count", F.lit(0)), F.coalesce("hit.review_count", F.lit(0))
    same = F.coalesce(
        U.direct_item_url(F.col("base_url")) == U.direct_item_url(F.col("hit.item_url")), F.lit(False))
    more = F.when(now > 0, then >= now * times).otherwise(then > 0)
    return found.filter(~same & more)


def match_queue(failed: DataFrame, hits: DataFrame, key: str, n: int = 10) -> DataFrame:
    """Up to ``n`` distinct candidates per failed product, in keyword order."""
    direct = F.coalesce(
        U.direct_item_url(F.col("item_url")), U.direct_item_url(F.col("affiliate_url")), F.col("item_url"))
    rows = (
        regular_listings(hits).join(failed.select(key), key, "left_semi")
        .withColumn("direct_url", direct)
        .withColumn("_dedupe", F.coalesce("direct_url", "affiliate_url", "name"))
        .filter("_dedupe <> ''")
    )
    order = [F.col("stage"), F.col("pos")]
    distinct = first_per(rows, [key, "_dedupe"], order)
    return N.with_name_capacity(top_per(distinct, [key], order, n, "place"), "name", "found").drop("_dedupe")


