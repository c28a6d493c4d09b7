"""Listings, lookups, feeds, related articles and site search."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, functions as F

from ..session import checked_broadcast, cut_lineage
from .numbering import first_per, row_numbers, top_per
from .phrases import first_hits, place_entries

# Shared tags by which two articles meet; sets of so many tags are made of an article's tags.
KEY_TAGS = 4


def published(articles: DataFrame) -> DataFrame:
    return articles.filter(~F.coalesce(F.col("draft"), F.lit(False)))


def article_type() -> Column:
    return F.coalesce(F.col("article_type"), F.lit("comparison"))


def list_articles(
    articles: DataFrame, products: DataFrame, offers: DataFrame, *,
    category: str | None = None, article_kind: str | None = None,
    product_count_lt: int | None = None, has_offer: bool | None = None,
    provider: str | None = None,
) -> DataFrame:
    """Articles by category, type, product count and presence of offers."""
    picked = articles.withColumn("article_type", article_type())
    if category is not None:
        picked = picked.filter(F.col("category_id") == category)
    if article_kind is not None:
        picked = picked.filter(F.col("article_type") == article_kind)
    mine = offers if provider is None else offers.filter(F.col("provider") == provider)
    offered = mine.select("orig_idx").distinct().withColumn("_has", F.lit(True))
    counts = (
        products.select("article_id", "orig_idx").join(offered, "orig_idx", "left")
        .groupBy("article_id").agg(F.count("*").alias("_n"), F.bool_or("_has").alias("_has"))
    )
    out = picked.join(counts, "article_id", "left").withColumns({
        "product_count": F.coalesce("_n", F.lit(0)),
        "has_offer": F.coalesce("_has", F.lit(False)),
    })
    if product_count_lt is not None:
        out = out.filter(F.col("product_count") < product_count_lt)
    if has_offer is not None:
        out = out.filter(F.col("has_offer") == has_offer)
    return out.drop("_n", "_has")


def product_summary(products: DataFrame, offers: DataFrame) -> DataFrame:
    """Products with offer count and review need; a missing rank is the position.

    ``orig_idx`` orders the list but need not be dense, so positions are counted.
    """
    marks = offers.groupBy("orig_idx").agg(
        F.count("*").alias("_n"),
        F.bool_or(F.coalesce(F.col("match_status").isin("review", "pending"), F.lit(False))).alias("_r"))
    placed = row_numbers(products, ["article_id"], [F.col("orig_idx")], "_pos")
    return (
        placed.join(marks, "orig_idx", "left")
        .withColumns({
            "rank": F.coalesce(F.col("rank").cast("bigint"), F.col("_pos").cast("bigint")),
            "offer_count": F.coalesce("_n", F.lit(0)),
            "needs_review": F.coalesce("_r", F.lit(False)),
        })
        .drop("_n", "_r", "_pos")
    )


def product_lookup(
    summary: DataFrame, article_id: str, rank: int | None = None, name: str | None = None
) -> DataFrame:
    """The first product of an article by rank or, without a rank, by exact name."""
    rows = summary.filter(F.col("article_id") == article_id)
    if rank is not None:
        rows = rows.filter(F.col("rank") == rank)
    elif name:
        rows = rows.filter(F.col("name") == name)
    else:
        return rows.limit(0)
    return rows.orderBy("orig_idx").limit(1)


def file_filter(df: DataFrame, column: str, wanted: str | None) -> DataFrame:
    """Keep files by name or stem, glob (``*``, ``?``) or ``/regex/flags``."""
    if not wanted:
        return df
    name = F.trim(F.regexp_extract(F.replace(F.col(column), F.lit("\\"), F.lit("/")), r"([^/]*)$", 1))
    stem = F.regexp_replace(name, r"\.md$", "")
    slash = re.fullmatch(r"/(.+)/([dgimsuvy]*)", wanted)
    if slash:
        flags = "".join(f for f in slash[2] if f in "ims")
        pattern = (f"(?{flags})" if flags else "") + slash[1]
        return df.filter(name.rlike(pattern) | stem.rlike(pattern))
    base = wanted.replace("\\", "/").rsplit("/", 1)[-1].strip()
    if "*" in base or "?" in base:
        pattern = "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in base) + "$"
        return df.filter(name.rlike(pattern) | stem.rlike(pattern))
    return df.filter((name == base) | (stem == re.sub(r"\.md$", "", base)))


def article_category(articles: DataFrame, categories: DataFrame) -> DataFrame:
    names = checked_broadcast(categories.select("category_id", F.col("name").alias("_name")))
    return articles.join(names, "category_id", "left").withColumn(
        "category_name", F.coalesce("_name", "category_id")).drop("_name")


def category_articles(articles: DataFrame, categories: DataFrame) -> DataFrame:
    """Published articles per category and type, newest first, as numbered rows.

    A category without articles stays as one row with NULLs.
    """
    kind = F.when(F.col("article_type") == "review", "review").otherwise("comparison")
    rows = published(articles).select("category_id", kind.alias("kind"), "article_id", "published_at")
    rows = row_numbers(
        rows, ["category_id", "kind"], [F.col("published_at").desc(), F.col("article_id")], "place")
    names = categories.select("category_id", "name")
    # an inner join can split a hot category; empty ones are added apart
    used = rows.select("category_id").distinct()
    empty = names.join(used, "category_id", "left_anti")
    return names.join(rows, "category_id").unionByName(empty, allowMissingColumns=True)


def popular_articles(articles: DataFrame, ids: DataFrame, n: int = 6) -> DataFrame:
    """The first ``n`` known ids of an ordered list (``pos, article_id``)."""
    return published(articles).join(ids, "article_id").orderBy("pos").limit(n)


def newest_articles(articles: DataFrame, n: int, by_update: bool = False) -> DataFrame:
    day = F.coalesce("updated_at", "published_at") if by_update else F.col("published_at")
    return published(articles).orderBy(day.desc(), "article_id").limit(n)


def article_feed(articles: DataFrame, base: str) -> DataFrame:
    """Title, day and link of published articles; the writer orders by ``published_at``."""
    return published(articles).select(
        "title", "published_at", F.concat(F.lit(f"{base}/articles/"), "article_id", F.lit("/")).alias("link"))


def categories_in_order(categories: DataFrame, n: int = 18) -> DataFrame:
    return categories.orderBy("sort_order", "category_id").limit(n)


def _by_rarity(base: DataFrame) -> DataFrame:
    """Articles of more than ``KEY_TAGS`` tags, these in one global order, the tags of fewest articles first."""
    tags = base.select("article_id", F.explode("tags").alias("tag"))
    wide = base.where(F.size("tags") > KEY_TAGS)
    held = wide.select("article_id", F.explode("tags").alias("tag")).join(tags.groupBy("tag").agg(F.count("*").alias("_df")), "tag")
    ordered = held.groupBy("article_id").agg(F.sort_array(F.collect_list(F.struct("_df", "tag"))).alias("_t"))
    return wide.drop("tags").join(ordered, "article_id").withColumn("tags", F.transform("_t", lambda t: t["tag"])).drop("_t")


def _tag_keys(tags: Column) -> Column:
    """All sets of one to ``KEY_TAGS`` of the ordered tags, as joined text."""
    grown = F.aggregate(
        tags, F.array(F.array().cast("array<string>")),
        lambda acc, tag: F.concat(acc, F.transform(
            F.filter(acc, lambda s: F.size(s) < KEY_TAGS), lambda s: F.array_append(s, tag))))
    return F.transform(F.filter(grown, lambda s: F.size(s) > 0), lambda s: F.struct(
        F.array_join(s, "\u0001").alias("key"), F.size(s).alias("_size")))


def _most_shared(base: DataFrame, asking: DataFrame, n: int) -> DataFrame:
    """For each asking article (``of``) rows that hold its ``n`` best of other categories: most shared tags, then newest.

    A pair meets at one key alone: its shared tags, the ``KEY_TAGS`` rarest of them if there are more.  Each set
    of up to ``KEY_TAGS`` tags keeps its newest holders; who shares just that set and is not among them is
    outranked by ``n`` of them.  So sets that most articles hold make no pairs.  Partners of more shared tags are
    met at their key in full, but only such as share at least as many tags as the n-th best found so far.
    """
    newest = [F.col("published_at").desc(), F.col("article_id")]

    def sides(ordered: DataFrame) -> tuple[DataFrame, DataFrame]:
        keys = F.inline(_tag_keys(F.col("tags")))
        theirs = ordered.select("article_id", F.col("category_id").alias("_cat"), "published_at", F.col("tags").alias("_theirs"), keys)
        mine = ordered.join(asking.select("article_id"), "article_id", "left_semi").select(
            F.col("article_id").alias("of"), "category_id", F.col("tags").alias("_mine"), keys)
        return mine, theirs

    shared = F.array_intersect("_mine", "_theirs")
    # a key holds shared tags only, so one of as many tags as are shared is the pair's own
    own = F.when(F.col("_n") > KEY_TAGS, F.array_join(F.slice(shared, 1, KEY_TAGS), "\u0001") == F.col("key")).otherwise(
        F.col("_n") == F.col("_size"))

    def found(rows: DataFrame) -> DataFrame:
        other = rows.where(F.col("category_id") != F.col("_cat")).withColumn("_n", F.size(shared))
        return other.where(own).select("of", "article_id", "published_at", F.col("_n").alias("overlap"))

    # up to n members of the own category may have to be skipped
    mine, theirs = sides(base)
    seeds = found(mine.join(top_per(theirs, ["key"], newest, 2 * n).drop("_size"), "key"))
    if base.where(F.size("tags") > KEY_TAGS).isEmpty():
        return seeds
    seeds = cut_lineage(seeds)
    floor = top_per(seeds, ["of"], [F.col("overlap").desc(), *newest], n, "_nth").where(F.col("_nth") == n).select(
        "of", F.col("overlap").alias("_floor"))
    mine, theirs = (x.where(F.col("_size") == KEY_TAGS) for x in sides(cut_lineage(_by_rarity(base))))
    more = found(mine.join(theirs.drop("_size"), "key")).where(F.col("overlap") > KEY_TAGS)
    more = more.join(floor, "of", "left").where("overlap >= coalesce(_floor, 0)").drop("_floor")
    return seeds.unionByName(more).distinct()


def related_articles(articles: DataFrame, n: int = 3) -> DataFrame:
    """The ``n`` related articles of each published article.

    Same category first (newest), then by number of shared tags, then newest
    overall.  No pair list is built: a category contributes its ``n + 1`` newest
    articles, and only articles of categories with at most ``n`` members need
    tags (``_most_shared``).
    """
    base = published(articles).select(
        "article_id", "category_id", "published_at",
        F.array_sort(F.array_distinct(F.coalesce("tags", F.array().cast("array<string>")))).alias("tags"))
    newest = [F.col("published_at").desc(), F.col("article_id")]
    mine = base.select(F.col("article_id").alias("of"), "category_id")
    peers = top_per(base.drop("tags"), ["category_id"], newest, n + 1)
    same = mine.join(peers, "category_id").filter(F.col("of") != F.col("article_id")).select(
        "of", "article_id", "published_at", F.lit(1).alias("tier"), F.lit(0).alias("overlap"))

    small = base.groupBy("category_id").agg(F.count("*").alias("_n")).filter(F.col("_n") <= n)
    needy = base.join(small.drop("_n"), "category_id", "left_semi")
    tagged = _most_shared(base, needy, n).withColumn("tier", F.lit(2))
    # the newest few of all: own category and tag hits may take up to 2n of them
    latest = base.select("article_id", F.col("category_id").alias("_cat"), "published_at").orderBy(
        *newest).limit(3 * n)
    listed = F.from_json(
        F.lit(json.dumps([json.loads(r) for r in latest.toJSON().collect()])),
        "array<struct<article_id:string,_cat:string,published_at:date>>")
    fallback = needy.select(
        F.col("article_id").alias("of"), "category_id", F.inline(listed)
    ).filter(F.col("category_id") != F.col("_cat")).select(
        "of", "article_id", "published_at", F.lit(3).alias("tier"), F.lit(0).alias("overlap"))

    best = [F.col("tier"), F.col("overlap").desc(), *newest]
    options = first_per(same.unionByName(tagged).unionByName(fallback), ["of", "article_id"], best)
    return top_per(options, ["of"], best, n, "place").select(
        F.col("of").alias("article_id"), "place", F.col("article_id").alias("related_id"))


def search_entries(articles: DataFrame, products: DataFrame, categories: DataFrame) -> DataFrame:
    """The search text of each article, entry by entry: ``article_id, field, place, text``.

    In order: title, description, category, tags, all product names, all brands.  An article's entries stay
    rows, however many products it has.
    """
    named = article_category(articles, categories)
    heads = F.concat(
        F.array(*[F.struct(F.lit(name).alias("field"), F.col(c).alias("text")) for name, c in (
            ("1 title", "title"), ("2 description", "description"), ("3 category", "category_name"))]),
        F.transform(F.coalesce("tags", F.array().cast("array<string>")),
                    lambda t: F.struct(F.lit("4 tag").alias("field"), t.alias("text"))))
    head_rows = named.select("article_id", F.posexplode(heads).alias("place", "e")).select(
        "article_id", "e.field", F.col("place").cast("long").alias("place"), "e.text")
    product_rows = products.select("article_id", F.col("orig_idx").cast("long").alias("place"), F.inline(F.array(
        F.struct(F.lit("5 name").alias("field"), F.col("name").alias("text")),
        F.struct(F.lit("6 brand").alias("field"), F.col("brand").alias("text")))))
    known = product_rows.join(articles.select("article_id").distinct(), "article_id", "left_semi")
    return head_rows.unionByName(known)


def placed_entries(entries: DataFrame) -> DataFrame:
    """Entries with their place in the article's text; null and empty ones are left out."""
    return place_entries(entries, "article_id", [F.col("field"), F.col("place"), F.col("text")])


def article_hits(placed: DataFrame, index: DataFrame, query: str) -> DataFrame:
    """One row per article whose text holds the query: how often, where first, and the entry it begins in."""
    return first_hits(placed, index, "article_id", query)


def search_products(products: DataFrame, articles: DataFrame, categories: DataFrame) -> DataFrame:
    """Search rows of products; empty parts are left out of the keyword text."""
    heads = article_category(articles, categories).select("article_id", "title", "category_name")

    def part(name: str) -> Column:
        return F.nullif(F.col(name), F.lit(""))

    advice = [part("recommended_for")] if "recommended_for" in products.columns else []
    return products.join(heads, "article_id").withColumn(
        "keywords",
        F.concat_ws(" ", part("name"), part("brand"), part("capacity"), part("price_per_unit"),
                    "category_name", "features", *advice))


def product_hits(rows: DataFrame, query: str, n: int = 30) -> DataFrame:
    """The first ``n`` products that match, in article and list order."""
    return matching(rows, query).orderBy("article_id", "orig_idx").limit(n)


def matching(rows: DataFrame, query: str) -> DataFrame:
    """Rows whose keyword text holds the query; an empty query finds nothing."""
    wanted = query.strip().lower()
    if not wanted:
        return rows.limit(0)
    return rows.filter(F.contains(F.lower("keywords"), F.lit(wanted)))
