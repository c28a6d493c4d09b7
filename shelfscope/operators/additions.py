"""Addition report: rules, filters, scores and picks for articles below a target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import capacity as C
from ..functions import names as N
from ..functions import urls as U
from ..functions.arrow import nfkc_lower
from ..functions.text import unique_texts
from ..session import checked_broadcast, cut_lineage
from .same_products import same_product
from .numbering import first_per, top_per

_SEP = "\u0001"
# Words no added product may carry.
DEFAULT_EXCLUDE = ["ケースのみ", "ホルダー", "スタンド", "収納", "詰め替え容器", "ディスペンサー"]


def _texts(values: Column) -> Column:
    return F.coalesce(values, F.array().cast("array<string>"))


def rules_for(articles: DataFrame, rules: DataFrame) -> DataFrame:
    """Search rule per article: the first fitting rule by priority, else the default.

    ``articles``: article_id, category_id, keyword.  ``rules``: priority,
    category_id, keyword_regex, keywords, include, exclude, required_groups,
    units, min_score, require_include.  A rule with a ``keyword_regex`` fits
    only articles whose keyword matches.
    """
    r = checked_broadcast(rules.withColumnRenamed("category_id", "_cat"))
    fits = (articles["category_id"] == r["_cat"]) & (
        r["keyword_regex"].isNull() | F.regexp_like(articles["keyword"], r["keyword_regex"]))
    picked = first_per(articles.join(r, fits, "left"), ["article_id"], [F.col("priority").asc_nulls_last()])
    kw = F.col("keyword")
    options = F.concat(_texts(F.col("keywords")), F.array(
        kw, F.concat(kw, F.lit(" 大容量")), F.concat(kw, F.lit(" まとめ買い"))))
    return picked.select(
        "article_id", "category_id", "keyword", "priority",
        F.slice(unique_texts(options), 1, 3).alias("keywords"),
        F.coalesce("include", F.array("keyword")).alias("include"),
        F.concat(F.array(*map(F.lit, DEFAULT_EXCLUDE)), _texts(F.col("exclude"))).alias("exclude"),
        F.coalesce("required_groups", F.array().cast("array<array<string>>")).alias("required_groups"),
        "units", F.coalesce("min_score", F.lit(4)).alias("min_score"),
        F.coalesce("require_include", F.lit(True)).alias("require_include"),
    )


def composed_rules(rules: DataFrame) -> DataFrame:
    """Add the NFKC lower-case forms of the rule words as ``c_...`` columns."""
    joined = F.transform("required_groups", lambda g: F.array_join(g, "\u0002"))
    df = rules.withColumns({
        "_i": nfkc_lower(F.array_join("include", _SEP)), "_e": nfkc_lower(F.array_join("exclude", _SEP)),
        "_g": nfkc_lower(F.array_join(joined, _SEP))})

    def words(column: str, sep: str = _SEP) -> Column:
        return F.filter(F.split(column, sep), lambda w: w != "")

    return df.withColumns({
        "c_include": words("_i"), "c_exclude": words("_e"),
        "c_groups": F.transform(words("_g"), lambda g: F.split(g, "\u0002")),
    }).drop("_i", "_e", "_g")


def _hits(terms: str, text: Column) -> Column:
    return F.filter(F.col(terms), lambda t: F.contains(text, t))


def _group_hits(text: Column) -> Column:
    return F.filter("c_groups", lambda g: F.exists(g, lambda t: F.contains(text, t)))


def category_verdict(text: Column) -> Column:
    """Why a candidate does not belong to the category, NULL if it does."""
    missing = F.get(F.filter("c_groups", lambda g: ~F.exists(g, lambda t: F.contains(text, t))), F.lit(0))
    return (
        F.when(F.size(_hits("c_exclude", text)) > 0, F.concat(
            F.lit("除外語: "), F.array_join(F.slice(_hits("c_exclude", text), 1, 3), ", ")))
        .when(missing.isNotNull(), F.concat(
            F.lit("必須語なし: "), F.array_join(F.slice(missing, 1, 3), "/")))
        .when(F.col("require_include") & (F.size(_hits("c_include", text)) == 0), "カテゴリ語なし")
    )


def score(text: Column) -> Column:
    """Points for category and required words, price, reviews and rating."""
    include = F.size(_hits("c_include", text))
    reviews, rating = F.coalesce("review_count", F.lit(0)), F.coalesce("rating", F.lit(0.0))
    return (
        F.when(include > 0, 3 + F.least(include - 1, F.lit(2))).otherwise(0)
        + 2 * F.size(_group_hits(text)) - 4 * F.size(_hits("c_exclude", text))
        + F.when(F.col("price").isNotNull(), 1).otherwise(0)
        + F.when(reviews >= 1000, 3).when(reviews >= 300, 2).when(reviews >= 50, 1).otherwise(0)
        + F.when(rating >= 4.5, 2).when(rating >= 4.0, 1).otherwise(0)
    )


def allowed_unit(total: Column) -> Column:
    return F.col("units").isNull() | F.coalesce(
        F.array_contains(F.transform("units", F.lower), F.lower(total["unit"])), F.lit(False))


def judge_candidates(
    candidates: DataFrame, rules: DataFrame, products: DataFrame, deletions: DataFrame, as_of: Column,
    recent_days: int = 7,
) -> DataFrame:
    """Each distinct candidate of an article with the first reason to leave it out.

    ``candidates``: article_id, row_id, query_idx, pos, name, price,
    review_count, rating, item_url.  Reasons in order: no link, already listed,
    recently deleted, outside the category, unit not compared, the same product
    under another link, score below the rule's minimum.
    """
    df = candidates.withColumn("direct_url", U.direct_item_url(F.col("item_url")))
    df = df.withColumn("_dedupe", F.coalesce("direct_url", "name"))
    df = first_per(df, ["article_id", "_dedupe"], [F.col("query_idx"), F.col("pos")]).drop("_dedupe")

    listed = products.select(
        "article_id", U.direct_item_url(F.col("base_url")).alias("direct_url")
    ).filter("direct_url IS NOT NULL").distinct().withColumn("_listed", F.lit(True))
    days = F.datediff(as_of, F.col("deleted_at"))
    gone = deletions.filter(days.between(0, recent_days)).groupBy("article_id", "direct_url").agg(
        F.max("deleted_at").alias("_deleted"))
    # merge joins: both grow with the catalogue, and Spark would size their links by compressed files
    link = ["article_id", "direct_url"]
    df = df.join(listed.hint("merge"), link, "left").join(gone.hint("merge"), link, "left")

    rule = composed_rules(rules).select(
        "article_id", "c_include", "c_exclude", "c_groups", "units", "min_score", "require_include")
    df = N.with_name_capacity(df, "name", "capacity").withColumn("text", nfkc_lower(F.col("name")))
    df = C.with_total(df, "capacity", "total").join(rule, "article_id")
    text = F.col("text")
    early = (
        F.when(F.col("direct_url").isNull(), "URL取得不可")
        .when(F.col("_listed"), "既存URL重複")
        .when(F.col("_deleted").isNotNull(), "直近削除履歴")
        .when(F.col("_verdict").isNotNull(), F.concat(F.lit("カテゴリ外（"), "_verdict", F.lit("）")))
        .when(F.col("capacity").isNotNull() & ~allowed_unit(F.col("total")), "比較対象外の容量単位")
    )
    df = df.withColumns({"_verdict": category_verdict(text), "score": score(text)}).withColumn("_early", early)
    columns = ["article_id", "row_id", "query_idx", "pos", "name", "price", "review_count", "rating",
               "direct_url", "capacity", "total", "score", "min_score", "_early"]
    # the filters feed the same-product check and the result: parse names once
    df = cut_lineage(df.select(*columns))
    own = C.with_total(
        N.with_name_capacity(products, "name", "_inside").withColumn(
            "_size", F.coalesce(F.nullif("capacity", F.lit("-")), F.col("_inside"))), "_size", "total")
    covered = same_product(
        df.filter("_early IS NULL").select("article_id", "row_id", "name", "total"),
        own.select("article_id", "name", "total"), "article_id", "row_id").withColumn("_covered", F.lit(True))
    reason = (
        F.when(F.col("_early").isNotNull(), F.col("_early"))
        .when(F.col("_covered"), "URL違い同一商品")
        .when(F.col("score") < F.col("min_score"), "スコア不足")
    )
    return df.join(covered.hint("merge"), "row_id", "left").withColumn("reason", reason).drop("_early", "_covered", "min_score")


def suggestions(judged: DataFrame, products: DataFrame, target: int = 10) -> DataFrame:
    """Best candidates up to the target count; without a size only to fill up."""
    have = products.groupBy("article_id").agg(F.count("*").alias("_n"))
    order = [
        F.col("capacity").isNull(), F.col("score").desc(),
        F.coalesce("review_count", F.lit(0)).desc(), F.coalesce("rating", F.lit(0.0)).desc(),
        F.col("query_idx"), F.col("pos"), F.col("row_id"),
    ]
    best = top_per(judged.filter("reason IS NULL"), ["article_id"], order, target, "place")
    return best.join(have, "article_id", "left").filter(
        F.col("place") <= target - F.coalesce("_n", F.lit(0))).drop("_n")


def exclusion_stats(judged: DataFrame) -> DataFrame:
    return judged.filter("reason IS NOT NULL").groupBy("article_id", "reason").agg(F.count("*").alias("n"))


def exclusion_samples(judged: DataFrame, n: int = 20) -> DataFrame:
    return top_per(judged.filter("reason IS NOT NULL"), ["article_id"],
                   [F.col("query_idx"), F.col("pos"), F.col("row_id")], n, "place")


def refill(articles: DataFrame, deletions: DataFrame, day: Column) -> DataFrame:
    """Articles that lost a product on a day, for another addition report."""
    lost = deletions.filter(F.col("deleted_at") == day).select("article_id").distinct()
    return articles.join(lost, "article_id", "left_semi")
