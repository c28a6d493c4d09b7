"""Ranking, truncation and renumbering of products per article."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.capacity import number
from ..session import cut_lineage
from .numbering import first_per, row_numbers


def parsed_unit_price(label: Column) -> Column:
    """``STRUCT<value, unit>`` for ranking: base unit, 組 counted as two 枚."""
    pattern = r"約?([\d.]+)円/(.+)"
    value = number(F.regexp_extract(F.regexp_extract(label, pattern, 1), r"^(\d*\.?\d*)", 1))
    return base_unit_price(value, F.trim(F.regexp_extract(label, pattern, 2)))


def base_unit_price(value: Column, unit: Column) -> Column:
    low = F.lower(unit)
    amount = F.when(low.isin("l", "kg"), value / 1000).when(unit == "組", value / 2).otherwise(value)
    name = (
        F.when(low.isin("ml", "l"), "mL").when(low.isin("g", "kg"), "g")
        .when(unit == "組", "枚").otherwise(unit)
    )
    return F.when((value > 0) & (unit != ""), F.struct(amount.alias("value"), name.alias("unit")))


def display_sort_value(price: Column, label: Column) -> Column:
    """Number of a unit-price text for the comparison table, NULL if not shown."""
    digits = F.regexp_replace(label, "[^0-9.]", "")
    return F.when(
        shows_unit_price(price, label),
        F.regexp_extract(digits, r"^(\d*\.?\d*)", 1).try_cast("double"))


def shows_unit_price(price: Column, label: Column) -> Column:
    return F.coalesce(
        (price > 0) & (label != "") & (label != "-") & ~label.rlike(r"^約?0(?:\.0+)?円/"), F.lit(False))


def rank_by_unit_price(df: DataFrame) -> DataFrame:
    """Renumber the products of each article by unit price.

    Input: ``article_id, orig_idx, price, review_count, unit_value, unit`` with
    the unit price in its base unit, NULL if unknown.  Inside a unit: unit
    price, price, position.  Units: more products first, then the reviews at
    the first place where two units differ, then the first price, then the
    first position.  Unknown unit prices follow in position order.

    Units of equal size are compared place by place through a join on
    (article, size, place); units stand in the order of the rows that come
    before them in these comparisons.  Missing reviews can close a circle of
    units; those stand by first price and first position, so that ranks run
    from 1 without gaps or repeats in any case.  The number of units is bounded
    by the unit vocabulary, rows are not.
    """
    known = F.col("unit_value").isNotNull()
    # parsed once, numbered once: the rows are read several times below
    parsed = cut_lineage(df.withColumn("_unit", F.when(known, F.col("unit"))))
    rows = cut_lineage(row_numbers(
        parsed, ["article_id", "_unit"],
        [F.col("unit_value").asc_nulls_last(), F.col("price").asc_nulls_last(), F.col("orig_idx")],
        "_place",
    ))
    groups = rows.groupBy("article_id", "_unit").agg(
        F.count("*").alias("_size"),
        F.min(F.when(F.col("_place") == 1, F.col("price"))).alias("_price"),
        F.min("orig_idx").alias("_first"),
    )
    named = groups.filter(F.col("_unit").isNotNull())
    a = named.select("article_id", F.col("_unit").alias("_a"), F.col("_size").alias("_as"),
                     F.col("_price").alias("_ap"), F.col("_first").alias("_af"))
    b = named.select("article_id", F.col("_unit").alias("_b"), F.col("_size").alias("_bs"),
                     F.col("_price").alias("_bp"), F.col("_first").alias("_bf"))
    pairs = a.join(b, "article_id").filter("_a <> _b")
    tied = pairs.filter("_as = _bs").select("article_id", "_a", "_b")
    place = rows.select("article_id", "_unit", "_place", "review_count")
    left = place.select("article_id", F.col("_unit").alias("_a"), "_place", F.col("review_count").alias("_ra"))
    right = place.select("article_id", F.col("_unit").alias("_b"), "_place", F.col("review_count").alias("_rb"))
    differs = (
        left.join(tied, ["article_id", "_a"]).join(right, ["article_id", "_b", "_place"])
        .filter("_ra <> _rb")
        .groupBy("article_id", "_a", "_b")
        .agg(F.min_by(F.col("_ra") > F.col("_rb"), "_place").alias("_more"))
    )
    far = F.lit(float("inf"))
    ap, bp = F.coalesce("_ap", far), F.coalesce("_bp", far)
    before = (
        F.when(F.col("_as") != F.col("_bs"), F.col("_bs") > F.col("_as"))
        .when(F.col("_more").isNotNull(), ~F.col("_more"))
        .when(ap != bp, bp < ap)
        .otherwise(F.col("_bf") < F.col("_af"))
    )
    wins = (
        pairs.join(differs, ["article_id", "_a", "_b"], "left")
        .groupBy("article_id", F.col("_a").alias("_unit"))
        .agg(F.sum(F.when(before, F.col("_bs")).otherwise(0)).alias("_after"), F.min("_as").alias("_size"),
             F.min("_ap").alias("_price"), F.min("_af").alias("_first"))
    )
    earlier = Window.partitionBy("article_id").orderBy(
        "_after", F.col("_price").asc_nulls_last(), "_first").rowsBetween(Window.unboundedPreceding, -1)
    offsets = wins.select(
        "article_id", "_unit", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"))
    unknown = (
        named.groupBy("article_id").agg(F.sum("_size").alias("_before"))
        .select("article_id", F.lit(None).cast("string").alias("_unit"), "_before")
    )
    # one row per article and unit, written so that its size is known to the join
    starts = cut_lineage(offsets.unionByName(unknown).select(
        F.col("article_id").alias("_article"), F.col("_unit").alias("_name"), "_before"))
    return (
        rows.join(starts, (rows["article_id"] == starts["_article"])
                  & rows["_unit"].eqNullSafe(starts["_name"]), "left")
        .withColumn("new_rank", (F.coalesce("_before", F.lit(0)) + F.col("_place")).cast("bigint"))
        .drop("_article", "_name", "_before", "_place", "_unit")
    )


def limit_rank(df: DataFrame, max_rank: int = 10) -> tuple[DataFrame, DataFrame]:
    """Rows up to a rank, renumbered by position, and the removed rows."""
    keep = F.coalesce(F.col("rank") <= max_rank, F.lit(False))
    kept = row_numbers(df.filter(keep), ["article_id"], [F.col("orig_idx")], "new_rank")
    return kept, df.filter(~keep)


def remove_and_renumber(df: DataFrame, removals: DataFrame) -> DataFrame:
    """Drop the first product of each requested name; an article keeps its last product.

    ``removals``: ``article_id, name``.
    """
    hit = first_per(
        df.join(removals.select("article_id", "name").distinct(), ["article_id", "name"], "left_semi"),
        ["article_id", "name"], [F.col("orig_idx")],
    ).select("article_id", "orig_idx")
    counts = df.groupBy("article_id").agg(F.count("*").alias("_n"))
    # with as many requests as products the last requested one stays
    doomed = hit.groupBy("article_id").agg(
        F.count("*").alias("_gone"), F.max("orig_idx").alias("_last"))
    spared = (
        doomed.join(counts, "article_id").filter("_gone >= _n")
        .select("article_id", F.col("_last").alias("orig_idx"))
    )
    gone = hit.join(spared, ["article_id", "orig_idx"], "left_anti")
    kept = df.join(gone, ["article_id", "orig_idx"], "left_anti")
    return row_numbers(kept, ["article_id"], [F.col("orig_idx")], "new_rank")


def comparison_sort(df: DataFrame, by: str, descending: bool, out: str = "place") -> DataFrame:
    """Place in the comparison table; unknown values come last both ways.

    ``by``: ``rank``, ``price`` (lowest visible), ``unit_price`` or ``rating``.
    """
    value = {
        "rank": F.col("rank"),
        "price": F.when(F.col("lowest_price") > 0, F.col("lowest_price")),
        "unit_price": display_sort_value(F.col("lowest_price"), F.col("unit_price_label")),
        "rating": F.coalesce(F.col("rating"), F.lit(0.0)),
    }[by]
    order = value.desc_nulls_last() if descending else value.asc_nulls_last()
    return row_numbers(df, ["article_id"], [order, F.col("orig_idx")], out)


def top_pick(df: DataFrame) -> DataFrame:
    """Per article the product with rank 1, else the first one."""
    columns = [c for c in df.columns if c != "article_id"]
    not_first = ~F.coalesce(F.col("rank") == 1, F.lit(False))
    best = F.min_by(F.struct(*columns), F.struct(not_first, F.col("orig_idx")))
    return df.groupBy("article_id").agg(best.alias("_p")).select("article_id", "_p.*")


def long_runs(df: DataFrame, key: str, order: list[Column], is_zero: Column, min_length: int = 3) -> DataFrame:
    """Runs of consecutive zero results per key, from ``min_length`` on.

    Islands are the difference of two row numbers, so no running total over a
    key is needed.
    """
    flagged = df.withColumn("_zero", is_zero)
    numbered = row_numbers(flagged, [key], order, "_all")
    zeros = row_numbers(numbered.filter("_zero"), [key], [F.col("_all")], "_nth")
    return (
        zeros.groupBy(key, (F.col("_all") - F.col("_nth")).alias("_island"))
        .agg(F.count("*").alias("run_length"), F.min("_all").cast("bigint").alias("start_pos"))
        .filter(F.col("run_length") >= min_length)
        .select(key, "start_pos", "run_length")
    )


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda x, y: x & y, conditions)
