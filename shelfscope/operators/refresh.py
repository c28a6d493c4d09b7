"""Price refresh: field decisions, unit prices, ranking, limits, titles and names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import capacity as C
from ..functions import names as N
from ..functions.text import with_count
from ..session import cut_lineage
from . import ranking as R


def sync_unit_prices(df: DataFrame, target_unit: Column | None, skip: Column) -> DataFrame:
    """Recompute unit-price texts; skipped and unreadable rows keep theirs."""
    df = C.with_unit_price(C.with_total(df, "capacity", "_size"), "price", "_size", "_ppu", target_unit)
    old = F.col("price_per_unit")
    new = F.when(~F.coalesce(skip, F.lit(False)), F.col("_ppu.label"))
    return df.withColumns({
        "price_per_unit": F.coalesce(new, old), "unit_price_changed": new.isNotNull() & ~new.eqNullSafe(old),
    }).drop("_size", "_ppu")


_TEXTS = ["item_name", "name", "capacity"]


def read_sizes(texts: DataFrame) -> DataFrame:
    """All that the size rules take from the texts alone: sizes read, compared and respelled.

    ``texts``: item_name, name, capacity.  What the rules do not show has a leading underscore.
    """
    df = N.with_capacity_analysis(texts, "item_name")
    df = N.with_name_capacity(df, "name", "_inside")
    df = C.with_total(C.with_norm(df, "_inside", "_inside_norm"), "capacity", "_old")
    c, no = F.col, F.lit(False)
    df = df.withColumn("_old_norm", C.normalized(c("_old")))
    # the stored spelling of the same unit is kept
    respelled = F.when(
        F.lower("_old.unit") == F.lower("found_total.unit"),
        F.replace(c("found"), c("found_total.unit"), c("_old.unit"))).otherwise(c("found"))
    df = C.settled(df, {
        "_has": (c("capacity") != "") & c("found").isNotNull(),
        "_choice": F.coalesce(C.is_multi_measure(c("item_name")) | C.is_count_choice(c("item_name")), no),
        "_conflict": c("_inside").isNotNull() & C.same_total(c("_old_norm"), c("_inside_norm"))
        & ~C.same_total(c("_old_norm"), c("found_norm")),
        "_merged": C.merged_quantity(c("capacity"), c("found"), c("found_total")),
        "_same_unit": F.coalesce(F.lower("_old_norm.unit") == F.lower("found_norm.unit"), no),
        "_differs": F.coalesce(c("_old_norm.total") != c("found_norm.total"), no),
        "_counted": C.is_sales_quantity(c("capacity"), c("_old")) & C.is_sales_quantity(c("found"), c("found_total")),
        "_same_piece": C.same_measure_base(c("capacity"), c("found")),
        "_keeps_measure": C.has_measure(c("capacity")) & C.is_sales_quantity(c("found"), c("found_total")),
        "_misread": C.is_likely_misread(c("item_name"), c("found"), c("found_total")),
        "_respelled": respelled,
    })
    df = C.with_total(C.with_total(df, "_merged", "_merged_total"), "_respelled", "_respelled_total")
    return df.drop("_inside", "_inside_norm", "auto_update")


def with_read_sizes(df: DataFrame) -> DataFrame:
    """Rows beside what ``read_sizes`` takes from their texts; each set of texts is read once.

    Reading a text costs far more than moving it, so the texts are dealt out by number, not by their bytes.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    read = read_sizes(df.select(*_TEXTS).distinct().repartition(tasks, *_TEXTS))
    read = read.withColumnsRenamed({t: f"_{t}_read" for t in _TEXTS})
    same = reduce(lambda a, b: a & b, [df[t].eqNullSafe(read[f"_{t}_read"]) for t in _TEXTS])
    return df.join(read.hint("merge"), same).drop(*[f"_{t}_read" for t in _TEXTS])


def decide_fields(df: DataFrame, target_unit: Column | None = None, auto_apply_size: bool = False) -> DataFrame:
    """New size, price and unit price of products beside their landed item.

    Input: name, capacity, price, price_per_unit, ``item_name``, ``item_price``,
    ``exact`` (found under its own link) and ``frozen`` (decided before).  The
    first rule that fits is named in ``rule``.  A doubtful or different size
    goes to review and the stored one stays, unless ``auto_apply_size``.  The
    rows are read twice, so they should be cheap to make.
    """
    df = with_read_sizes(df)
    c = F.col
    yes, no = F.lit(True), F.lit(False)
    exact = F.coalesce("exact", no)
    has = c("_has")
    df = df.withColumns({
        "variants": F.coalesce(c("_choice") | (exact & has & c("_conflict")), no),
        "_merged": F.when(exact & has, c("_merged")),
    })
    rule = (
        F.when(F.coalesce("frozen", no), "frozen")
        .when(c("variants"), "variants")
        .when(c("found").isNull(), "no_size")
        .when(~has | ~exact, "keep")
        .when(c("_merged").isNotNull(), F.when(c("_merged") != c("capacity"), "new_count").otherwise("keep"))
        .when(c("_same_piece"), "same_piece")
        .when(c("_counted") & c("_same_unit"), F.when(c("_differs"), "count_update").otherwise("keep"))
        .when(c("_keeps_measure"), "keep_measure")
        .when(c("_misread"), "misread")
        .when(c("_same_unit"), F.when(c("_differs"), "size_update").otherwise("keep"))
        .when(c("_old").isNull() & c("found_total").isNotNull(), "replace_unreadable")
        .otherwise("keep")
    )
    takes_found = c("rule").isin("count_update", "replace_unreadable")
    df = df.withColumn("rule", rule).withColumns({
        "_proposed": F.when(c("rule") == "new_count", c("_merged")).when(c("rule") == "misread", "-")
        .when(takes_found, c("found")).when(c("rule") == "size_update", c("_respelled")),
        "_proposed_total": F.when(c("rule") == "new_count", c("_merged_total")).when(takes_found, c("found_total"))
        .when(c("rule") == "size_update", c("_respelled_total")),
    })
    df = df.withColumn("_compared", F.coalesce(C.normalized(c("_proposed_total")), c("found_norm")))
    compared = c("_compared")
    reasons = F.array_distinct(F.concat(
        F.array_compact(F.array(F.when(c("variants"), "multiple capacity variant or manual/API conflict"))),
        F.when(c("confidence") != "high", c("reasons")).otherwise(F.array().cast("array<string>")),
        F.array_compact(F.array(
            F.when(c("_old_norm").isNotNull() & compared.isNotNull() & ~C.same_total(c("_old_norm"), compared),
                   "existing capacity and API extracted capacity differ"),
            F.when(c("found").isNull() & (c("capacity") != ""),
                   "API item name has no parseable capacity; keep existing capacity"),
        )),
    ))
    frozen = c("rule") == "frozen"
    df = N.settled(df, {
        "review_reasons": F.when(~frozen, reasons).otherwise(F.array().cast("array<string>"))})
    df = df.withColumn("needs_review", F.size("review_reasons") > 0).withColumns({
        "new_capacity": F.when(yes if auto_apply_size else ~c("needs_review"), c("_proposed")),
        "blocked": c("_proposed").isNotNull() & c("needs_review") & F.lit(not auto_apply_size),
    })
    # the unit price follows the size that stays
    df = df.withColumn("_shown_total", F.when(c("new_capacity").isNull(), c("_old")).otherwise(c("_proposed_total")))
    df = C.with_unit_price(df, "item_price", "_shown_total", "_ppu", target_unit)
    df = df.withColumns({
        "new_price": F.when(~c("variants") | frozen, F.when(c("item_price").isNotNull(), c("item_price")))
        .otherwise(None),
        "new_price_per_unit": F.when(c("new_capacity") == "-", "-").when(
            c("variants") & ~frozen, c("price_per_unit")).otherwise(F.coalesce("_ppu.label", "price_per_unit")),
    })
    drop = [x for x in df.columns if x.startswith("_")]
    return df.withColumns({
        "after_price": F.coalesce("new_price", "price"),
        "after_capacity": F.coalesce("new_capacity", "capacity"),
        "after_price_per_unit": c("new_price_per_unit"),
    }).drop(*drop, "found_total")


def refresh_articles(decided: DataFrame, articles: DataFrame, max_rank: int = 10) -> dict[str, DataFrame]:
    """From decided fields to the new state: products, removed rows, titles, reviews.

    Order of passes as in a run: unit price, ranking, limit, title, names.
    """
    after = decided.withColumns({
        "price": F.col("after_price"), "capacity": F.col("after_capacity"),
        "price_per_unit": F.col("after_price_per_unit"),
    })
    synced = sync_unit_prices(after, F.col("target_unit"), F.col("variants") | F.coalesce("frozen", F.lit(False)))
    # read by the ranking, the limit and the reports
    state = cut_lineage(synced.select(
        "article_id", "orig_idx", "name", "price", "capacity", "price_per_unit", "review_count", "base_url",
        "rule", "needs_review", "blocked"))
    parsed = state.withColumn("_p", R.parsed_unit_price(F.col("price_per_unit"))).withColumns({
        "unit_value": F.col("_p.value"), "unit": F.col("_p.unit")}).drop("_p")
    ranked = R.rank_by_unit_price(parsed).withColumnRenamed("new_rank", "rank")
    kept, removed = ranked.filter(F.col("rank") <= max_rank), ranked.filter(F.col("rank") > max_rank)
    counts = kept.groupBy("article_id").agg(F.count("*").alias("_n"))
    titles = articles.join(counts, "article_id").select(
        "article_id", with_count(F.col("title"), F.col("_n")).alias("title"))
    named = N.with_name_capacity(kept, "name", "_inside")
    named = C.with_total(C.with_total(named, "_inside", "_it"), "capacity", "_ct")
    fixed = N.fixed_name(F.col("name"), F.col("_inside"), F.col("_it"), F.col("capacity"), F.col("_ct"))
    products = named.withColumn("name", F.coalesce(fixed, "name")).drop("_inside", "_it", "_ct", "unit_value", "unit")
    return {"products": products, "removed": removed, "titles": titles,
            "reviews": state.filter("needs_review")}


def run_stats(changes: DataFrame) -> DataFrame:
    """Totals of a run over its change rows: ``outcome``, ``capacity_changed``."""
    def n(kind: str) -> Column:
        return F.count_if(F.col("outcome") == kind).alias(kind)

    return changes.agg(
        F.count("*").alias("products"), n("changed"), n("unchanged"), n("failed"), n("deleted"),
        F.count_if("capacity_changed").alias("capacity_changed"))


def review_lines(items: DataFrame) -> DataFrame:
    """Review report as ordered lines: ``article_id, orig_idx, line_no, line``.

    Lines stay rows, so a report of any length is written by many tasks.
    """
    def value(name: str) -> Column:
        return F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit("-"))

    lines = F.concat(
        F.array(F.concat(F.lit("### "), value("name"))),
        F.array(*[F.concat(F.lit(f"- {label}: "), value(name)) for label, name in (
            ("current capacity", "capacity"), ("current pricePerUnit", "price_per_unit"),
            ("API itemName", "item_name"), ("API extracted capacity", "found"),
            ("confidence", "confidence"), ("rule", "rule"))]),
        F.array(F.lit("- reasons:")), F.transform("review_reasons", lambda r: F.concat(F.lit("  - "), r)),
    )
    return items.select("article_id", "orig_idx", F.posexplode(lines).alias("line_no", "line"))


def write_review_report(lines: DataFrame, path: str) -> None:
    ordered = lines.repartitionByRange("article_id", "orig_idx").sortWithinPartitions(
        "article_id", "orig_idx", "line_no")
    ordered.select("line").write.mode("overwrite").text(path)


def review_inputs(items: DataFrame) -> DataFrame:
    """Review records with the product as it stays, the basis and the rule's reading."""
    return items.select(
        "article_id", "orig_idx",
        F.struct("name", F.col("after_capacity").alias("capacity"), F.col("after_price").alias("price"),
                 "base_url", F.col("after_price_per_unit").alias("price_per_unit")).alias("current"),
        F.struct(F.col("item_price").alias("apiPrice"), F.col("item_url").alias("itemUrl")).alias("basis"),
        F.struct(F.col("found").alias("extractedCapacity"), "confidence",
                 F.col("review_reasons").alias("reasons")).alias("ruleAnalysis"),
        F.when(F.col("blocked"), "blocked capacity auto-update; kept existing capacity")
        .otherwise("kept existing capacity; review recommended").alias("action"))
