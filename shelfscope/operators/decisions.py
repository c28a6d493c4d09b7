"""Human and machine decisions: routing, stale guards, application, roll-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import capacity as C
from ..functions import urls as U
from ..session import cut_lineage
from ..sources.jsonl import number_at, text_at
from .numbering import first_per, row_numbers


def article_of(file: Column) -> Column:
    return F.regexp_extract(F.replace(file, F.lit("\\"), F.lit("/")), r"([^/]+?)\.mdx?$", 1)


def match_fields(lines: DataFrame) -> DataFrame:
    """Typed fields of match decisions; wrong types count as absent."""
    b = F.col("body")
    return C.settled(lines, {
        "article_file": text_at(b, "$.articleFile"),
        "rank": F.try_variant_get(b, "$.rank", "double").cast("bigint"),
        "current_name": F.coalesce(text_at(b, "$.currentName"), text_at(b, "$.current.name"),
                                   text_at(b, "$.current.productName")),
        "action": text_at(b, "$.action"),
        "decision": text_at(b, "$.decision"),
        "reason": text_at(b, "$.reason"),
        "new_url": text_at(b, "$.selectedAffiliateUrl"),
        "new_image": text_at(b, "$.selectedImageUrl"),
        "new_name": F.nullif(text_at(b, "$.newName"), F.lit("")),
        "new_capacity": F.nullif(text_at(b, "$.newCapacity"), F.lit("")),
        "new_price": number_at(b, "$.newPrice").cast("bigint"),
        "new_rating": number_at(b, "$.newRating"),
        "new_review_count": number_at(b, "$.newReviewCount").cast("bigint"),
        "new_price_per_unit": F.try_variant_get(b, "$.newPricePerUnit", "string"),
    }).withColumn("article_id", article_of(F.col("article_file")))


def route_decisions(
    lines: DataFrame, articles: DataFrame, products: DataFrame, wanted: Column | None = None
) -> DataFrame:
    """Outcome of each line of a match-decision file: ``outcome, effect, message``.

    All lines are judged against the same state of the catalogue.  Of several
    lines for one product the first in application order counts (replacements,
    then reviews by falling rank), the others go to review.

    All joins are merge joins: articles, products and lines grow together, and tables just below Spark's
    threshold for a broadcast would all go through the driver.
    """
    df = match_fields(lines)
    named = products.groupBy("article_id", "name").agg(F.count("*").alias("_same"))
    sizes = products.groupBy("article_id").agg(F.count("*").alias("_n"))
    at_rank = first_per(products, ["article_id", "rank"], [F.col("orig_idx")]).select(
        "article_id", "rank", F.col("name").alias("_name"), "orig_idx")
    known = articles.select("article_id").withColumn("_known", F.lit(True))
    df = (
        df.join(known.hint("merge"), "article_id", "left").join(sizes.hint("merge"), "article_id", "left")
        .join(at_rank.hint("merge"), ["article_id", "rank"], "left")
        .join(named.withColumnRenamed("name", "_name").hint("merge"), ["article_id", "_name"], "left")
    )
    c = F.col
    no_product = c("_name").isNull() | c("current_name").isNull()
    is_delete = (c("action") == "review") & F.coalesce(c("decision") == "delete", F.lit(False))
    other = F.concat(F.lit("rank/current.name mismatch: rank "), c("rank").cast("string"), F.lit(' is "'),
                     "_name", F.lit('", JSONL current is "'), "current_name", F.lit('"'))
    failed = (
        F.when(~c("is_ok"), "JSON parse failed")
        .when(~c("is_object"), "line is not an object")
        .when(~U.is_article_file(c("article_file")), "invalid articleFile")
        .when(F.lit(False) if wanted is None else ~wanted, None)
        .when(c("_known").isNull(), "article file not found")
        .when(is_delete & no_product, "review delete requires rank and current.name")
        .when(is_delete & (c("_name") != c("current_name")), other)
        .when(c("action") == "review", None)
        .when(F.coalesce(c("action") != "replace", F.lit(True)),
              F.concat(F.lit("unsupported action: "), F.coalesce("action", F.lit("-"))))
        .when(~U.is_web_url(c("new_url")), "replace requires selectedAffiliateUrl")
        .when(no_product, "rank and current.name are required for replace")
        .when(c("_name") != c("current_name"), other)
    )
    pending = F.lit(False) if wanted is None else (
        c("is_object") & U.is_article_file(c("article_file")) & ~F.coalesce(wanted, F.lit(False)))
    effect = (
        F.when(is_delete & (c("_same") > 1), "review").when(is_delete & (c("_n") <= 1), "review")
        .when(is_delete, "delete").when(c("action") == "review", "review").otherwise("replace")
    )
    df = C.settled(df, {"_failed": failed}).withColumn(
        "outcome", F.when(c("is_empty"), "noop").when(pending, "pending")
        .when(c("_failed").isNotNull(), "failed").otherwise("processed")
    ).withColumn("effect", F.when(c("outcome") == "processed", effect)).withColumns({
        "_class": F.when(c("action") == "replace", 0).when(c("action") == "review", 1).otherwise(2),
        "_back": F.when(c("action") == "review", -F.coalesce("rank", F.lit(0))).otherwise(0),
    })
    # judged once, read for the lines that win and for all
    df = cut_lineage(df.drop("_name", "_same", "_known", "body"))
    # first line per product wins; an article keeps its last product
    order = [c("_class"), c("_back"), c("file"), c("line_no")]
    acts = df.filter("effect IN ('replace', 'delete')")
    winners = first_per(acts, ["article_id", "orig_idx"], order)
    deletes = winners.filter("effect = 'delete'")
    spared = (
        deletes.groupBy("article_id").agg(
            F.count("*").alias("_d"), F.max("_n").alias("_all"),
            F.max(F.struct("_class", "_back", "file", "line_no")).alias("_last"))
        .filter("_d >= _all").select("_last.file", "_last.line_no")
    )
    done = winners.select("file", "line_no").join(spared.hint("merge"), ["file", "line_no"], "left_anti").withColumn(
        "_done", F.lit(True))
    return df.join(done.hint("merge"), ["file", "line_no"], "left").withColumn(
        "effect", F.when(c("effect").isin("replace", "delete") & c("_done").isNull(), "review")
        .otherwise(c("effect"))
    ).withColumn("message", c("_failed")).drop("_failed", "_n", "_done")


def application_order(routed: DataFrame) -> DataFrame:
    """``apply_seq`` per file and article: replacements, reviews by falling rank, others."""
    # counted and numbered
    return row_numbers(
        cut_lineage(routed.filter("article_id <> ''")), ["file", "article_id"],
        [F.col("_class"), F.col("_back"), F.col("line_no")], "apply_seq")


def apply_decisions(products: DataFrame, routed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Products after replacements and deletions, renumbered, and the deleted rows."""
    acts = routed.filter("effect IN ('replace', 'delete')").select(
        "article_id", "orig_idx", "effect", "new_name", "new_price", "new_rating", "new_review_count",
        "new_url", "new_image", "new_capacity", "new_price_per_unit")
    joined = products.join(acts, ["article_id", "orig_idx"], "left")
    gone = F.coalesce(F.col("effect") == "delete", F.lit(False))
    deleted = joined.filter(gone).select(*products.columns)
    take = {"name": "new_name", "price": "new_price", "rating": "new_rating",
            "review_count": "new_review_count", "base_url": "new_url", "image_url": "new_image",
            "capacity": "new_capacity", "price_per_unit": "new_price_per_unit"}
    kept = joined.filter(~gone).withColumns({
        old: F.coalesce(new, old) for old, new in take.items() if old in products.columns})
    touched = deleted.select("article_id").distinct().withColumn("_touched", F.lit(True))
    renumbered = row_numbers(kept.select(*products.columns), ["article_id"], [F.col("orig_idx")], "_new")
    out = renumbered.join(touched, "article_id", "left").withColumn(
        "rank", F.when(F.col("_touched"), F.col("_new").cast("bigint")).otherwise(F.col("rank")))
    return out.select(*products.columns), deleted


# -- pack-size decisions -----------------------------------------------------

def size_fields(lines: DataFrame) -> DataFrame:
    b = F.col("body")
    rank = F.try_variant_get(b, "$.rank", "double")
    return C.settled(lines, {
        "article_id": article_of(text_at(b, "$.articleFile")),
        "decision": text_at(b, "$.decision"),
        "rank": F.when(rank > 0, rank).cast("bigint"),
        "reason": F.coalesce(F.try_variant_get(b, "$.reason", "string"), F.lit("review")),
        "has_current": F.coalesce(
            F.schema_of_variant(F.try_variant_get(b, "$.current", "variant")).startswith("OBJECT"), F.lit(False)),
        "c_name": text_at(b, "$.current.name"),
        "c_has_capacity": F.try_variant_get(b, "$.current.capacity", "variant").isNotNull(),
        "c_capacity": text_at(b, "$.current.capacity"),
        "c_price": number_at(b, "$.current.price"),
        "c_url": text_at(b, "$.current.rakutenUrl"),
        "has_basis": F.coalesce(
            F.schema_of_variant(F.try_variant_get(b, "$.basis", "variant")).startswith("OBJECT"), F.lit(False)),
        "b_price": number_at(b, "$.basis.apiPrice"),
        "b_item": text_at(b, "$.basis.itemUrl"),
        "b_affiliate": text_at(b, "$.basis.affiliateUrl"),
        "new_capacity": text_at(b, "$.newCapacity"),
    })


def same_capacity_value(expected: Column, actual: Column, e_norm: Column, a_norm: Column) -> Column:
    plain = expected.isNull() | (expected == "-")
    return F.when(plain, expected.eqNullSafe(actual)).otherwise(
        F.coalesce(expected == actual, F.lit(False)) | C.same_total(e_norm, a_norm))


def with_current(lines: DataFrame, products: DataFrame) -> DataFrame:
    """Size decisions beside the product at their article and rank."""
    now = first_per(products, ["article_id", "rank"], [F.col("orig_idx")]).select(
        "article_id", "rank", F.col("orig_idx"), F.col("name").alias("p_name"),
        F.col("capacity").alias("p_capacity"), F.col("price").alias("p_price"), F.col("base_url").alias("p_url"))
    df = size_fields(lines).join(now, ["article_id", "rank"], "left")
    return C.with_norm(C.with_norm(df, "c_capacity", "c_norm"), "p_capacity", "p_norm")


def stale_guard(lines: DataFrame, products: DataFrame) -> DataFrame:
    """``outcome, message`` of each size decision against the current product.

    Lines that no longer describe the product go to review, malformed ones fail.
    """
    c = F.col
    df = with_current(lines, products)
    unknown = ~F.coalesce(c("decision").isin("apply", "keep", "review", "clear"), F.lit(False))
    same_size = same_capacity_value(c("c_capacity"), c("p_capacity"), c("c_norm"), c("p_norm"))
    failed = (
        F.when(~c("is_ok"), "JSON parse failed")
        .when(~c("is_object"), "line is not an object")
        .when(unknown, "unsupported decision")
        .when(c("decision") == "review", None)
        .when(c("rank").isNull(), "rank is required")
        .when(~c("has_current"), "current object is required")
        .when(c("c_name").isNull() | ~c("c_has_capacity"), "current.name and current.capacity are required")
    )
    review = (
        F.when(c("decision") == "review", c("reason"))
        .when(c("p_name").isNull(), "rank not found")
        .when(c("p_name") != c("c_name"), "rank/current.name mismatch")
        .when(~same_size, "current.capacity mismatch")
        .when(c("c_price").isNull() | c("c_url").isNull(), "current.price and current.rakutenUrl are required for auto apply")
        .when(~F.coalesce(c("p_price") == c("c_price"), F.lit(False)), "current.price mismatch")
        .when(~U.same_item(c("c_url"), c("p_url")), "current.rakutenUrl points to a different item")
        .when(~c("has_basis"), "basis is required for auto apply")
        .when(c("b_price").isNull() | c("b_item").isNull() | c("b_affiliate").isNull(),
              "basis.apiPrice, basis.itemUrl and basis.affiliateUrl are required")
        .when(c("b_price") != c("p_price"), "basis.apiPrice mismatch")
        .when(~U.same_item(c("b_affiliate"), c("p_url")) | ~U.same_item(c("b_item"), c("p_url")),
              "basis URL points to a different item")
    )
    return C.settled(df, {"_f": failed, "_r": review}).withColumns({
        "outcome": F.when(c("is_empty"), "noop").when(c("_f").isNotNull(), "failed")
        .when(c("_r").isNotNull(), "review").otherwise("processed"),
        "message": F.when(~c("is_empty"), F.coalesce("_f", "_r", F.lit("ok"))),
    }).drop("_f", "_r", "body")


def size_updates(guarded: DataFrame, target_unit: Column | None = None) -> DataFrame:
    """New size and unit price of accepted lines; unusable sizes go to review.

    Of several accepted lines for one product the first counts.
    """
    c = F.col
    df = C.with_total(guarded, "new_capacity", "new_total")
    df = C.with_unit_price(df, "p_price", "new_total", "ppu", target_unit)
    is_apply = (c("outcome") == "processed") & (c("decision") == "apply")
    bad = (
        F.when(~is_apply, None)
        .when(F.coalesce(F.trim("new_capacity").isin("", "-"), F.lit(True)), "decision apply requires non-empty newCapacity")
        .when(c("new_total").isNull(), "newCapacity is not parseable")
        .when(~F.coalesce(c("p_price") > 0, F.lit(False)), "current MD price must be a positive number")
    )
    df = df.withColumn("_bad", bad).withColumns({
        "outcome": F.when(c("_bad").isNotNull(), "review").otherwise(c("outcome")),
        "message": F.coalesce("_bad", "message")})
    done = c("outcome") == "processed"
    df = df.withColumns({
        "set_capacity": F.when(done & (c("decision") == "apply"), c("new_capacity")).when(
            done & (c("decision") == "clear"), "-"),
        "set_unit_price": F.when(done & (c("decision") == "apply"), c("ppu.label")).when(
            done & (c("decision") == "clear"), "-"),
    })
    winners = first_per(df.filter("outcome = 'processed'"), ["article_id", "rank"],
                        [c("file"), c("line_no")]).select("file", "line_no", F.lit(True).alias("_first"))
    late = (c("outcome") == "processed") & c("_first").isNull()
    return df.join(winners, ["file", "line_no"], "left").withColumns({
        "set_capacity": F.when(~late, c("set_capacity")),
        "set_unit_price": F.when(~late, c("set_unit_price")),
        "message": F.when(late, "another line decided this product").otherwise(c("message")),
        "outcome": F.when(late, "review").otherwise(c("outcome")),
    }).drop("_bad", "_first", "ppu", "new_total")


def apply_size_updates(products: DataFrame, updates: DataFrame) -> DataFrame:
    new = updates.filter("set_capacity IS NOT NULL").select("article_id", "orig_idx", "set_capacity", "set_unit_price")
    return products.join(new, ["article_id", "orig_idx"], "left").withColumns({
        "capacity": F.coalesce("set_capacity", "capacity"),
        "price_per_unit": F.coalesce("set_unit_price", "price_per_unit"),
    }).drop("set_capacity", "set_unit_price")


def frozen_products(processed: DataFrame, products: DataFrame) -> DataFrame:
    """Products whose accepted decision still describes them, one row per item."""
    c = F.col
    df = C.with_norm(with_current(processed, products), "new_capacity", "n_norm")
    expected = (
        F.when(c("decision") == "apply", same_capacity_value(
            c("new_capacity"), c("p_capacity"), c("n_norm"), c("p_norm")))
        .when(c("decision") == "clear", c("p_capacity") == "-")
        .when(c("decision") == "keep", same_capacity_value(
            c("c_capacity"), c("p_capacity"), c("c_norm"), c("p_norm")))
    )
    ok = (
        c("is_object") & expected & (c("c_name") == c("p_name")) & U.same_item(c("c_url"), c("p_url")))
    return df.filter(ok).select(
        "article_id", "rank", F.col("p_name").alias("name"), U.item_key(c("p_url")).alias("item_key")).distinct()


def finalize_files(outcomes: DataFrame) -> DataFrame:
    """Per input file: pending lines keep it, failures mark it, else it is processed."""
    return outcomes.groupBy("file").agg(
        F.bool_or(F.col("outcome") == "pending").alias("has_pending"),
        F.bool_or(F.col("outcome") == "failed").alias("has_failed"),
        F.count_if(F.col("outcome") == "processed").alias("processed"),
    ).withColumn("status", F.when(F.col("has_pending"), "pending").when(F.col("has_failed"), "failed")
                 .otherwise("processed"))


# -- keyed updates -----------------------------------------------------------

def guarded_update(products: DataFrame, updates: DataFrame, fields: list[str], guards: list[str]) -> DataFrame:
    """Partial update by article and rank; NULL keeps, guards must still agree.

    ``updates``: article_id, rank, ``new_<field>``, ``check_<guard>`` (BOOLEAN)
    and ``expect_<guard>``.  The result keeps updates without a product, with a
    reason.
    """
    now = first_per(products, ["article_id", "rank"], [F.col("orig_idx")])
    joined = updates.join(now, ["article_id", "rank"], "left")
    agrees = F.lit(True)
    for g in guards:
        agrees = agrees & (~F.coalesce(f"check_{g}", F.lit(False)) | F.col(f"expect_{g}").eqNullSafe(F.col(g)))
    found = F.col("orig_idx").isNotNull()
    ok = found & agrees
    out = {f: F.when(ok, F.coalesce(f"new_{f}", f)).otherwise(F.col(f)) for f in fields}
    moved = F.lit(False)
    for f in fields:
        moved = moved | ~F.coalesce(f"new_{f}", f).eqNullSafe(F.col(f))
    return joined.select(
        "article_id", "rank", "orig_idx", *[v.alias(k) for k, v in out.items()],
        (ok & moved).alias("changed"),
        F.when(~found, "rank not found").when(~agrees, "expected fields mismatch").alias("reason"))


def decision_history(summary: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decisions of a product: same article and the same rank or name.

    Rank and name are two equi-joins, so a hot article is not paired in full.
    """
    p = summary.select("article_id", "orig_idx", "rank", "name")
    by_rank = p.join(decisions, ["article_id", "rank"]).select("orig_idx", "decision_id")
    by_name = p.join(decisions.withColumnRenamed("current_name", "name"), ["article_id", "name"]).select(
        "orig_idx", "decision_id")
    return by_rank.union(by_name).distinct()
