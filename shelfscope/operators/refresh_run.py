"""The price refresh as one run: from landed responses to products, history, queue and reports.

A run looks at the articles that a change can reach, and at no others.  A change is another set of landed hits
for a product, another row of the product, or a run before that changed the article and so may not be its last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import text as T
from ..functions import urls as U
from ..functions.arrow import nfkc_lower
from ..session import cut_lineage
from ..sources.tables import deletion_rows
from ..streaming import ledger
from . import matching as M
from . import refresh as P

KEY = ["article_id", "orig_idx"]
# what a landed hit may set beside price, size and unit price
_TAKEN = {"rating": "rating", "review_count": "review_count", "affiliate_url": "base_url", "image_url": "image_url"}


def moved_products(before: DataFrame, after: DataFrame, key: str = "orig_idx") -> DataFrame:
    """Products whose landed hits differ, whatever their order in the files: counts and sums of row digests."""
    def rows(hits: DataFrame, sign: int) -> DataFrame:
        digest = F.xxhash64(F.struct(*sorted(hits.columns))).cast("decimal(20,0)")
        return hits.select(key, F.lit(sign).alias("_n"), (digest * sign).cast("decimal(21,0)").alias("_digest"))

    both = rows(before, -1).unionByName(rows(after, 1)).groupBy(key).agg(
        F.sum("_n").alias("_n"), F.sum("_digest").alias("_digest"))
    return both.where("_n <> 0 OR _digest <> 0").select(key)


def reached_articles(products: DataFrame, before: DataFrame, after: DataFrame, unsettled: DataFrame) -> DataFrame:
    """Articles whose products have other landed hits than before, and the unsettled ones; one row each."""
    moved = moved_products(before, after)
    return products.select(*KEY).join(moved, "orig_idx", "left_semi").select("article_id").unionByName(
        unsettled.select("article_id")).distinct()


def look_up(products: DataFrame, hits: DataFrame, key: str = "orig_idx") -> DataFrame:
    """Each product beside the item of its run: ``hit``, ``exact`` and ``failure``.

    A product with an item link takes that item, found by the earliest stage, if its name agrees; no other item
    stands in for it.  A product without such a link takes the first regular hit.
    """
    looked = products.withColumn("_want", U.item_parts(F.col("base_url")))
    found = M.found_items(looked.select(key, "_want"), hits, key)
    joined = looked.withColumn("_linked", F.col("_want").isNotNull()).join(found, key, "left")
    agrees = T.same_name(T.distinctive_tokens(F.col("name")), F.col("_own.name"))
    failure = (
        F.when(F.col("_linked") & F.col("_own").isNull(), "own item not confirmed")
        .when(F.col("_linked") & ~F.coalesce(agrees, F.lit(False)), "name of own item differs")
        .when(~F.col("_linked") & F.col("_first").isNull(), F.when(F.col("_n") > 0, "only excluded").otherwise("none found")))
    return joined.withColumn("failure", failure).withColumns({
        "hit": F.when(F.col("failure").isNull(), F.when(F.col("_linked"), F.col("_own")).otherwise(F.col("_first"))),
        "exact": F.col("_linked")}).drop("_own", "_first", "_linked", "_want", "_n")


def judge_run(products: DataFrame, articles: DataFrame, hits: DataFrame, frozen: DataFrame, reached: DataFrame | None = None) -> DataFrame:
    """Every product of the reached articles with what the run decides on it, one row each.

    ``articles``: ``article_id, title, article_type, target_unit``; reviews are passed over.  ``frozen``: keys of
    products whose size was decided before.  A product without an item keeps its fields.
    """
    at = articles.where(~F.coalesce(F.col("article_type") == "review", F.lit(False))).select("article_id", "target_unit")
    if reached is not None:
        at = at.join(reached, "article_id", "left_semi")
    mine = products.join(at, "article_id")
    if reached is not None:
        mine = cut_lineage(mine)  # few of all products; they are asked for below, and their hits
    my_hits = hits.join(mine.select("orig_idx"), "orig_idx", "left_semi") if reached is not None else hits
    looked = look_up(mine, my_hits).join(frozen.select(*KEY, F.lit(True).alias("frozen")), KEY, "left")
    # the texts are read apart from the rows
    asked = cut_lineage(looked.withColumns({
        "item_name": F.col("hit.name"), "item_price": F.col("hit.price"), "item_url": F.col("hit.item_url"),
        "frozen": F.coalesce("frozen", F.lit(False))}))
    decided = P.decide_fields(asked, F.col("target_unit"))
    none = F.col("hit").isNull()
    kept = {f"after_{c}": F.when(none, F.col(c)).otherwise(F.col(f"after_{c}")) for c in ("price", "capacity", "price_per_unit")}
    taken = {f"after_{c}": F.coalesce(F.col("hit")[h].cast(products.schema[c].dataType), F.col(c))
             for h, c in _TAKEN.items() if c in products.columns and h in my_hits.columns}
    decided = decided.withColumns({**kept, **taken, "needs_review": F.col("needs_review") & ~none})
    fields = [c[6:] for c in decided.columns if c.startswith("after_")]
    differs = F.lit(False)
    for c in fields:
        differs = differs | ~F.col(f"after_{c}").eqNullSafe(F.col(c))
    return decided.withColumns({
        "outcome": F.when(none, "failed").when(differs, "changed").otherwise("unchanged"),
        "capacity_changed": ~F.col("after_capacity").eqNullSafe(F.col("capacity"))}).drop("hit")


def run_tables(judged: DataFrame, now: DataFrame, articles: DataFrame, as_of: Column, max_rank: int = 10) -> dict[str, DataFrame]:
    """All tables of a run from its judged rows.

    ``changes``: products of the reached articles that differ from ``now``, ``gone`` for those beyond the limit;
    ``deleted``: their history; ``titles``; ``reviews``; ``queue``: failed products, for matching; ``log``: one row
    per product; ``unsettled``: articles that this run has changed.
    """
    taken = {c[6:]: F.col(c) for c in judged.columns if c.startswith("after_") and c[6:] in _TAKEN.values()}
    out = P.refresh_articles(judged.withColumns(taken), articles, max_rank)
    new = cut_lineage(out["products"].select(*KEY, "rank", "name", "price", "capacity", "price_per_unit", "review_count", "base_url"))
    # the judged rows hold the products as they were, so the catalogue is not read again
    before = judged.select(*now.columns)
    removed = before.join(out["removed"].select(*KEY), KEY, "left_semi")
    rest = [c for c in now.columns if c not in new.columns or c in KEY]
    others = judged.withColumns(taken).select(*rest)
    after = new.join(others, KEY).select(*[F.col(c).cast(now.schema[c].dataType).alias(c) for c in now.columns])
    old = before.select(*KEY, F.struct(*now.columns).alias("_old"))
    moved = after.join(old, KEY, "left").where(~F.struct(*now.columns).eqNullSafe(F.col("_old"))).drop("_old")
    changes = moved.withColumn("gone", F.lit(False)).unionByName(removed.withColumn("gone", F.lit(True)))
    return {
        "changes": changes,
        "unsettled": changes.select("article_id").distinct(),
        "titles": out["titles"],
        "reviews": P.review_inputs(judged.where("needs_review")),
        "queue": judged.where("outcome = 'failed'").select(*KEY, "name", "base_url", "failure"),
        "log": judged.select(*KEY, "outcome", "capacity_changed", "rule", "failure"),
        "deleted": deletion_rows(removed, as_of, "rank-limit", U.direct_item_url(F.col("base_url")),
                                 T.identity_key(nfkc_lower(F.col("name")))),
    }


def refresh(spark: SparkSession, root: str, run: int, articles: DataFrame, hits: DataFrame, frozen: DataFrame, as_of: Column, *,
            earlier_hits: DataFrame | None = None, max_rank: int = 10) -> bool:
    """Run number ``run`` over the catalogue below ``root`` (see ``ledger``); False if it was committed before.

    With ``earlier_hits``, the responses of the run before, only reached articles are read; the catalogue comes
    out as if all were.
    """
    def judge(now: DataFrame) -> DataFrame:
        reached = None
        if earlier_hits is not None:
            last = ledger.committed(spark, root, "unsettled")
            unsettled = now.select("article_id").limit(0) if last is None else last.where(F.col("batch_id") == run - 1)
            reached = cut_lineage(reached_articles(now, earlier_hits, hits, unsettled))
        return judge_run(now, articles, hits, frozen, reached)

    return ledger.apply_batch(spark, root, run, judge, lambda judged, now: run_tables(judged, now, articles, as_of, max_rank))
