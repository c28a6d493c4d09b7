"""The same product under another link: names that share character grams, found without lists of pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T
from ..functions.arrow import nfkc_lower
from ..session import cut_lineage

GRAM = 4
_SEP = "\u0001"


def _needed(key: Column) -> Column:
    """Grams an existing key must share: two, and 40% of its length in characters of four a gram."""
    return F.greatest(F.lit(2), F.floor((F.length(key) + 9) / 10).cast("int"))


def _sizes(is_candidate: bool) -> tuple[Column, Column]:
    """Signature of size and width, and the tokens one of which both sides must have in common.

    A known size meets the same size, if the widths do not differ, and unknown sizes; an unknown size meets all.
    """
    known = F.col("total").isNotNull()
    own = F.concat_ws(":", F.lower("total.unit"), F.col("total.total").cast("string"))
    any_width = F.concat(own, F.lit(f"{_SEP}-"))
    with_width = F.concat(own, F.lit(_SEP), F.coalesce(F.col("_width").cast("string"), F.lit("-")))
    any_size, unknown = F.lit("*"), F.lit("?")
    if is_candidate:
        sized = F.when(F.col("_width").isNull(), F.array(own, unknown)).otherwise(
            F.array(with_width, any_width, unknown))
        tokens = F.when(known, sized).otherwise(F.array(any_size))
    else:
        tokens = F.when(known, F.array(own, with_width, any_size)).otherwise(F.array(unknown, any_size))
    return F.when(known, with_width).otherwise(unknown), tokens


def _keyed(df: DataFrame, is_candidate: bool) -> DataFrame:
    """``_dkey``, ``_sig`` and ``_tokens`` of the rows whose key has a gram."""
    df = df.withColumn("_lower", nfkc_lower(F.col("name"))).withColumns({
        "_dkey": T.distinct_key(T.identity_key(F.col("_lower"))), "_width": T.width_cm(F.col("_lower")),
    })
    sig, tokens = _sizes(is_candidate)
    return df.filter(F.length("_dkey") >= GRAM).withColumns({"_sig": sig, "_tokens": tokens})


def _pieces(key: Column, length: Column) -> Column:
    """All substrings of one length; the key has at least that length."""
    starts = F.sequence(F.lit(1), F.length(key) - length + 1)
    return F.array_distinct(F.transform(starts, lambda i: F.substring(key, i, length)))


def _tokened(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns, F.explode("_tokens").alias("_token"))


def _covered_by_piece(left: DataFrame, right: DataFrame, block: str) -> DataFrame:
    """Candidates that hold or lie in an existing key, or share a run of as many grams as it needs.

    Both sides send substrings of the lengths that decide; equal ones meet in a semi-join.  A run of ``k``
    distinct grams is a substring of ``k + 3`` characters.  Containment counts on its own only where it
    brings fewer distinct grams than needed: very short keys, and keys that repeat themselves.
    The pieces of existing keys go to merge joins, since Spark sizes them like the keys they come from.
    """
    mine, need = [block, "_dkey", "_sig"], _needed(F.col("_dkey"))
    own_grams = F.size(T.grams(F.col("_dkey")))

    # runs of grams
    lengths = right.select(block, (need + GRAM - 1).alias("_len")).distinct()
    runs = (
        right.withColumn("_len", need + GRAM - 1).filter(F.length("_dkey") >= F.col("_len"))
        .select(block, "_tokens", "_len", F.explode(_pieces(F.col("_dkey"), F.col("_len"))).alias("_piece"))
        .filter(F.size(T.grams(F.col("_piece"))) == F.col("_len") - (GRAM - 1)))
    # existing keys with too few distinct grams, whole
    few = right.filter(own_grams < need)
    lengths = lengths.union(few.select(block, F.length("_dkey").alias("_len"))).distinct()
    theirs = _tokened(runs, block, "_piece").union(
        _tokened(few.withColumn("_piece", F.col("_dkey")), block, "_piece")).distinct()
    sent = (
        left.join(lengths, block).filter(F.length("_dkey") >= F.col("_len"))
        .select(*mine, "_tokens", F.explode(_pieces(F.col("_dkey"), F.col("_len"))).alias("_piece")))
    shares = _tokened(sent, *mine, "_piece").join(theirs.hint("merge"), [block, "_piece", "_token"], "left_semi")

    # candidates inside an existing key that needs more grams than they have
    small = left.select(block, F.length("_dkey").alias("_len"), own_grams.alias("_own")).distinct()
    inside = (
        right.join(small, block).filter((need > F.col("_own")) & (F.length("_dkey") >= F.col("_len")))
        .select(block, "_tokens", F.explode(_pieces(F.col("_dkey"), F.col("_len"))).alias("_piece")))
    inside = _tokened(inside, block, "_piece").distinct()
    within = _tokened(left.withColumn("_piece", F.col("_dkey")), *mine, "_piece").join(
        inside.hint("merge"), [block, "_piece", "_token"], "left_semi")
    return shares.select(*mine).union(within.select(*mine)).distinct()


def _gram_pairs(sets: DataFrame, keep: list[str]) -> DataFrame:
    """Rows (``_g1``, ``_g2``) of all pairs in the array ``_gs``."""
    first = sets.select(*keep, "_gs", F.posexplode("_gs").alias("_i", "_a"))
    rest = F.slice("_gs", F.col("_i") + 2, F.size("_gs"))
    both = first.select(*keep, "_a", F.explode(rest).alias("_b"))
    return both.select(*keep, F.least("_a", "_b").alias("_g1"), F.greatest("_a", "_b").alias("_g2"))


def _pair_rows(left: DataFrame, right: DataFrame, block: str) -> tuple[DataFrame, DataFrame]:
    """Gram pairs of both sides, only of grams that occur on both sides of the block.

    An existing key leaves out its most frequent grams: of any ``k`` shared ones the two rarest stay.
    Grams and pairs go to merge joins, since Spark sizes them like the keys they come from.
    """
    def rows(df: DataFrame) -> DataFrame:
        keys = df.select(block, "_dkey").distinct()
        return keys.select(block, "_dkey", F.explode(T.grams(F.col("_dkey"))).alias("_gram"))

    a, b = rows(left), rows(right)
    counts = b.groupBy(block, "_gram").agg(F.count("*").alias("_df"))
    shared = counts.join(a.select(block, "_gram").distinct().hint("merge"), [block, "_gram"], "left_semi").hint("merge")
    a_sets = a.join(shared, [block, "_gram"], "left_semi").groupBy(block, "_dkey").agg(
        F.collect_list("_gram").alias("_gs")).filter(F.size("_gs") >= 2)
    need = _needed(F.col("_dkey"))
    ordered = F.sort_array(F.collect_list(F.struct("_df", "_gram")))["_gram"]
    b_sets = (
        b.join(shared, [block, "_gram"]).groupBy(block, "_dkey").agg(ordered.alias("_gs"))
        .filter(F.size("_gs") >= need)
        .withColumn("_gs", F.slice("_gs", F.lit(1), F.size("_gs") - need + 2)))
    key = [block, "_dkey"]
    mine = _tokened(_gram_pairs(a_sets, key).join(left.hint("merge"), key), *key, "_sig", "_g1", "_g2")
    theirs = _tokened(
        _gram_pairs(b_sets, key).join(right.select(*key, "_tokens").hint("merge"), key), *key, "_g1", "_g2")
    return mine, theirs


def _meetings(mine: DataFrame, theirs: DataFrame, block: str) -> DataFrame:
    """Distinct pairs of a candidate and an existing key of three or more needed grams that share two rare ones."""
    long = theirs.filter(_needed(F.col("_dkey")) > 2).withColumnRenamed("_dkey", "_rkey").distinct()
    return mine.join(long, [block, "_g1", "_g2", "_token"]).select(block, "_dkey", "_sig", "_rkey").distinct()


def _covered_by_pairs(left: DataFrame, right: DataFrame, block: str) -> DataFrame:
    """Candidates that share enough scattered grams with an existing key."""
    columns = [block, "_dkey", "_sig"]
    mine, theirs = _pair_rows(left, right, block)
    on = [block, "_g1", "_g2", "_token"]
    two = theirs.filter(_needed(F.col("_dkey")) == 2).select(*on).distinct()
    short = mine.join(two, on, "left_semi").select(*columns)
    common = F.size(F.array_intersect(T.grams(F.col("_rkey")), T.grams(F.col("_dkey"))))
    longer = _meetings(mine, theirs, block).filter(common >= _needed(F.col("_rkey"))).select(*columns)
    return short.union(longer).distinct()


def same_product(candidates: DataFrame, existing: DataFrame, block: str, row_id: str) -> DataFrame:
    """Ids of candidates that an existing product of the block already covers.

    Both sides carry ``name`` and ``total``.  Two names look the same if one distinct key holds the other,
    or if at least two and 40% (by length) of the existing key's 4-grams occur in the candidate; sizes and
    widths must agree if both sizes are known.  Keys below four characters, null names and null blocks match
    nothing; repeated names and sizes are judged once.

    A candidate needs one partner, not all, so nearly everything is a semi-join on something that proves the
    match: a shared substring, or for existing keys up to 20 characters any two shared grams.  Only scattered
    grams of longer keys are compared pair by pair, where the two rarest of them meet; a phrase that all
    names of a block share brings no such pair.  Rows grow with the names and the square of a name's length.
    """
    columns = [block, "_dkey", "_sig", "_tokens"]
    # both sides are read several times below, the candidates' rows once more at the end: compute the keys once
    cand = cut_lineage(_keyed(candidates, True).filter(F.col(block).isNotNull()).select(row_id, *columns))
    left = cut_lineage(cand.select(*columns).distinct())
    right = cut_lineage(_keyed(existing, False).filter(F.col(block).isNotNull()).select(*columns).distinct())
    mine = [block, "_dkey", "_sig"]
    found = cut_lineage(_covered_by_piece(left, right, block))
    rest = left.join(found.hint("merge"), mine, "left_anti")
    hit = found.union(_covered_by_pairs(rest, right, block))
    return cand.join(hit, mine, "left_semi").select(row_id).distinct()
