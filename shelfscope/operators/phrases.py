"""Positional index of character grams: exact phrase search in texts of any length.

A text is a sequence of entries joined by one blank.  It is never put together: each entry knows where it
starts, and its grams reach into the next one.  A phrase is found where its rarest gram stands and the
others stand at the right distance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage
from .numbering import prefix_sums, task_count

GRAM = 3


def place_entries(entries: DataFrame, key: str, order: list[Column], text: str = "text") -> DataFrame:
    """``entries`` that hold text, with ``piece`` (lower case, led by the blank that joins it to the one
    before) and ``at``, where the piece starts in the text of its key.

    Positions are sums over range partitions, so one key may hold any share of the rows.
    """
    held = entries.where(F.coalesce(F.col(text) != "", F.lit(False))).withColumn("_low", F.lower(text))
    placed = prefix_sums(held, [key], order, (F.length("_low") + 1).cast("long"), "_at")
    first = F.col("_at") == 0
    return placed.select(
        *entries.columns, F.when(first, F.col("_low")).otherwise(F.concat(F.lit(" "), "_low")).alias("piece"),
        F.when(first, F.lit(0)).otherwise(F.col("_at") - 1).cast("long").alias("at"))


def gram_index(placed: DataFrame, key: str) -> DataFrame:
    """``gram, key, at``: the characters from each position of a text on, ``GRAM`` of them where there are as many."""
    pieces = placed.select(key, "at", "piece")
    ahead = pieces.select(key, F.col("at").alias("_end"), F.substring("piece", 1, GRAM - 1).alias("_ahead"))
    joined = pieces.withColumn("_end", F.col("at") + F.length("piece")).join(ahead, [key, "_end"], "left")
    chars = joined.select(key, "at", F.length("piece").alias("_n"),
                          F.split(F.concat_ws("", "piece", "_ahead"), "").alias("_c"))
    grams = F.transform(F.sequence(F.lit(1), F.col("_n")), lambda i: F.array_join(F.slice("_c", i, F.lit(GRAM)), ""))
    return chars.select(key, "at", F.posexplode(grams).alias("_i", "gram")).select(
        "gram", key, (F.col("at") + F.col("_i")).alias("at"))


def write_index(index: DataFrame, path: str) -> DataFrame:
    """Store an index in order of its grams, so that a phrase reads the row groups of its own grams only."""
    order = index.columns
    index = cut_lineage(index)
    index.repartitionByRange(task_count(index), *order).sortWithinPartitions(*order).write.mode("overwrite").parquet(path)
    return index.sparkSession.read.parquet(path)


def phrase_starts(index: DataFrame, key: str, phrase: str) -> DataFrame:
    """``key, at`` of each place where the text goes on with ``phrase`` (any length, upper or lower case).

    The grams that cover the phrase are counted; the rarest one gives the starts to look at, and a start
    stays if each other gram stands at its distance.  A phrase shorter than a gram is looked up as the
    beginning of grams.  An empty phrase is found nowhere.
    """
    wanted = phrase.strip().lower()
    if not wanted:
        return index.select(key, "at").limit(0)
    if len(wanted) <= GRAM:
        return index.where(F.col("gram").startswith(wanted)).select(key, "at")
    places = sorted({*range(0, len(wanted) - GRAM + 1, GRAM), len(wanted) - GRAM})
    grams: dict[str, list[int]] = {}
    for p in places:
        grams.setdefault(wanted[p: p + GRAM], []).append(p)
    mine = index.where(F.col("gram").isin(*grams))
    counts = {r.gram: r["count"] for r in mine.groupBy("gram").count().collect()}  # one row per gram of the phrase
    if len(counts) < len(grams):
        return index.select(key, "at").limit(0)
    rarest = min(grams, key=lambda g: (counts[g], g))
    lead = grams[rarest][0]
    starts = index.where(F.col("gram") == rarest).select(key, (F.col("at") - lead).alias("at")).where("at >= 0")
    needed = len(places)
    if needed == 1:
        return starts
    asked = F.create_map(*[x for g, p in grams.items() for x in (F.lit(g), F.array(*map(F.lit, p)))])
    held = mine.withColumn("_p", F.explode(asked[F.col("gram")])).select(key, (F.col("at") - F.col("_p")).alias("at"))
    return held.join(starts, [key, "at"], "left_semi").groupBy(key, "at").agg(F.count("*").alias("_n")).where(
        F.col("_n") == needed).select(key, "at")


def first_hits(placed: DataFrame, index: DataFrame, key: str, phrase: str) -> DataFrame:
    """One row per key whose text holds the phrase: ``hits``, how often; ``hit_at``, where first; and the columns
    of the entry in which that first one begins (where it begins with the joining blank, the entry after it).
    """
    found = phrase_starts(index, key, phrase).groupBy(key).agg(F.min("at").alias("hit_at"), F.count("*").alias("hits"))
    inside = (F.col("hit_at") >= F.col("at")) & (F.col("hit_at") < F.col("at") + F.length("piece"))
    return placed.join(found, key).where(inside).drop("piece", "at")
