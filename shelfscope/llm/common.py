"""What several of these operators need: tables, plain words, scratch tables, star contraction."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shelfscope.session import cut_lineage, scratch_path

__all__ = ["Bounded", "components", "crc_fold", "cut_lineage", "hash_sample", "most_frequent", "one_per", "present", "scratch_path",
           "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_fold(doc_id: str, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds


def present(rows: Iterable[str | None]) -> list[str]:
    return [x if x is not None else "" for x in rows]


class Bounded(dict):
    """A memo of at most ``limit`` entries; what comes later is computed each time it is asked for."""

    def __init__(self, make, limit: int = 300_000):
        super().__init__()
        self._make, self._limit = make, limit

    def __missing__(self, key):
        value = self._make(key)
        if len(self) < self._limit:
            self[key] = value
        return value


def most_frequent(counts: DataFrame, limit: int) -> list:
    """At most ``limit`` rows of the largest ``n``, largest first, ties by the other columns.

    Rows per eighth of a power of two of ``n`` are counted first, at most a few hundred numbers, and the
    lowest step is chosen that keeps the rows within ``limit``; only those rows travel to the driver.
    """
    step = F.floor(8 * F.log2("n"))
    floor, kept = None, 0
    for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("rows")).orderBy(F.desc("step")).collect():
        if kept + r.rows > limit:
            break
        floor, kept = r.step, kept + r.rows
    if floor is None:
        return []
    rows = counts.where(step >= floor).collect()
    return sorted(rows, key=lambda r: (-r.n, *[str(v) for k, v in r.asDict().items() if k != "n"]))


def hash_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """About ``rows`` rows at most, by hash of ``key``; all of them if there are no more.

    The share is set from the count, with a tenth to spare, so that no more than that is ever sorted or sent.
    """
    total = df.count()
    if total <= rows:
        return df
    share = int(1.1 * rows / total * (1 << 30))
    return df.where(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < share).orderBy(F.xxhash64(key), key).limit(rows)


def one_per(df: DataFrame, key: str) -> DataFrame:
    """One row of each ``key``, the smallest by all columns in order."""
    return df.groupBy(key).agg(F.min(F.struct(*df.columns)).alias("_one")).select("_one.*")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components by alternating large and small stars.

    ``edges`` holds pairs ``a``, ``b`` in any direction, repeats included.  Returns ``node``, ``root``
    for each node that has an edge to another one, with the smallest node of its component as root.
    Minima are aggregates with map-side combine and joined back, so the centre of a star may hold any
    number of edges.  Each round is written to the shared folder.  No edges give no rows.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    pairs = cut_lineage(pairs)
    before = None
    for _ in range(max_rounds):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        low = low.select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut_lineage(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = cut_lineage(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
