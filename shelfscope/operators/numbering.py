"""Row numbers and first-per-key picks that hold when one key has most rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage

# A group up to this size may be numbered by one task.
MAX_TASK_ROWS = 2_000_000
# Rows that one task sorts where the number of tasks is set by a count.
PIECE_ROWS = 250_000


def top_per(df: DataFrame, key: list[str], order: list[Column], n: int, out: str | None = None) -> DataFrame:
    """First ``n`` rows per key in a total order.

    The filter sits directly on the row number, so Spark prunes to ``n`` rows
    per key before the shuffle; a hot key sends at most ``n`` rows per task.
    """
    rn = out or "_rn"
    w = Window.partitionBy(*key).orderBy(*order)
    kept = df.withColumn(rn, F.row_number().over(w)).filter(F.col(rn) <= n)
    return kept if out else kept.drop(rn)


def first_per(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    return top_per(df, key, order, 1)


def row_numbers(
    df: DataFrame, key: list[str], order: list[Column], out: str,
    max_task_rows: int | None = None,
) -> DataFrame:
    """Number all rows of each key from 1 in a total order.

    The largest group is counted first (a partial aggregate over the key
    columns alone).  Within the bound this is a plain window.  Beyond it the
    rows are range-partitioned by key and order, so that a hot key spreads over
    many tasks, written once, and each piece starts at the row count of the
    pieces before it.
    """
    limit = MAX_TASK_ROWS if max_task_rows is None else max_task_rows
    largest = df.groupBy(*key).count().agg(F.max("count")).first()[0] or 0
    if largest <= limit:
        return df.withColumn(out, F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    bounds = [*map(F.col, key), *order]
    sorted_rows = (
        df.repartitionByRange(*bounds).sortWithinPartitions(*bounds)
        .withColumn("_seq", F.monotonically_increasing_id())
    )
    rows = cut_lineage(sorted_rows).withColumn("_piece", F.shiftright("_seq", 33))
    pieces = rows.groupBy(*key, "_piece").agg(F.count("*").alias("_n"), F.min("_seq").alias("_first"))
    earlier = (
        Window.partitionBy(*key).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = pieces.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)],
        F.col("_piece").alias("_at"), "_first",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
    )
    same = reduce(
        lambda a, b: a & b,
        [rows[k].eqNullSafe(starts[f"_k{i}"]) for i, k in enumerate(key)],
        rows["_piece"] == starts["_at"],
    )
    numbered = rows.join(starts, same)
    return numbered.select(
        *df.columns, (F.col("_before") + F.col("_seq") - F.col("_first") + 1).cast("int").alias(out))


def task_count(stored: DataFrame) -> int:
    """Tasks for sorting stored rows, at most ``PIECE_ROWS`` rows each on average, no fewer than shuffle partitions.

    Sorted rows compress so well that partitions merged by their shuffled bytes would hold ever more rows.
    """
    return max(int(stored.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-stored.count() // PIECE_ROWS))


def prefix_sums(df: DataFrame, key: list[str], order: list[Column], value: Column, out: str) -> DataFrame:
    """Sum of ``value`` over the earlier rows of the same key, in a total order, as a long.

    Two levels, whatever the sizes: the rows are range-partitioned by key and order and written with the
    number of their piece; sums run within a piece, and a piece starts at the sums of those before it.  A key
    spreads over as many pieces as it fills.
    """
    bounds = [*map(F.col, key), *order]
    valued = cut_lineage(df.withColumn("_value", value.cast("long")))
    tasks = task_count(valued)
    rows = cut_lineage(valued.repartitionByRange(tasks, *bounds).withColumn("_piece", F.spark_partition_id()))
    rows = rows.repartition(tasks, *key, "_piece")
    names = [f"_k{i}" for i in range(len(key))]
    own = Window.partitionBy(*key, "_piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*names).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    pieces = rows.groupBy(*[F.col(k).alias(n) for k, n in zip(key, names)], F.col("_piece").alias("_at")).agg(
        F.sum("_value").alias("_sum"))
    starts = pieces.select(*names, "_at", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    same = reduce(lambda a, b: a & b, [rows[k].eqNullSafe(starts[n]) for k, n in zip(key, names)],
                  rows["_piece"] == starts["_at"])
    summed = rows.withColumn("_within", F.coalesce(F.sum("_value").over(own), F.lit(0)))
    return summed.join(starts, same).select(*df.columns, (F.col("_before") + F.col("_within")).alias(out))
