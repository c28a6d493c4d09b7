"""A catalogue that changes by committed batches.

Below one folder lie ``base`` (whole snapshots), ``changes`` (changed rows of each batch, ``gone`` for deleted
ones), any other tables of a batch, and ``commits``.  A batch counts once its row in ``commits`` is there, which
is written last.  Readers take committed batches only, so a batch that failed half-way leaves no trace and is
simply written again from the same state; a batch that is already committed is not applied twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.numbering import first_per

KEY = ["article_id", "orig_idx"]
FIRST = -1
Derive = Callable[[DataFrame, DataFrame], dict[str, DataFrame]]


def _commit(spark: SparkSession, root: str, batch_id: int, base: int) -> None:
    row = spark.range(1).select(F.lit(batch_id).cast("long").alias("batch_id"), F.lit(base).cast("long").alias("base"))
    row.coalesce(1).write.mode("overwrite").parquet(f"{root}/commits/at={batch_id}-{base}")


def create(products: DataFrame, root: str) -> None:
    """Start a catalogue from a whole table of products."""
    products.write.mode("overwrite").parquet(f"{root}/base/version={FIRST}")
    _commit(products.sparkSession, root, FIRST, FIRST)


def commits(spark: SparkSession, root: str) -> DataFrame:
    """``batch_id, base``: batches in force, and the snapshot each was committed over."""
    return spark.read.parquet(f"{root}/commits").select("batch_id", "base")


def _newest(spark: SparkSession, root: str) -> tuple[int, int]:
    row = commits(spark, root).agg(F.max("batch_id"), F.max("base")).first()
    return row[0], row[1]


def committed(spark: SparkSession, root: str, table: str) -> DataFrame | None:
    """Rows of a table of all committed batches with their ``batch_id``; None before the first batch."""
    done = [r.batch_id for r in commits(spark, root).where(F.col("batch_id") > FIRST).select("batch_id").distinct().collect()]
    if not done:
        return None
    paths = [f"{root}/{table}/batch_id={b}" for b in sorted(done)]
    return spark.read.option("basePath", f"{root}/{table}").parquet(*paths).withColumn("batch_id", F.col("batch_id").cast("long"))


def state(spark: SparkSession, root: str) -> DataFrame:
    """The products after all committed batches.

    Rows of the newest snapshot that no later batch touches stay where they are; of the others the last change
    counts.  So a reader moves the changes since the snapshot, not the catalogue.
    """
    _, base = _newest(spark, root)
    whole = spark.read.parquet(f"{root}/base/version={base}")
    changes = committed(spark, root, "changes")
    if changes is None:
        return whole
    changes = changes.where(F.col("batch_id") > base)
    last = first_per(changes, KEY, [F.col("batch_id").desc()]).where("NOT gone")
    return whole.join(changes.select(*KEY).distinct(), KEY, "left_anti").unionByName(last.select(*whole.columns))


def apply_batch(spark: SparkSession, root: str, batch_id: int, judge: Callable[[DataFrame], DataFrame], derive: Derive) -> bool:
    """Judge a batch against the committed state, write what follows from it, commit.  False if it was done before.

    ``judge`` takes the state and returns one table, written once as ``judged``; ``derive`` takes that table as
    written, and the state, and returns the other tables, ``changes`` among them.
    """
    if not commits(spark, root).where(F.col("batch_id") == batch_id).isEmpty():
        return False
    now = state(spark, root)
    place = f"batch_id={batch_id}"
    judge(now).write.mode("overwrite").parquet(f"{root}/judged/{place}")
    judged = spark.read.parquet(f"{root}/judged/{place}")
    for name, table in derive(judged, now).items():
        table.write.mode("overwrite").parquet(f"{root}/{name}/{place}")
    _commit(spark, root, batch_id, _newest(spark, root)[1])
    return True


def compact(spark: SparkSession, root: str) -> None:
    """Write the state as a new snapshot; later readers start from it.  Earlier files stay for readers under way."""
    last, base = _newest(spark, root)
    if last > base:
        state(spark, root).write.mode("overwrite").parquet(f"{root}/base/version={last}")
        _commit(spark, root, last, last)
