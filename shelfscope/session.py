"""Session settings and lineage cuts shared by all jobs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

# A dimension up to this many rows is sent to all tasks.
MAX_BROADCAST_ROWS = 50_000
_CHECKPOINT_KEY = "spark.checkpoint.dir"


def prepare(spark: SparkSession) -> SparkSession:
    """Set the runtime options the jobs rely on.

    A join side is broadcast only behind a check of its size: Spark's own
    threshold, or ``checked_broadcast`` for dimensions.  Above it the sort-merge
    join with skew splitting is the other way.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    # HotSpot never compiles a method beyond 8,000 bytes: parsers that Spark puts into one such method would be
    # interpreted, so they are left to Spark's projections, which split them
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    # split hot keys even where the split costs one more exchange
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach; only local mode may make its own."""
    folder = spark.conf.get(_CHECKPOINT_KEY, None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {_CHECKPOINT_KEY} to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="shelfscope-")
    spark.conf.set(_CHECKPOINT_KEY, folder)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def checked_broadcast(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast if the table has at most ``max_rows`` rows, else leave it to Spark.

    For dimensions without file statistics, whose size Spark learns only after
    it has shuffled the large side as well.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the written rows.

    Used where two branches of a plan must see the very same rows although an
    executor may be lost in between.
    """
    path = scratch_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
