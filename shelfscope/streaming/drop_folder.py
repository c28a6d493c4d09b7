"""Decision drop folders as streams: each new file is judged and applied to the catalogue once.

The batch operators run unchanged inside ``foreachBatch``.  The stream's checkpoint remembers which files were
read, the catalogue's commits which batches were applied (``ledger``); a batch that is repeated after a failure
gives the same catalogue as one that went through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as T
from ..functions import urls as U
from ..functions.arrow import nfkc_lower
from ..operators import decisions as D
from ..operators import fold as L
from ..session import cut_lineage
from ..sources.jsonl import read_lines, tolerant
from ..sources.tables import deletion_rows
from . import ledger

# lines of a batch and the committed products, to one table that holds all that was decided
Judge = Callable[[DataFrame, DataFrame], DataFrame]


def decision_stream(spark: SparkSession, folder: str, max_files: int = 1000, glob: str = "*.jsonl") -> DataFrame:
    """Paths of decision files as they arrive, a bounded number per batch."""
    return (
        spark.readStream.format("binaryFile").schema(
            "path string, modificationTime timestamp, length long, content binary")
        .option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", max_files).load(folder)
        # the content column is never read
        .select("path")
    )


def run_decisions(
    spark: SparkSession, folder: str, root: str, checkpoint: str, judge: Judge, derive: ledger.Derive,
    trigger: dict | None = None, glob: str = "*.jsonl", max_files: int = 1000,
) -> StreamingQuery:
    """Apply new files to the catalogue below ``root``, batch by batch.

    Each batch sees the catalogue as the batch before it left it.  A catalogue belongs to one checkpoint, whose
    batch numbers its commits carry.
    """
    def apply(batch: DataFrame, batch_id: int) -> None:
        # file names only, at most max_files of them
        paths = [r["path"] for r in batch.toLocalIterator()]
        if not paths:
            return
        spark = batch.sparkSession
        lines = cut_lineage(read_lines(spark, paths, glob))
        ledger.apply_batch(spark, root, batch_id, lambda now: judge(tolerant(lines), now), derive)

    return (
        decision_stream(spark, folder, max_files, glob).writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    )


def match_judge(articles: DataFrame, wanted: Column | None = None) -> Judge:
    """Match decisions, each line applied to what the lines before it left."""
    return lambda lines, now: L.fold_decisions(lines, articles, now, wanted)


def match_tables(as_of: Column) -> ledger.Derive:
    """Outcomes per line, files to keep, changed products and the history of deleted ones."""
    def derive(judged: DataFrame, now: DataFrame) -> dict[str, DataFrame]:
        lines = L.outcomes(judged)
        changes = L.changed_products(judged, now)
        gone = judged.where("outcome IS NULL AND gone").select(*ledger.KEY)
        removed = now.join(gone, ledger.KEY, "left_semi")
        return {
            "outcomes": lines, "files": D.finalize_files(lines), "changes": changes,
            "deleted": deletion_rows(removed, as_of, "ai-review", U.direct_item_url(F.col("base_url")),
                                     T.identity_key(nfkc_lower(F.col("name")))),
        }

    return derive


def size_judge(target_unit: Column | None = None) -> Judge:
    """Pack-size decisions under stale-data guards."""
    return lambda lines, now: D.size_updates(D.stale_guard(lines, now), target_unit)


def size_tables(judged: DataFrame, now: DataFrame) -> dict[str, DataFrame]:
    """Outcomes per line, files to keep, changed products, and those that later jobs must not resize."""
    set_ = judged.where("set_capacity IS NOT NULL").select("article_id", "orig_idx")
    changed = D.apply_size_updates(now.join(set_, ledger.KEY, "left_semi"), judged)
    done = judged.where("outcome = 'processed'")
    return {
        "outcomes": judged.select("file", "line_no", "raw", "outcome", "message"), "files": D.finalize_files(judged),
        "changes": changed.select(*now.columns, F.lit(False).alias("gone")),
        "frozen": done.select("article_id", "rank", F.col("p_name").alias("name"), F.col("p_url").alias("base_url")),
    }
