"""From documents to packed training sequences: each stage reads what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfscope.llm import best_fit, decision_list, deobfuscate, jaccard_dedup
from shelfscope.llm.common import cut_lineage, scratch_path, table
from shelfscope.llm.queries import vocabulary_file


def _numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str], list]:
    """The same rows under names that clash with no result, those of id and text, and the way back."""
    names = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    ask = {"doc_id": names["doc_id"], "text": names["text"], "carry": list(names.values())}
    return docs.toDF(*names.values()), ask, [F.col(n).alias(c) for c, n in names.items()]


def _small_batches(spark: SparkSession) -> None:
    """Texts go to Python in batches of a few megabytes, so that a task's memory does not grow with their length."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose restored text scores below one half."""
    _small_batches(spark)
    scorer = deobfuscate.fit(docs, table(spark, sf_dir, "labels"))
    rows, ask, back = _numbered(docs)
    return deobfuscate.score(rows, scorer, **ask).where("predicted = 0").select(*back)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the decision list learned from the labels."""
    _small_batches(spark)
    rules = decision_list.fit(docs, table(spark, sf_dir, "labels"))
    rows, ask, back = _numbered(docs)
    return decision_list.judge_quality(rows, rules, **ask).where("kept").select(*back)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their near copies: five-word shingles of Jaccard similarity 0.8 or more.

    The popcount grid of op10 links near fingerprints and the shingles confirm them; MinHash bands bring in the
    similar pairs that differ in more bits.  One row of each group stays, that of the smallest id; rows without id come last, ties go by text and then
    by the row's number in a written table.  Rows of one id that are no near copies all stay.
    """
    _small_batches(spark)
    rows, ask, back = _numbered(docs)
    doc_id, text = ask["doc_id"], ask["text"]
    rows = cut_lineage(jaccard_dedup.prints(rows.withColumn("_row", F.monotonically_increasing_id()), text))
    order = F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"), F.xxhash64(text).alias("text"), "_row")
    placed = rows.groupBy("_set").agg(F.min(order).alias("first")).join(
        jaccard_dedup.roots(rows, text).withColumnRenamed("node", "_set"), "_set", "left")
    first = placed.groupBy(F.coalesce("root", "_set")).agg(F.min("first").alias("first")).select("first._row")
    return rows.join(first, "_row", "left_semi").select(*back)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their place in sequences of 2048 tokens."""
    _small_batches(spark)
    return best_fit.pack_documents(docs, vocabulary_file("byte_bpe_50k.json"))


STAGES = [("toxicity", toxicity), ("quality", quality), ("near_dedup", near_dedup), ("packing", packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
