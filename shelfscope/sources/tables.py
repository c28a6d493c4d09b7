"""Append-only and snapshot tables, JSON lines, reports and analytics rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.numbering import first_per


def missing_lines(incoming: DataFrame, existing: DataFrame, line: str = "line") -> DataFrame:
    """Lines not in the table yet, each once."""
    return incoming.dropDuplicates([line]).join(existing.select(line).distinct(), line, "left_anti")


def append_missing(incoming: DataFrame, path: str, line: str = "line") -> None:
    """Append the new lines of a job to a text table."""
    spark = incoming.sparkSession
    # an empty first part makes the table readable on the first run
    incoming.select(line).limit(0).write.mode("append").text(path)
    existing = spark.read.text(path).withColumnRenamed("value", line)
    missing_lines(incoming.select(line), existing, line).write.mode("append").text(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Report with header; quotes are doubled."""
    df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def deletion_rows(removed: DataFrame, as_of: Column, reason: str, direct_url: Column, identity: Column) -> DataFrame:
    """History rows of removed products."""
    return removed.select(
        as_of.alias("deleted_at"), "article_id", F.lit(reason).alias("reason"), "rank", "name", "capacity",
        "review_count", F.coalesce("base_url", F.lit("")).alias("base_url"),
        F.coalesce(direct_url, "base_url", F.lit("")).alias("direct_url"), identity.alias("identity_key"))


def append_deletions(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").partitionBy("deleted_at").parquet(path)


def changed_rows(before: DataFrame, after: DataFrame, key: list[str], fields: list[str], as_of: Column) -> DataFrame:
    """Rows of ``after`` that are new or differ, stamped with the run date."""
    old = before.select(*key, F.struct(*fields).alias("_old"))
    new = after.select(*key, *fields)
    joined = new.join(old, key, "left")
    differs = ~F.struct(*fields).eqNullSafe(F.col("_old"))
    return joined.filter(differs).drop("_old").withColumn("updated_at", as_of)


def append_snapshot(changed: DataFrame, path: str, run_date: str) -> None:
    """One partition per run; a repeated run replaces its own partition only."""
    (changed.withColumn("run_date", F.lit(run_date).cast("date")).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("run_date").parquet(path))


def latest_snapshot(snapshots: DataFrame, key: list[str]) -> DataFrame:
    return first_per(snapshots, key, [F.col("run_date").desc()])


# Report kinds by file name
_KINDS = [
    (r"^(?:capacity-review|ai-capacity-input)-", "capacity-review"),
    (r"^product-match-(?:input|output)-", "product-match"),
    (r"^addition-candidates-", "addition-candidates"),
]


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Path and size of all files below a folder; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")


def latest_reports(files: DataFrame, kind: str = "all", limit: int = 5) -> DataFrame:
    """Newest report files of a kind, by the date in the name."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    found = F.coalesce(*[F.when(name.rlike(p), F.lit(k)) for p, k in _KINDS])
    day = F.regexp_extract(name, r"(\d{4}-\d{2}-\d{2})", 1)
    rows = files.select(
        F.col("path").alias("file"), found.alias("kind"),
        F.when(day != "", day).otherwise("0000-00-00").alias("date"), F.col("length").alias("size"))
    rows = rows.filter("kind IS NOT NULL")
    if kind != "all":
        rows = rows.filter(F.col("kind") == kind)
    return rows.orderBy(F.col("date").desc(), F.col("file").desc()).limit(limit)


def named_values(rows: DataFrame, headers: str, values: str) -> DataFrame:
    """Parallel header and value lists to a map; missing values become empty text."""
    at = F.transform(headers, lambda h, i: F.coalesce(F.get(F.col(values), i), F.lit("")))
    return rows.withColumn("named", F.map_from_arrays(headers, at))
