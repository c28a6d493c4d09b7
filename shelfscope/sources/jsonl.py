"""Decision files and other JSON lines, read without failing on bad lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


def read_lines(spark: SparkSession, path: str | list[str], glob: str = "*.jsonl") -> DataFrame:
    """``file, line_no, raw`` of all matching files below a folder.

    Files stay splittable.  Rows come in order inside a split, so a line number
    is the number of lines in earlier splits of the file plus the place in its
    own split; only one row per split is exchanged for that.
    """
    lines = (
        spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
        .option("lineSep", "\n").text(path)
        .select(F.regexp_replace("value", r"\r$", "").alias("raw"),
                F.col("_metadata.file_path").alias("file"),
                F.col("_metadata.file_block_start").alias("_split"))
        .withColumn("_seq", F.monotonically_increasing_id())
    )
    earlier = Window.partitionBy("file").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    splits = lines.groupBy("file", "_split").agg(F.count("*").alias("_n"), F.min("_seq").alias("_first"))
    starts = splits.select(
        "file", "_split", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    return lines.join(starts, ["file", "_split"]).select(
        "file", (F.col("_before") + F.col("_seq") - F.col("_first") + 1).alias("line_no"), "raw")


def tolerant(lines: DataFrame) -> DataFrame:
    """Add ``is_empty``, ``is_ok``, ``is_object`` and the parsed ``body``."""
    body = F.try_parse_json("raw")
    empty = F.col("raw").rlike(r"^\s*$")
    return lines.withColumn("body", F.when(~empty, body)).withColumns({
        "is_empty": empty,
        "is_ok": empty | F.col("body").isNotNull(),
        "is_object": F.coalesce(F.schema_of_variant("body").startswith("OBJECT"), F.lit(False)),
    })


def text_at(body: Column, path: str) -> Column:
    """Text value at a path; values of other types count as absent."""
    at = F.try_variant_get(body, path, "variant")
    return F.when(F.schema_of_variant(at) == "STRING", F.try_variant_get(body, path, "string"))


def number_at(body: Column, path: str) -> Column:
    """Number at a path; values of other types count as absent."""
    at = F.try_variant_get(body, path, "variant")
    return F.when(
        F.schema_of_variant(at).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(body, path, "double"))


def has_key(body: Column, path: str) -> Column:
    return F.try_variant_get(body, path, "variant").isNotNull()
