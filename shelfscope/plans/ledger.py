"""Decision lines applied in order, as a fold and as a stream over a committed catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import fold as L
from ..session import cut_lineage, scratch_path
from ..sources.jsonl import tolerant
from ..streaming import drop_folder as S
from ..streaming import ledger
from . import fixtures as fx
from .catalogue import SHELF, shelf
from .registry import query

# Lines by kind of article (its number mod 8, articles of three products only).  Each line: kind, file, number,
# rank, name it expects, action, further fields.  N1, N2, N3 are the names at first, M1 is "N1 v2".
_LINES = [
    (0, "1/a", 1, 1, "N1", "replace", "name M1 price 1"), (0, "1/b", 1, 1, "M1", "replace", "price 2"),
    (0, "1/b", 2, 1, "N1", "replace", "price 3"),
    (1, "1/a", 1, 1, "N1", "delete", ""), (1, "1/b", 1, 1, "N2", "replace", "price 5"), (1, "1/b", 2, 2, "N2", "replace", "price 6"),
    (2, "1/a", 1, 1, "N1", "delete", ""), (2, "1/a", 2, 2, "N2", "delete", ""), (2, "1/a", 3, 3, "N3", "delete", ""),
    (3, "1/a", 1, 2, "N2", "replace", "name N1"), (3, "1/b", 1, 1, "N1", "delete", ""), (3, "2/c", 1, 2, "N1", "replace", "price 7"),
    (4, "1/a", 1, 1, "N1", "merge", ""), (4, "1/b", 1, 9, "N1", "replace", ""), (4, "2/c", 1, 1, "N1", "review", ""),
    (5, "2/c", 1, 3, "N3", "replace", "price 3"),
    (6, "1/a", 1, 1, "N1", "delete", ""), (6, "2/c", 1, 1, "N2", "delete", ""), (6, "2/c", 2, 1, "N2", "delete", ""),
]
# what becomes of each line: outcome, effect
_SEEN = ["processed replace", "processed replace", "failed ", "processed delete", "processed replace", "failed ",
         "processed review", "processed delete", "processed delete", "processed replace", "processed review",
         "processed replace", "failed ", "failed ", "processed review", "processed replace", "processed delete",
         "processed delete", "failed "]

_NAME = "concat(name, ' ', CAST(orig_idx AS VARCHAR))"
_TRIPLES = f"""{SHELF}, named AS (SELECT orig_idx, article_id, orig_idx // 3 AS a, orig_idx % 3 + 1 AS rank, {_NAME} AS name, price FROM shelf),
kinds AS (SELECT a, any_value(article_id) AS article_id, any_value(a % 8) AS kind FROM named GROUP BY a HAVING count(*) = 3)"""


def _products(spark: SparkSession, sf: str) -> DataFrame:
    return shelf(spark, sf).select(
        "article_id", "orig_idx", (F.col("orig_idx") % 3 + 1).cast("long").alias("rank"),
        F.concat("name", F.lit(" "), F.col("orig_idx").cast("string")).alias("name"), "price", "review_count", "capacity", "base_url")


def _line_rows(products: DataFrame) -> DataFrame:
    """``file, line_no, raw``, three files of lines, broken and empty ones among them."""
    a = F.floor(F.col("orig_idx") / 3)
    threes = products.groupBy(a.alias("a"), "article_id").agg(
        F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("rank", "name", "price"))).alias("p")).where("n = 3")
    said = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("kind", "file", "no", "rank", "expect", "action", "new"), x)])
                     for x in _LINES])
    rows = threes.select("a", "article_id", "p", F.inline(said)).where("a % 8 = kind")
    first = F.col("p")[0]
    name = F.when(F.col("expect") == "M1", F.concat(first["name"], F.lit(" v2"))).otherwise(
        F.get("p", F.substring("expect", 2, 1).cast("int") - 1)["name"])
    new_name = F.when(F.col("new").startswith("name M1"), F.concat(first["name"], F.lit(" v2"))).when(
        F.col("new").startswith("name N1"), first["name"])
    raw = F.to_json(F.struct(
        F.concat(F.lit("src/content/articles/"), "article_id", F.lit(".md")).alias("articleFile"), "rank", name.alias("currentName"),
        F.when(F.col("action") == "delete", "review").otherwise(F.col("action")).alias("action"),
        F.when(F.col("action") == "delete", "delete").alias("decision"), F.lit("https://x.example/1").alias("selectedAffiliateUrl"),
        new_name.alias("newName"), (first["price"] + F.nullif(F.regexp_extract("new", r"price (\d)", 1), F.lit("")).cast("long")).alias("newPrice"),
        F.concat_ws("-", "kind", "file", "no").alias("reason")))
    bad = threes.where("a % 8 = 7").select(F.lit("1/a").alias("file"), (F.col("a") * 10).alias("line_no"), F.lit("{broken").alias("raw"))
    return rows.select("file", (F.col("a") * 10 + F.col("no")).alias("line_no"), raw.alias("raw")).unionByName(bad)


@query("decision_fold", fx.with_ctes("products", more=_TRIPLES) + f""",
said AS (SELECT unnest({[x[0] for x in _LINES]}) AS kind, unnest({[x[1] for x in _LINES]}) AS file, unnest({[x[2] for x in _LINES]}) AS no, unnest({_SEEN}) AS seen)
SELECT file, a * 10 + no AS line_no, article_id, split_part(seen, ' ', 1) AS outcome, nullif(split_part(seen, ' ', 2), '') AS effect
FROM kinds JOIN said USING (kind) UNION ALL SELECT '1/a', a * 10, NULL, 'failed', NULL FROM kinds WHERE kind = 7""")
def decision_fold(spark: SparkSession, sf: str) -> DataFrame:
    products = cut_lineage(_products(spark, sf))
    lines = cut_lineage(_line_rows(products))
    folded = L.fold_decisions(tolerant(lines), products.select("article_id").distinct(), products)
    return L.outcomes(folded).select("file", "line_no", "article_id", "outcome", "effect")


@query("decision_state", fx.with_ctes("products", more=_TRIPLES) + """,
p AS (SELECT n.*, coalesce(k.kind, 7) AS kind, first_value(n.name) OVER w AS n1, first_value(price) OVER w AS p1 FROM named n LEFT JOIN kinds k USING (a)
  WINDOW w AS (PARTITION BY n.a ORDER BY n.rank))
SELECT article_id, orig_idx, CASE WHEN kind IN (1, 6) THEN rank - CASE kind WHEN 1 THEN 1 ELSE 2 END ELSE rank END AS rank,
  CASE WHEN kind = 0 AND rank = 1 THEN concat(name, ' v2') WHEN kind = 3 AND rank = 2 THEN n1 ELSE name END AS name,
  CASE WHEN kind = 0 AND rank = 1 THEN p1 + 2 WHEN kind = 1 AND rank = 2 THEN p1 + 5 WHEN kind = 3 AND rank = 1 THEN p1 + 7 WHEN kind = 5 AND rank = 3 THEN p1 + 3 ELSE price END AS price,
  CASE WHEN (kind = 0 AND rank = 1) OR (kind = 1 AND rank = 2) OR (kind = 3 AND rank IN (1, 2)) OR (kind = 5 AND rank = 3) THEN 'https://x.example/1' ELSE base_url END AS base_url
FROM p JOIN (SELECT orig_idx, base_url FROM shelf) USING (orig_idx)
WHERE NOT ((kind = 1 AND rank = 1) OR (kind = 2 AND rank > 1) OR (kind = 6 AND rank < 3))""")
def decision_state(spark: SparkSession, sf: str) -> DataFrame:
    """The catalogue after two batches of decision files, the second judged against what the first has left."""
    root, folder, mark = (scratch_path(spark, n) for n in ("catalogue", "drop", "mark"))
    products = _products(spark, sf)
    ledger.create(products, root)
    lines = cut_lineage(_line_rows(products))
    judge = S.match_judge(cut_lineage(products.select("article_id").distinct()))
    tables = S.match_tables(F.lit("2024-03-10").cast("date"))
    for day in ("1", "2"):
        mine = lines.where(F.col("file").startswith(day)).repartition(
            F.regexp_extract("raw", r"articles/([^\"]*)", 1)).sortWithinPartitions("line_no")
        mine.select("raw", F.substring("file", 3, 1).alias("part")).write.partitionBy("part").text(f"{folder}/day={day}")
        S.run_decisions(spark, folder, root, mark, judge, tables, glob="*.txt").awaitTermination()
    return ledger.state(spark, root).select("article_id", "orig_idx", "rank", "name", "price", "base_url")
