"""Nearest neighbours by vantage-point trees, one per shard, searched by blocks of queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .common import cut_lineage

SHARD_ROWS = 8192
QUERY_ROWS = 4096
LEAF_ROWS = 512
_EPS = 1e-7
# Query and point pairs compared at a time.
_PAIRS = 1 << 17


class Tree:
    """Vantage-point tree over rows of ``points``; a leaf holds at most ``LEAF_ROWS`` rows."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF_ROWS):
        self.points, self.leaf = points, leaf
        self.root = self._build(np.arange(len(points)))

    def _build(self, rows: np.ndarray):
        if len(rows) <= self.leaf:
            return rows
        centre = self.points[rows].mean(axis=0)
        vantage = self.points[rows[np.argmax(((self.points[rows] - centre) ** 2).sum(axis=1))]]
        far = np.sqrt(((self.points[rows] - vantage) ** 2).sum(axis=1))
        radius = np.median(far)
        inside = far <= radius
        if inside.all():
            if (far == far[0]).all():
                return rows  # all equally far, copies for instance: nothing to split
            inside = far < radius
        return vantage, radius, self._build(rows[inside]), self._build(rows[~inside])

    def search(self, queries: np.ndarray, visit, reach: np.ndarray, factor: float) -> None:
        """Call ``visit(query rows, point rows)`` for each leaf that may hold a nearer point.

        ``reach`` is each query's distance to its worst result so far, kept up to date by ``visit``.  A side
        is passed over if its nearest possible point, by the triangle inequality, lies beyond
        ``reach / factor``: 1 is exact, more prunes harder.
        """
        self._search(self.root, np.arange(len(queries)), queries, visit, reach, factor)

    def _search(self, node, who, queries, visit, reach, factor) -> None:
        if not len(who):
            return
        if isinstance(node, np.ndarray):
            visit(who, node)
            return
        vantage, radius, inside, outside = node
        d = np.sqrt(((queries[who] - vantage) ** 2).sum(axis=1))
        near = d <= radius
        self._search(inside, who[near], queries, visit, reach, factor)
        self._search(outside, who[~near], queries, visit, reach, factor)
        bound = reach[who] / factor + _EPS
        self._search(inside, who[~near & (d - radius <= bound)], queries, visit, reach, factor)
        self._search(outside, who[near & (radius - d <= bound)], queries, visit, reach, factor)


def exact_scores(queries: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Inner products added up coordinate by coordinate, so that equal vectors have equal scores."""
    return np.cumsum(queries * points, axis=1)[:, -1]


def search_shard(ids: np.ndarray, points: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int,
                 norm: float, factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best of a shard for each query: number of the query's row, vector id, score.

    Largest inner product becomes smallest distance with one more coordinate that lifts all points to
    the length ``norm``.  Ties are settled by the exact score and then by id.
    """
    lift = np.sqrt(np.maximum(norm * norm - (points * points).sum(axis=1), 0))
    raised = np.concatenate((points, lift[:, None]), axis=1)
    asked = np.concatenate((queries, np.zeros((len(queries), 1))), axis=1)
    size = (queries * queries).sum(axis=1)
    tops = np.full((len(queries), k), -np.inf)
    best = np.full((len(queries), k), -1)
    reach = np.full(len(queries), np.inf)

    def visit(who: np.ndarray, rows: np.ndarray) -> None:
        step = max(1, _PAIRS // len(rows))
        for i in range(0, len(who), step):
            compare(who[i: i + step], rows)

    def compare(who: np.ndarray, rows: np.ndarray) -> None:
        rough = queries[who] @ points[rows].T
        rough[query_ids[who][:, None] == ids[rows][None, :]] = -np.inf
        floor = tops[who, -1]
        if len(rows) > k:
            floor = np.maximum(floor, np.partition(rough, -k, axis=1)[:, -k])
        q, r = np.nonzero((rough >= (floor - _EPS * (1 + np.abs(floor)))[:, None]) & np.isfinite(rough))
        if not len(q):
            return
        score = exact_scores(queries[who[q]], points[rows[r]])
        old_q, old_r = np.nonzero(best[who] >= 0)
        all_q = np.concatenate((old_q, q))
        all_s = np.concatenate((tops[who][old_q, old_r], score))
        all_p = np.concatenate((best[who][old_q, old_r], rows[r]))
        order = np.lexsort((ids[all_p], -all_s, all_q))
        all_q, all_s, all_p = all_q[order], all_s[order], all_p[order]
        place = np.arange(len(all_q)) - np.searchsorted(all_q, all_q)
        keep = place < k
        tops[who[all_q[keep]], place[keep]] = all_s[keep]
        best[who[all_q[keep]], place[keep]] = all_p[keep]
        worst = tops[who, -1]
        gap = np.sqrt(np.maximum(norm * norm + size[who] - 2 * worst, 0))
        reach[who] = np.where(np.isfinite(worst), gap, np.inf)

    Tree(raised).search(asked, visit, reach, factor)
    q, r = np.nonzero(best >= 0)
    return q, ids[best[q, r]], tops[q, r]


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``vec_id``, ``v`` as doubles, without vectors that are null, empty, zero or not finite throughout."""
    v = F.transform(F.col(embedding), lambda x: x.cast("double"))
    out = vectors.where(F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return out.where(F.col("v").isNotNull() & fine & F.exists("v", lambda x: x != 0))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, factor: float = 1.0, shard_rows: int = SHARD_ROWS,
            query_rows: int = QUERY_ROWS, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """The ``k`` vectors of largest inner product for each query, itself left out by its id.

    Returns ``query_id, rank, vec_id, score``, ties to the smaller id.  Vectors are dealt to shards of
    about ``shard_rows`` by hash and queries to blocks of about ``query_rows``; a task holds one shard and
    one block.  Each shard has a vantage-point tree; ``factor`` 1 gives exact results, more prunes harder.
    Vectors of different lengths than most are no match for each other: a query only meets vectors of its
    own length.  Unusable vectors (see ``usable``) take no part; repeated ids are rows of their own, and
    none of those with the query's id is its result.
    """
    points, asked = usable(vectors, vec_id, embedding), usable(queries, vec_id, embedding)
    points, asked = (x.withColumn("dim", F.size("v")) for x in (points, asked))
    size = points.agg(F.count("*"), F.sqrt(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))).first()
    many = asked.count()
    shards, blocks = max(1, -(-size[0] // shard_rows)), max(1, -(-many // query_rows))
    norm = float(size[1] or 1.0) * (1 + 1e-9)
    shard, block = F.pmod(F.xxhash64("vec_id"), F.lit(shards)), F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(blocks))
    points = points.withColumn("shard", shard).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    # one number per query row: rows of one id are ranked apart
    asked = cut_lineage(asked.withColumn("_row", F.monotonically_increasing_id()))
    asked = asked.withColumn("block", block).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"_row": [], "query_id": [], "vec_id": [], "score": []}).astype(
                {"_row": "int64", "query_id": "int64", "vec_id": "int64", "score": "float64"})
        left = left.sort_values("vec_id", kind="stable")
        ids = right["vec_id"].to_numpy()
        q, v, s = search_shard(left["vec_id"].to_numpy(), np.stack(left["v"]), ids, np.stack(right["v"]), k, norm, factor)
        return pd.DataFrame({"_row": right["_row"].to_numpy()[q], "query_id": ids[q], "vec_id": v, "score": s})

    keys = ["dim", F.col("shard").cast("long").alias("shard"), F.col("block").cast("long").alias("block"), "vec_id", "v"]
    found = points.select(*keys).groupBy("dim", "shard", "block").cogroup(
        asked.select(*keys, "_row").groupBy("dim", "shard", "block")).applyInPandas(
        run, "_row long, query_id long, vec_id long, score double")
    order = Window.partitionBy("_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
