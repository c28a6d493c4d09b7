"""Near-duplicates by the Jaccard similarity of word shingles.

The popcount grid of ``popcount_dedup`` links near fingerprints first, MinHash bands propose what differs in more
bits, and the shingles themselves decide on every link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import popcount_dedup
from .common import components, cut_lineage, present
from .popcount_dedup import shingles

SHINGLE = 5
PERCENT = 80
# A pair at the threshold shares no band with probability (1 - 0.8^5)^32 = 3e-6, a closer one less.
BANDS, BAND_ROWS = 32, 5
# Members of a cell of which all pairs are listed; larger cells are cut into parts of PART members.
LISTED, PART = 64, 512
_SEED = 42
_RNG = np.random.default_rng(5)
_FLIP, _ODD = (_RNG.integers(0, 1 << 64, BANDS * BAND_ROWS, np.uint64, endpoint=False) for _ in range(2))
_ODD = _ODD | np.uint64(1)


def shingle_set(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; a text of fewer words is one shingle, no words are none."""
    import xxhash

    digest = xxhash.xxh64_digest
    return np.unique(np.frombuffer(b"".join([digest(p, _SEED) for p in shingles(text, shingle)]), "<u8"))


def bands(found: np.ndarray) -> list[int]:
    """One signed 64-bit cell for each band of ``BAND_ROWS`` minima; none for an empty set."""
    import xxhash

    if not len(found):
        return []
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(found), 1024):  # bounds the memory of a long text
        least = np.minimum(least, ((found[at: at + 1024, None] ^ _FLIP) * _ODD).min(axis=0))
    row = least.astype("<u8").tobytes()
    cut = 8 * BAND_ROWS
    cells = np.array([xxhash.xxh64_intdigest(row[i * cut: (i + 1) * cut], i) for i in range(BANDS)], np.uint64)
    return cells.view(np.int64).tolist()


def prints(docs: DataFrame, text: str, shingle: int = SHINGLE) -> DataFrame:
    """All columns and ``_set``, the hash of the shingle set, ``_n``, its size, ``_bands``, and ``_fp``, the SimHash."""
    import xxhash

    at, names = docs.columns.index(text), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):  # bounds the memory of the sets
                batch = whole.slice(start, 1024)
                texts = present(batch.column(at).to_pylist())
                sets = [shingle_set(t, shingle) for t in texts]
                ids = np.array([xxhash.xxh64_intdigest(s.tobytes(), _SEED) for s in sets], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(ids), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([bands(s) for s in sets], pa.list_(pa.int64())),
                     pa.array([popcount_dedup.fingerprint(t, shingle) for t in texts], pa.int64())],
                    [*names, "_set", "_n", "_bands", "_fp"])

    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema)
    return docs.mapInArrow(run, kept + "_set long, _n long, _bands array<long>, _fp long")


def _sets(rows: DataFrame, shingle: int) -> DataFrame:
    """``_set`` and its hashes for rows of ``_set`` and text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(t, shingle).view(np.int64) for t in present(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["_set", "hashes"])

    return rows.mapInArrow(run, "_set long, hashes array<long>")


def spanning(sets: list[np.ndarray], percent: int = PERCENT) -> list[tuple[int, int]]:
    """Indices of links that span what the similar pairs among these sorted sets connect, breadth first."""
    sizes = np.array([len(s) for s in sets])
    left = np.arange(len(sets))
    out: list[tuple[int, int]] = []
    while left.size:
        queue, left = [left[0]], left[1:]
        while queue and left.size:
            i = queue.pop()
            one, n = sets[i], sizes[i]
            fits = np.minimum(sizes[left], n) * 100 >= percent * np.maximum(sizes[left], n)
            if not fits.any():
                continue
            some = left[fits]
            all_of = np.concatenate([sets[j] for j in some])
            spot = np.minimum(np.searchsorted(one, all_of), n - 1)
            starts = np.concatenate(([0], np.cumsum(sizes[some])[:-1]))
            both = np.add.reduceat((one[spot] == all_of).astype(np.int64), starts)
            found = some[(100 + percent) * both >= percent * (sizes[some] + n)]
            out.extend((i, j) for j in found)
            queue.extend(found)
            left = np.setdiff1d(left, found, assume_unique=True)
    return out


def _close(a: Column, b: Column, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs ``a``, ``b`` whose sets are similar."""
    pairs = pairs.join(sets.select(F.col("_set").alias("a"), F.col("hashes").alias("p")), "a")
    pairs = pairs.join(sets.select(F.col("_set").alias("b"), F.col("hashes").alias("q")), "b")
    both = F.size(F.array_intersect("p", "q"))
    return pairs.where((100 + percent) * both >= percent * (F.size("p") + F.size("q"))).select("a", "b")


def _near_prints(one: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a``, ``b`` of sets that the popcount grid brings together: near fingerprints, by their smallest sets,
    and equal ones, each with the smallest set of its own."""
    held = one.where("_n > 0").select("_set", "_n", "_fp")
    heads = cut_lineage(held.groupBy("_fp").agg(F.min(F.struct("_set", "_n")).alias("head")))
    near = popcount_dedup.links(heads.select(F.col("_fp").alias("fp")))
    near = near.join(heads.select(F.col("_fp").alias("a"), F.col("head").alias("x")), "a").join(
        heads.select(F.col("_fp").alias("b"), F.col("head").alias("y")), "b").select("x", "y")
    same = held.join(heads, "_fp").where("_set <> head._set").select(
        F.col("head").alias("x"), F.struct("_set", "_n").alias("y"))
    pairs = near.unionByName(same).where(_close(F.col("x._n"), F.col("y._n"), percent))
    return pairs.select(F.least("x._set", "y._set").alias("a"), F.greatest("x._set", "y._set").alias("b")).distinct()


def links(docs: DataFrame, text: str, percent: int = PERCENT, shingle: int = SHINGLE, listed: int = LISTED,
          part: int = PART) -> DataFrame:
    """Links ``a``, ``b`` between sets of ``docs`` (``_row``, text, ``_set``, ``_n``, ``_bands``, ``_fp``) that connect
    all similar ones which share a band or stand within the popcount grid's bits.

    The grid's links are confirmed by the shingles and contracted; cells whose sets they connect drop out, as do
    cells of one set.  Of cells of at most ``listed`` sets all pairs between components are listed once and
    compared by their shingles.  A larger cell is cut by hash, and each pair of its parts is a task of its own,
    which gives links that span the same components.
    """
    about = docs.groupBy("_set").agg(F.min(F.struct("_row", "_n", "_fp")).alias("r")).select("_set", "r.*")
    one = about.select("_set", "_row")
    near = cut_lineage(_near_prints(about, percent))
    spots = docs.join(one, ["_set", "_row"], "left_semi").select(F.explode("_bands").alias("cell"), "_set", "_n")
    sizes = spots.groupBy("cell").count().where("count > 1")
    spots = cut_lineage(spots.join(sizes, "cell"))
    asked = spots.select("_set").unionByName(near.select(F.explode(F.array("a", "b")).alias("_set"))).distinct()
    wanted = one.join(asked, "_set", "left_semi")
    sets = cut_lineage(_sets(docs.join(wanted.select("_row"), "_row", "left_semi").select("_set", text), shingle))
    near = cut_lineage(_confirmed(near, sets, percent))

    roots = components(near).withColumnRenamed("node", "_set")
    spots = spots.join(roots, "_set", "left").withColumn("root", F.coalesce("root", "_set"))
    apart = spots.groupBy("cell").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("cell")
    spots = cut_lineage(spots.join(apart, "cell"))

    few = spots.where(f"count <= {listed}").groupBy("cell").agg(F.collect_list(F.struct("_set", "_n", "root")).alias("s"))
    pairs = few.select(F.explode("s").alias("x"), "s").select("x", F.explode("s").alias("y"))
    pairs = pairs.where((F.col("x._set") < F.col("y._set")) & (F.col("x.root") != F.col("y.root"))
                        & _close(F.col("x._n"), F.col("y._n"), percent))
    pairs = pairs.select(F.col("x._set").alias("a"), F.col("y._set").alias("b")).distinct()
    pairs = near.unionByName(_confirmed(pairs, sets, percent))

    many = spots.where(f"count > {listed}").withColumn("parts", F.ceil(F.col("count") / part))
    own = F.pmod(F.xxhash64("_set"), F.col("parts"))
    spread = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda o: F.struct(
        F.least(o, own).alias("i"), F.greatest(o, own).alias("j")))
    many = many.withColumn("pair", F.explode(spread)).select("cell", "pair.i", "pair.j", "_set").join(sets, "_set")
    many = many.select("cell", "i", "j", "_set", "hashes").repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(ids: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
            at = spanning(sets, percent)
            return pa.RecordBatch.from_arrays([pa.array([ids[i] for i, _ in at], pa.int64()),
                                               pa.array([ids[j] for _, j in at], pa.int64())], ["a", "b"])

        before, ids, sets = None, [], []
        for batch in batches:
            hashes = batch.column(4)
            ends = hashes.offsets.to_numpy()
            values = hashes.values.to_numpy().view(np.uint64)
            keys = zip(*(batch.column(k).to_pylist() for k in range(3)))
            for row, (key, name) in enumerate(zip(keys, batch.column(3).to_pylist())):
                if key != before and ids:
                    yield found(ids, sets)
                    ids, sets = [], []
                before = key
                ids.append(name)
                sets.append(values[ends[row]: ends[row + 1]].copy())
        if ids:
            yield found(ids, sets)

    return pairs.unionByName(many.mapInArrow(run, "a long, b long"))


def roots(docs: DataFrame, text: str, percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """``node``, ``root`` for the sets of ``docs`` (see ``links``) that are similar to another one."""
    return components(links(docs, text, percent, shingle))
