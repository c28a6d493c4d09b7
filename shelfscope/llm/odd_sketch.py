"""MinHash near-duplicates whose banded candidates are judged by odd sketches before their full sets are read."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import components, cut_lineage, present
from .popcount_dedup import shingles

SHINGLE = 3
PERCENT = 85
# A pair at the threshold shares no band with probability (1 - 0.85^5)^30 = 2e-8, a closer one less.
BANDS, BAND_ROWS = 30, 5
SAMPLES = BANDS * BAND_ROWS
SKETCH_BITS = 512
# A similar pair's sketches differ in more bits than ``cutoff`` allows with at most this probability.
LOSS = 1e-9
# Sets in a cell whose pairs are listed after the stars; larger cells are cut into parts of PART sets.
LISTED, PART = 48, 512
# Size of the bitmap that keeps texts in place which no candidate pair asks for.
FILTER_BITS = 1 << 24
_SEED = 42
_RNG = np.random.default_rng(11)
_FLIP, _ODD, _FOLD, _MIX = _RNG.integers(0, 1 << 64, (4, SAMPLES), np.uint64, endpoint=False)
_ODD, _FOLD, _MIX = _ODD | np.uint64(1), _FOLD | np.uint64(1), _MIX | np.uint64(1)
_SALT = _RNG.integers(0, 1 << 64, BANDS, np.uint64, endpoint=False)


def shingle_set(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; a text of fewer words is one shingle, no words are none."""
    import xxhash

    digest = xxhash.xxh64_digest
    return np.unique(np.frombuffer(b"".join([digest(p, _SEED) for p in shingles(text, shingle)]), "<u8"))


def minima(found: np.ndarray) -> np.ndarray:
    """The ``SAMPLES`` MinHash values of a set of hashes; the largest number for an empty set."""
    least = np.full(SAMPLES, np.iinfo(np.uint64).max)
    for at in range(0, len(found), 256):  # a block stays in the cache
        least = np.minimum(least, ((found[at: at + 256, None] ^ _FLIP) * _ODD).min(axis=0))
    return least


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """Parity bitmaps, as rows of signed 64-bit words: each sample toggles the bit that its value and number hash to."""
    rows = len(samples)
    spot = ((samples ^ _FLIP) * _FOLD >> np.uint64(40)).astype(np.int64) % SKETCH_BITS
    spot += SKETCH_BITS * np.arange(rows)[:, None]
    odd = np.bincount(spot.ravel(), minlength=rows * SKETCH_BITS).astype(np.uint8) & 1
    return np.packbits(odd).view("<i8").reshape(rows, SKETCH_BITS // 64)


def cells(samples: np.ndarray) -> np.ndarray:
    """One signed 64-bit cell for each band of ``BAND_ROWS`` samples."""
    mixed = (samples * _MIX).reshape(-1, BANDS, BAND_ROWS)
    mixed ^= mixed >> np.uint64(29)
    out = (mixed * _ODD.reshape(BANDS, BAND_ROWS)).sum(axis=2) + _SALT
    return (out ^ out >> np.uint64(32)).view(np.int64)


@cache
def cutoff(percent: int = PERCENT, samples: int = SAMPLES, bits: int = SKETCH_BITS, loss: float = LOSS) -> int:
    """The least number of differing sketch bits that a pair at ``percent`` exceeds with probability ``loss`` or less.

    Unequal samples are binomial; each toggles two bits of the XOR.  The number of odd bits after that many
    throws is a walk with one step up for an even bit and one down for an odd one.
    """
    j = percent / 100
    walk = np.zeros(bits + 1)
    walk[0] = 1.0
    total = np.zeros(bits + 1)
    up = 1 - np.arange(bits + 1) / bits
    for unequal in range(samples + 1):
        total += math.comb(samples, unequal) * (1 - j) ** unequal * j ** (samples - unequal) * walk
        for _ in range(2):
            walk = np.concatenate(([0], (walk * up)[:-1])) + np.concatenate(((walk * (1 - up))[1:], [0]))
    beyond = np.cumsum(total[::-1])[::-1]
    return int(np.argmax(beyond <= loss)) - 1


def estimate(differing: Column, samples: int = SAMPLES, bits: int = SKETCH_BITS) -> Column:
    """Jaccard similarity from the number of differing sketch bits: ``1 + bits / (4 samples) ln(1 - 2 z / bits)``."""
    left = F.greatest(1 - 2 * differing / bits, F.lit(1e-9))
    return F.greatest(1 + bits / (4 * samples) * F.log(left), F.lit(0.0))


def differing(a: Column, b: Column) -> Column:
    """Number of bits in which two sketches differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def _prints(docs: DataFrame, shingle: int) -> DataFrame:
    """``doc_id, text`` and ``_row`` with the set's 128-bit hash, its size, its cells and its sketch."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                sets = [shingle_set(t, shingle) for t in present(batch.column(1).to_pylist())]
                samples = np.array([minima(s) for s in sets], np.uint64).reshape(-1, SAMPLES)
                keys = [xxhash.xxh3_128_digest(s.tobytes(), _SEED) for s in sets]
                width, bands = SKETCH_BITS // 64, cells(samples)
                sketch = odd_sketches(samples)
                as_list = lambda m, w: pa.ListArray.from_arrays(
                    pa.array(np.arange(0, len(sets) * w + 1, w), pa.int32()), pa.array(m.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(keys, pa.binary()), pa.array([len(s) for s in sets], pa.int64()),
                     as_list(bands, BANDS), as_list(sketch, width)],
                    ["_id", "_text", "_row", "set", "n", "cells", "sketch"])

    kind = docs.schema["_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"_id {kind}, _text string, _row long, set binary, n long, cells array<long>, sketch array<long>")


def _filter(nodes: DataFrame) -> np.ndarray:
    """A bitmap of fixed size, ``FILTER_BITS``, in which the bit of each node's hash is set."""
    bit = F.pmod(F.xxhash64("node"), F.lit(FILTER_BITS))
    chunks = nodes.groupBy(F.shiftright(bit, 15).alias("chunk")).agg(F.bitmap_construct_agg(bit.bitwiseAND(32767)).alias("bits"))
    out = np.zeros((FILTER_BITS >> 15, 4096), np.uint8)
    for r in chunks.collect():
        out[r.chunk] = np.frombuffer(r.bits, np.uint8)
    return out.ravel()


def _sets(nodes: DataFrame, prints: DataFrame, shingle: int) -> DataFrame:
    """``node`` and its hashes, written, for the texts of ``prints`` (``_row``, ``_text``) that ``nodes`` asks for.

    Texts that a bitmap of the nodes rules out do not move; of the others only the hashes do.
    """
    nodes = cut_lineage(nodes)
    shared = prints.sparkSession.sparkContext.broadcast(_filter(nodes))
    bit = F.pmod(F.xxhash64("_row"), F.lit(FILTER_BITS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = batch.column(2).to_numpy()
            batch = batch.filter(pa.array(shared.value[bits >> 3] >> (bits & 7).astype(np.uint8) & 1).cast(pa.bool_()))
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                found = [shingle_set(t, shingle).view(np.int64) for t in present(piece.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(found, pa.list_(pa.int64()))], ["node", "hashes"])

    found = prints.where("n > 0").select("_row", "_text", bit.alias("bit")).mapInArrow(run, "node long, hashes array<long>")
    found = cut_lineage(found.join(nodes, "node", "left_semi"))
    shared.unpersist()
    return found


def _may_link(x: Column, y: Column, percent: int) -> Column:
    """Whether two structs of ``n`` and ``sketch`` can reach the threshold: by their sizes, then by their sketches."""
    sizes = F.least(x["n"], y["n"]) * 100 >= F.greatest(x["n"], y["n"]) * percent
    return sizes & (differing(x["sketch"], y["sketch"]) <= cutoff(percent))


def _confirmed(pairs: DataFrame, prints: DataFrame, percent: int, shingle: int) -> DataFrame:
    """Of the pairs ``a``, ``b`` those whose full sets reach the threshold."""
    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    sets = _sets(wanted, prints, shingle)
    full = pairs.join(sets.toDF("a", "p"), "a").join(sets.toDF("b", "q"), "b")
    both = F.size(F.array_intersect("p", "q"))
    return full.where((100 + percent) * both >= percent * (F.size("p") + F.size("q"))).select("a", "b")


def spanning(names: list[int], roots: np.ndarray, sets: list[np.ndarray], sketches: np.ndarray,
             percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links that connect what the similar pairs among these sets connect, breadth first over known components.

    Sets of one root count as connected.  What a link reaches leaves the list together with all of its root,
    so a dense cell costs little more than its rows; never more than rows less one links come out.
    """
    sizes, most = np.array([len(s) for s in sets]), cutoff(percent)
    left = np.arange(len(sets))
    out: list[tuple[int, int]] = []
    while left.size:
        same = roots[left] == roots[left[0]]
        queue, left = left[same].tolist(), left[~same]
        while queue and left.size:
            i = queue.pop()
            some = left[np.minimum(sizes[left], sizes[i]) * 100 >= percent * np.maximum(sizes[left], sizes[i])]
            some = some[np.bitwise_count(sketches[some] ^ sketches[i]).sum(axis=1, dtype=np.int64) <= most]
            if not some.size:
                continue
            one = sets[i]
            all_of = np.concatenate([sets[j] for j in some])
            spot = np.minimum(np.searchsorted(one, all_of), len(one) - 1)
            starts = np.concatenate(([0], np.cumsum(sizes[some])[:-1]))
            both = np.add.reduceat((one[spot] == all_of).astype(np.int64), starts)
            found = some[(100 + percent) * both >= percent * (sizes[some] + sizes[i])]
            out.extend((names[i], names[j]) for j in found)
            reached = np.isin(roots[left], roots[found])
            queue.extend(left[reached].tolist())
            left = left[~reached]
    return out


def _in_parts(spots: DataFrame, sets: DataFrame, percent: int, part: int) -> DataFrame:
    """Links of large cells: each is cut by hash, and each pair of its parts is compared by itself."""
    parts = spots.withColumn("parts", F.ceil(F.col("count") / part))
    own = F.pmod(F.xxhash64("node"), F.col("parts"))
    spread = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda o: F.struct(
        F.least(o, own).alias("i"), F.greatest(o, own).alias("j")))
    rows = parts.withColumn("pair", F.explode(spread)).select("cell", "pair.i", "pair.j", "node", "root", "sketch")
    rows = rows.join(sets, "node").select("cell", "i", "j", "node", "root", "sketch", "hashes")
    rows = rows.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links() -> pa.RecordBatch:
            at = spanning(names, np.array(roots), sets, np.array(sketches), percent)
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in at], pa.int64()),
                                               pa.array([y for _, y in at], pa.int64())], ["a", "b"])

        before, names, roots, sets, sketches = None, [], [], [], []
        for batch in batches:
            keys = zip(*(batch.column(k).to_pylist() for k in range(3)))
            values = zip(keys, batch.column(3).to_pylist(), batch.column(4).to_pylist(), batch.column(5), batch.column(6))
            for key, node, root, sketch, hashes in values:
                if key != before and names:
                    yield links()
                    names, roots, sets, sketches = [], [], [], []
                before = key
                names.append(node)
                roots.append(root)
                sketches.append(sketch.values.to_numpy().view(np.uint64))
                sets.append(hashes.values.to_numpy().view(np.uint64))
        if names:
            yield links()

    return rows.mapInArrow(run, "a long, b long")


def _rooted(spots: DataFrame, roots: DataFrame) -> DataFrame:
    return spots.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def links(nodes: DataFrame, prints: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE, listed: int = LISTED,
          part: int = PART) -> DataFrame:
    """Links ``a``, ``b`` that connect all sets at ``percent`` or more which share a band.

    ``nodes``: ``node, n, cells, sketch``, one row for each distinct set that is not empty; ``prints`` has the
    texts, ``_row`` being the node, and ``n``.  First each cell's sets are compared with its smallest node
    alone; the links found are contracted, and cells of one component drop out, so groups of near copies
    cost rows, not pairs.  Of the other cells the pairs between components are listed where there are at most
    ``listed`` sets, larger cells go by parts.  Sketches decide which full sets are read, the full sets decide
    on links.
    """
    about = nodes.select("node", "n", "sketch")
    spots = nodes.select(F.explode("cells").alias("cell"), "node")
    first = spots.groupBy("cell").agg(F.count("*").alias("count"), F.min("node").alias("least")).where("count > 1")
    spots = cut_lineage(spots.join(first, "cell"))
    stars = spots.where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b")).distinct()
    stars = stars.join(about.select(F.col("node").alias("a"), F.struct("n", "sketch").alias("x")), "a")
    stars = stars.join(about.select(F.col("node").alias("b"), F.struct("n", "sketch").alias("y")), "b")
    stars = cut_lineage(stars.where(_may_link(F.col("x"), F.col("y"), percent)).select("a", "b"))
    stars = cut_lineage(_confirmed(stars, prints, percent, shingle))

    rest = _rooted(spots.select("cell", "node", "count"), components(stars))
    open_cells = rest.groupBy("cell").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("cell")
    rest = cut_lineage(rest.join(open_cells, "cell").join(about, "node"))

    few = rest.where(f"count <= {listed}").groupBy("cell").agg(
        F.collect_list(F.struct("node", "root", "n", "sketch")).alias("s"))
    pairs = few.select(F.explode("s").alias("x"), "s").select("x", F.explode("s").alias("y"))
    pairs = pairs.where((F.col("x.node") < F.col("y.node")) & (F.col("x.root") != F.col("y.root")))
    pairs = pairs.where(_may_link(F.col("x"), F.col("y"), percent))
    pairs = cut_lineage(pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct())
    found = stars.unionByName(_confirmed(pairs, prints, percent, shingle))

    many = rest.where(f"count > {listed}")
    if many.isEmpty():
        return found
    sets = _sets(many.select("node").distinct(), prints, shingle)
    return found.unionByName(_in_parts(many, sets, percent, part))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT,
                    shingle: int = SHINGLE, listed: int = LISTED, part: int = PART) -> DataFrame:
    """Component of each document under word shingles of Jaccard similarity ``percent`` or more.

    Returns ``doc_id, n_shingles, component_id, kept``, one row per input row; ``kept`` where the document's id
    is the smallest of its component.  Equal sets collapse to one before any join.  Null, empty and blank texts
    have no shingles and link with nothing.  Rows of one id stay rows; they link only by their texts.  A null
    id is the component of its row only where no linked row has an id.  Other columns are dropped.  The
    similarity decision is exact on the sets of 64-bit shingle hashes; a pair at the threshold fails to become
    a candidate with probability 2e-8 (bands) and 1e-9 (sketches).
    """
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).withColumn("_row", F.monotonically_increasing_id())
    prints = cut_lineage(_prints(rows, shingle))
    one = prints.where("n > 0").groupBy("set").agg(
        F.min("_row").alias("node"), F.min("_id").alias("least"), *[F.first(c).alias(c) for c in ("n", "cells", "sketch")])
    one = cut_lineage(one)
    roots = components(links(one.drop("set", "least"), prints, percent, shingle, listed, part))
    placed = cut_lineage(_rooted(one.select("set", "node", "least"), roots))
    heads = placed.groupBy("root").agg(F.min("least").alias("component"))
    found = placed.join(heads, "root").select("set", "component")
    out = prints.select("_id", "set", "n").join(found, "set", "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("_id"))
    return out.select(F.col("_id").alias(doc_id), F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.col("_id").eqNullSafe(component).alias("kept"))
