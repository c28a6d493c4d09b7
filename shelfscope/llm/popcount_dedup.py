"""SimHash near-duplicates by a segment-popcount embedding and a grid join."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import components, cut_lineage, present

MAX_BITS = 3
# Members of a grid cell that one task compares at a time.
CELL_PART = 4096
_SEED = 42


def shingles(text: str, shingle: int) -> list[bytes]:
    """The word shingles of a text; one of fewer words is a single shingle, no words are none."""
    words = text.encode().lower().split()
    n = len(words)
    if not n:
        return []
    line = b" ".join(words)
    if n <= shingle:
        return [line]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return [line[a:b] for a, b in zip(starts[: n - shingle + 1].tolist(), ends[shingle - 1:].tolist())]


def fingerprint(text: str, shingle: int = 3) -> int:
    """SimHash of the word shingles: a bit is 1 if set in over half of their hashes; no words give 0."""
    import xxhash

    parts = shingles(text, shingle)
    if not parts:
        return 0
    digest = xxhash.xxh64_digest
    buf = b"".join([digest(p, _SEED) for p in parts])
    bits = np.unpackbits(np.frombuffer(buf, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > len(parts)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t, shingle) for t in present(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], [doc_id, "fp"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, text).mapInArrow(run, f"`{doc_id}` {kind}, fp long")


_LOW = 0x5555555555555555


def embed(fp: Column) -> Column:
    """The popcounts of the 32 two-bit segments, each in unary (0: 00, 1: 01, 2: 11).

    In unary the Manhattan distance of two such vectors is the number of differing bits, and no segment's
    popcounts differ by more than its bits do: a lower bound of the Hamming distance.
    """
    half = F.shiftright(fp, 1)
    either = fp.bitwiseOR(half).bitwiseAND(F.lit(_LOW))
    both = fp.bitwiseAND(half).bitwiseAND(F.lit(_LOW))
    return either.bitwiseOR(F.shiftleft(both, 1))


def _masks(max_bits: int) -> list[int]:
    """Grid axes: twice as many groups of segments as may differ, and all choices of those that must not.

    A Manhattan distance of at most ``max_bits`` leaves the popcounts of at least half the groups alike.
    """
    groups = 2 * max_bits
    cuts = [64 * i // groups // 2 * 2 for i in range(groups + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    out = [sum(c) for c in combinations(parts, groups - max_bits)]
    return [m - (1 << 64) if m >> 63 else m for m in out]


def _spanning(fp: np.ndarray, point: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Indices of links that span what the links among these rows connect, by breadth-first search.

    Each row found leaves the list of those to compare with, so a dense cell costs little more than its
    rows; never more than rows less one links come out.
    """
    left = np.arange(len(fp))
    out: list[tuple[int, int]] = []
    while left.size:
        queue, left = [left[0]], left[1:]
        while queue and left.size:
            i = queue.pop()
            near = np.bitwise_count(point[left] ^ point[i]) <= max_bits
            if near.any():
                near[near] = np.bitwise_count(fp[left[near]] ^ fp[i]) <= max_bits
                found = left[near]
                out.extend((i, j) for j in found)
                queue.extend(found)
                left = left[~near]
    return out


def links(fps: DataFrame, max_bits: int = MAX_BITS, cell_part: int = CELL_PART) -> DataFrame:
    """Links ``a``, ``b`` that connect all distinct fingerprints (``fp``) at ``max_bits`` or fewer bits.

    Grid range-join under Manhattan distance: each embedded point goes to the cells of all choices of
    coordinate groups; a pair in range shares at least one cell.  In a cell, the Manhattan distance of the
    whole embedding comes first, then the exact number of differing bits.  Cells of one member are
    dropped.  A cell over ``cell_part`` members is cut by hash, and each pair of its parts is a task of its
    own, so no cell is collected whole; out come links that span the same components, not all pairs.
    """
    spots = fps.select("fp", embed(F.col("fp")).alias("point"))
    keys = [F.xxhash64(F.lit(i), F.col("point").bitwiseAND(F.lit(m))) for i, m in enumerate(_masks(max_bits))]
    spots = spots.select(F.explode(F.array(*keys)).alias("cell"), "fp", "point")
    sizes = spots.groupBy("cell").count().where("count > 1")
    # Spark sizes the exploded cells like the fingerprints, and both sides seem small enough to broadcast
    spots = spots.join(sizes.hint("merge"), "cell").withColumn("parts", F.ceil(F.col("count") / cell_part))
    own = F.pmod(F.xxhash64("fp"), F.col("parts"))
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda o: F.struct(
        F.least(o, own).alias("i"), F.greatest(o, own).alias("j")))
    spots = spots.withColumn("pair", F.explode(pairs)).select("cell", "pair.i", "pair.j", "fp", "point")
    spots = spots.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in _then_none(batches):
            if batch is None:
                data, final = rest, True
            else:
                new = np.stack([batch.column(k).to_numpy() for k in range(5)])
                data, final = new if rest is None else np.concatenate((rest, new), axis=1), False
            if data is None or not data.shape[1]:
                continue
            starts = np.flatnonzero(np.any(data[:3, 1:] != data[:3, :-1], axis=0)) + 1
            starts = np.concatenate(([0], starts))
            ends = np.concatenate((starts[1:], [data.shape[1]]))
            if not final:
                rest = data[:, starts[-1]:]
                starts, ends = starts[:-1], ends[:-1]
            fp, point = data[3].view(np.uint64), data[4].view(np.uint64)
            a: list[int] = []
            b: list[int] = []
            two = starts[ends - starts == 2]
            ok = two[np.bitwise_count(point[two] ^ point[two + 1]) <= max_bits]
            ok = ok[np.bitwise_count(fp[ok] ^ fp[ok + 1]) <= max_bits]
            a.extend(data[3][ok].tolist())
            b.extend(data[3][ok + 1].tolist())
            for s, e in zip(starts[ends - starts > 2].tolist(), ends[ends - starts > 2].tolist()):
                for i, j in _spanning(fp[s:e], point[s:e], max_bits):
                    a.append(int(data[3][s + i]))
                    b.append(int(data[3][s + j]))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return spots.mapInArrow(run, "a long, b long")


def _then_none(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_bits: int = MAX_BITS,
                    shingle: int = 3) -> DataFrame:
    """Component of each document under fingerprints at ``max_bits`` or fewer differing bits.

    Returns ``doc_id, fingerprint, component_id``: one row per input row.  Copies collapse to one
    fingerprint before any join.  A null or empty text has fingerprint zero and links like any other; a
    component of null ids alone has a null id; repeated ids keep their rows; other columns are dropped.
    """
    prints = cut_lineage(fingerprints(docs, doc_id, text, shingle))
    least = cut_lineage(prints.groupBy("fp").agg(F.min(doc_id).alias("least")))
    roots = components(links(least.select("fp"), max_bits))
    # merge joins: these tables have a row for each fingerprint, and Spark would size them by their compressed files
    placed = least.join(roots.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp"))
    heads = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    found = placed.join(heads.hint("merge"), "root").select("fp", "component_id")
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return prints.join(found.hint("merge"), "fp").select(doc_id, hexed.alias("fingerprint"), "component_id")
