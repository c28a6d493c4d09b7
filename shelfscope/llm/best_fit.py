"""Best-fit packing of tokenised documents into sequences of a fixed length, in bulk-synchronous rounds.

Each round takes the pieces of one size band, longest band first.  Pieces and the gaps of open sequences
are sorted and numbered by size; a sweep from the longest piece down matches each to its successor, the
smallest gap that holds it; pieces after the same gap are told apart by rank; gaps shrink, and the next
round starts from the written gaps.  Sweeps run over sizes and counts (at most ``capacity`` of each), so
what a sweep sees does not grow with the corpus; rows stay in Spark and meet their match by rank.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import Bounded, cut_lineage, present

END_ID = 0
_BUCKETS = 64
# Unicode white space; a token never joins a run of it with a word except by one space in front.
_WS = "\t-\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_UNIT = re.compile(f" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")


@lru_cache(maxsize=2)
def _units(path: str) -> Bounded:
    """Unit of text to its ids as bytes, little-endian unsigned 32 bits."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    fast = _ranks(path)

    def ids(unit: str) -> bytes:
        found = fast(unit) if fast else tokenizer.encode(unit, add_special_tokens=False).ids
        return np.array(found, "<u4").tobytes()

    return Bounded(ids, limit=400_000)


def _ranks(path: str):
    """The same byte-level vocabulary for a quicker library, if its merge ranks lie beside the file."""
    import base64
    import os

    beside = path.removesuffix(".json") + ".tiktoken"
    if not os.path.exists(beside):
        return None
    import public_tokenizers
    import tiktoken

    with open(beside, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                             special_tokens={}).encode_ordinary


@lru_cache(maxsize=2)
def _added(path: str) -> tuple[re.Pattern | None, dict[str, bytes]]:
    """The tokenizer's added tokens, which it finds in a text before all else, and their ids as bytes."""
    from tokenizers import Tokenizer

    added = Tokenizer.from_file(path).get_added_tokens_decoder()
    odd = [t.content for t in added.values() if t.lstrip or t.rstrip or t.single_word]
    if odd:
        raise ValueError(f"added tokens that take in what is around them: {odd}")
    ids = {t.content: np.array([i], "<u4").tobytes() for i, t in added.items()}
    longest = sorted(ids, key=lambda c: (-len(c), c))
    return (re.compile("|".join(map(re.escape, longest))) if ids else None), ids


def token_bytes(path: str, text: str) -> bytes:
    """Ids of a text, four bytes each.  The tokenizer's own split never crosses the units used here."""
    added, ids = _added(path)
    units, out, at = _units(path), [], 0
    for m in added.finditer(text) if added else ():
        out += map(units.__getitem__, _UNIT.findall(text[at: m.start()]))
        out.append(ids[m[0]])
        at = m.end()
    out += map(units.__getitem__, _UNIT.findall(text[at:] if at else text))
    return b"".join(out)


def tokenize(docs: DataFrame, path: str, capacity: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces ``doc_id, piece, start, length, ids_crc32`` of each document's ids and its end id.

    Only documents over ``capacity`` ids are cut; their first piece takes what the others leave over.
    """
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for key, t in zip(batch.column(0).to_pylist(), present(batch.column(1).to_pylist())):
                ids = token_bytes(path, t) + end
                n = len(ids) // 4
                start, length, piece = 0, n % capacity or capacity, 0
                while start < n:
                    rows.append((key, piece, start, length, zlib.crc32(ids[4 * start: 4 * (start + length)])))
                    start, length, piece = start + length, capacity, piece + 1
            cols = list(zip(*rows)) or [[]] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                             [doc_id, "piece", "start", "length", "ids_crc32"])

    return docs.select(doc_id, text).mapInArrow(
        run, f"{doc_id} long, piece int, start long, length long, ids_crc32 long")


def ranked(df: DataFrame, size: str, order: list[str], name: str) -> DataFrame:
    """Number rows of equal ``size`` from 0, in ``_BUCKETS`` parts, so that one size may hold most rows."""
    df = df.withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(_BUCKETS)))
    df = df.withColumn("_r", F.row_number().over(Window.partitionBy(size, "_b").orderBy(*order)))
    counts = df.groupBy(size, "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(size).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(size, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_s"))
    # at most capacity * _BUCKETS rows
    return df.join(F.broadcast(starts), [size, "_b"]).withColumn(name, F.col("_s") + F.col("_r") - 1).drop("_b", "_r", "_s")


def sweep(pieces: dict[int, int], gaps: dict[int, int], capacity: int) -> tuple[list, list]:
    """Match counts of piece lengths, longest first, to counts of gaps, smallest fitting gap first.

    Returns runs ``(length, rank, rank_end, gap, gap_rank, offset)`` of equal pieces that go to equal gaps
    of consecutive rank, and ``(gap, rank, rank_end, left)`` of what is left of the gaps.  Gap
    ``capacity + 1`` stands for new sequences, numbered in the order of opening.  Several pieces of one
    length may share a gap; only as many sequences are touched as they need.
    """
    new, opened = capacity + 1, 0
    sizes = sorted(g for g, n in gaps.items() if n)
    at: dict[int, list] = {g: [(g, 0, gaps[g])] for g in sizes}
    runs = []
    for length in sorted(pieces, reverse=True):
        rank, n = 0, pieces[length]
        while n:
            i = bisect_left(sizes, length)
            if i < len(sizes):
                size = sizes[i]
                origin, lo, hi = at[size].pop()
                if not at[size]:
                    del at[size], sizes[i]
                k = min(hi - lo, -(-n // (size // length)))
                if k < hi - lo:
                    _push(at, sizes, size, (origin, lo + k, hi))
            else:
                size, origin, lo = capacity, new, opened
                k = -(-n // (capacity // length))
                opened += k
            k_now = min(k, n)
            runs.append((length, rank, rank + k_now, origin, lo, capacity - size))
            _push(at, sizes, size - length, (origin, lo, lo + k_now))
            if k_now < k:
                _push(at, sizes, size, (origin, lo + k_now, lo + k))
            rank, n = rank + k_now, n - k_now
    left = [(o, lo, hi, size) for size, parts in at.items() for o, lo, hi in parts]
    return runs, left


def _push(at: dict[int, list], sizes: list[int], size: int, part: tuple) -> None:
    if size not in at:
        at[size] = []
        insort(sizes, size)
    at[size].append(part)


def _counts(df: DataFrame, size: str) -> dict[int, int]:
    """Rows by size: at most ``capacity`` numbers."""
    return {r[0]: r[1] for r in df.groupBy(size).count().collect()}


def pack(pieces: DataFrame, capacity: int, key: list[str]) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces with a ``length`` of 1 to ``capacity``.

    Sequences are filled from 0 without gaps.  Ties of length are broken by ``key``; equal rows are
    interchangeable.  The result is that of best-fit decreasing over all pieces.
    """
    spark = pieces.sparkSession
    rows = cut_lineage(ranked(pieces, "length", key, "rank"))
    counts = _counts(rows, "length")
    bins = spark.createDataFrame([], "sequence_id long, gap long")
    new, used, done = capacity + 1, 0, None
    for high, low in _bands(capacity):
        here = {n: c for n, c in counts.items() if low < n <= high}
        if not here:
            continue
        gaps = ranked(bins.where(f"gap > {low}"), "gap", ["sequence_id"], "gap_rank")
        gaps = cut_lineage(gaps)
        runs, left = sweep(here, _counts(gaps, "gap"), capacity)
        opened = max([end for g, _, end, _ in left if g == new], default=0)
        run_rows = _table(spark, runs, "length long, lo long, hi long, gap long, gap_lo long, offset long")
        band = rows.where(f"length > {low} and length <= {high}")
        at = band.alias("d").join(
            F.broadcast(run_rows).alias("r"),
            F.expr("d.length = r.length and d.rank >= r.lo and d.rank < r.hi"),
        ).select("d.*", "r.gap", F.expr("r.gap_lo + d.rank - r.lo").alias("gap_rank"), "r.offset")
        fresh = at.where(f"gap = {new}").withColumn("sequence_id", F.col("gap_rank") + used)
        old = at.where(f"gap < {new}").join(gaps, ["gap", "gap_rank"])
        placed = fresh.unionByName(old).drop("gap", "gap_rank", "rank")
        placed = cut_lineage(placed)
        done = placed if done is None else done.unionByName(placed)
        left_rows = _table(spark, left, "gap long, lo long, hi long, size long")
        opened_rows = spark.range(opened).select(F.lit(new).cast("long").alias("gap"), F.col("id").alias("gap_rank"),
                                                 (F.col("id") + used).alias("sequence_id"))
        kept = gaps.select("gap", "gap_rank", "sequence_id").unionByName(opened_rows).alias("g").join(
            F.broadcast(left_rows).alias("l"), F.expr("g.gap = l.gap and g.gap_rank >= l.lo and g.gap_rank < l.hi"),
        ).select("g.sequence_id", F.col("l.size").alias("gap"))
        # a gap too small for this band is also too small for longer ones: it waits for a later band
        bins = cut_lineage(kept.unionByName(bins.where(f"gap <= {low}")).where("gap > 0"))
        used += opened
    if done is None:
        empty = rows.drop("rank")
        return empty.withColumn("sequence_id", F.lit(0).cast("long")).withColumn("offset", F.lit(0).cast("long"))
    return done


def _bands(capacity: int) -> list[tuple[int, int]]:
    """Halves, quarters and eighths of the capacity, then all the rest."""
    cuts = [capacity, capacity // 2, capacity // 4, capacity // 8, 0]
    return [(a, b) for a, b in zip(cuts, cuts[1:]) if a > b]


def _table(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    return spark.createDataFrame([tuple(int(x) for x in r) for r in rows], schema)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, doc_id: str = "doc_id",
                   text: str = "text") -> DataFrame:
    """Tokenise whole texts and pack them: one row per piece.

    Returns ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.  A null or empty text is its
    end id alone; very long texts give many pieces, all of ``capacity`` but the first; repeated rows are
    packed each; null ids are kept; other columns are dropped; no documents give no rows.
    """
    pieces = cut_lineage(tokenize(docs, tokenizer, capacity, doc_id, text))
    return pack(pieces, capacity, [doc_id, "piece", "ids_crc32"]).select(
        doc_id, "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
