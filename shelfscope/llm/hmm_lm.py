"""Hidden Markov language model over words.

A latent state emits a word class and the class emits the word: the classes are the most frequent words
of the training texts, one each, and a fixed number of hash classes for all others.  Baum-Welch trains the
transitions and class emissions.  One more pass over the training texts gives the expected count of every
word in every state, a table that grows with the vocabulary: how likely a word is within its class differs
by state.  The likelihood of a text is then the scaled forward recursion over its words.

The word terms of frequent words go to all tasks.  All other words meet their counts by bucket of their hash:
texts are coded in blocks, each block sends its distinct words to their buckets once, packed, and gets the
corpus counts back in the same order.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import most_frequent, present, scratch_path

END = ""  # no word is empty, so the empty text stands for the end token
HEAD_WORDS = 1 << 17  # words whose counts go to all tasks
CLASS_WORDS = 1 << 11  # words that are a class of their own
TAIL_CLASSES = 64
STATES = 4
ROUNDS = 2  # over all training segments
START_ROUNDS = 8  # before them, over one in START_PART, to leave the even start
START_PART = 16
SEGMENT = 512
NO_HEAD = 0xFFFFFFFF
OWN = 2.0  # counts of its class that are added to a word's own counts by state
BLOCK_TOKENS = 1 << 18  # a block ends with the segment that reaches them
BUCKET_WORDS = 100_000  # words outside the head, repeats between blocks included, meant for one bucket


def tail_class(word: str | bytes) -> int:
    return CLASS_WORDS + zlib.crc32(word if isinstance(word, bytes) else word.encode()) % TAIL_CLASSES


def bucket(word: bytes, per_class: int) -> int:
    """Where a word meets its counts; all words of a bucket are of the hash class ``bucket % TAIL_CLASSES``."""
    group, c = divmod(zlib.crc32(word), TAIL_CLASSES)
    return group % per_class * TAIL_CLASSES + c


def buckets_per_class(v: Vocabulary) -> int:
    """Grows with the training tokens outside the head."""
    rare = v.tokens - sum(n for _, n in v.head.values())
    return 1 + rare // (BUCKET_WORDS * TAIL_CLASSES)


@dataclass
class Vocabulary:
    """Counts of the head words, their classes, and totals of the training tokens."""

    head: dict[bytes, tuple[int, int]]  # word: class, count
    tokens: int
    types: int
    class_tokens: np.ndarray
    class_types: np.ndarray


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``word``, ``n`` over all whole texts, the end token of each text included."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter[bytes] = Counter()
            for t in present(batch.column(0).to_pylist()):
                seen.update(t.encode().lower().split())
            seen[END.encode()] = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array(seen.keys(), pa.binary()).cast(pa.string()), pa.array(seen.values(), pa.int64())], ["word", "n"])

    return docs.select(text).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame) -> Vocabulary:
    """Collects at most ``HEAD_WORDS`` words, the most frequent ones, and one row of sums per tail class."""
    total = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    top = most_frequent(counts, HEAD_WORDS)
    own = {r.word for r in top[:CLASS_WORDS]}
    head = {r.word.encode(): (i if r.word in own else tail_class(r.word), r.n) for i, r in enumerate(top)}
    size = CLASS_WORDS + TAIL_CLASSES
    tokens, types = np.zeros(size), np.zeros(size)
    tails = counts.groupBy((F.crc32(F.col("word").cast("binary")) % TAIL_CLASSES).alias("c")).agg(
        F.sum("n").alias("n"), F.count("*").alias("v"))
    for r in tails.collect():
        tokens[CLASS_WORDS + r.c], types[CLASS_WORDS + r.c] = r.n, r.v
    for i, r in enumerate(top[:CLASS_WORDS]):
        tokens[i], types[i] = r.n, 1
        c = tail_class(r.word)
        tokens[c] -= r.n
        types[c] -= 1
    return Vocabulary(head, total.n or 0, total.v or 0, tokens, types)


class _Block:
    """Segments in the making, and their distinct words outside the head in order of appearance."""

    def __init__(self):
        self.segments: list[tuple] = []
        self.index: dict[bytes, int] = {}
        self.tokens = 0

    def add(self, row: int, part: int, classes: np.ndarray, marks: np.ndarray, words: list[bytes], *sums) -> None:
        index = self.index
        at = np.fromiter((index.setdefault(w, len(index)) for w in words), np.uint32, len(words))
        self.segments.append((row, part, classes.tobytes(), marks.tobytes(), at, *sums))
        self.tokens += len(classes)

    def batch(self, number: int, meta: list[pa.Array], names: list[str], per_class: int) -> pa.RecordBatch:
        """One row: the segments, and their words packed by bucket."""
        words = list(self.index)
        to = np.fromiter((bucket(w, per_class) for w in words), np.int64, len(words))
        order = np.argsort(to, kind="stable")
        rank = np.empty(len(words), np.uint32)
        rank[order] = np.arange(len(words), dtype=np.uint32)
        buckets, first = np.unique(to[order], return_index=True)
        ends = [*first[1:].tolist(), len(words)]
        packed = [b" ".join([words[i] for i in order[x:y].tolist()]).decode() for x, y in zip(first.tolist(), ends)]
        rows, part, classes, marks, rare, known, base, inner = zip(*self.segments)
        own = [pa.array(part, pa.int32()), pa.array(classes, pa.binary()), pa.array(marks, pa.binary()),
               pa.array([rank[x].tobytes() for x in rare], pa.binary()),
               pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(inner, pa.float64())]
        picked = [c.take(pa.array(rows, pa.int32())) for c in meta]
        each = pa.StructArray.from_arrays([*picked, *own], [*names, *_OWN])
        return pa.RecordBatch.from_arrays(
            [pa.array([number], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), each),
             pa.array([buckets.tolist()], pa.list_(pa.int32())), pa.array([packed], pa.list_(pa.string()))],
            ["block", "segs", "buckets", "words"])


_OWN = ["part", "classes", "marks", "rare", "known", "base", "inner"]


def encode(docs: DataFrame, vocab, text: str, per_class: int = 1) -> DataFrame:
    """One row per block of segments of ``SEGMENT`` tokens, with all other columns of ``docs`` in each segment.

    ``part`` numbers the segments of a text; ``classes`` are its classes as 16-bit numbers; ``marks`` the
    head numbers of its tokens in hash classes as 32-bit numbers, ``NO_HEAD`` for those outside the head;
    ``rare`` says in order which of the block's words those are; ``known``, ``base`` and ``inner`` are
    sums over head words.  ``buckets`` and ``words`` list the words of the block outside the head.  The block
    number is fixed once the table is written.
    """
    others = [c for c in docs.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocab.value
        number = TaskContext.get().partitionId() << 32
        numbers = {w: i for i, w in enumerate(v.head)}
        terms = [(c, base_term(n, v), inner_term(n, c, v)) for c, n in v.head.values()]
        head_class, head_base, head_inner = (np.array(x) for x in (zip(*terms) if terms else [()] * 3))
        for batch in batches:
            block = _Block()
            for row, t in enumerate(present(batch.column(0).to_pylist())):
                ws = t.encode().lower().split()
                ws.append(END.encode())
                heads = np.fromiter(map(numbers.get, ws, repeat(-1)), np.int64, len(ws))
                inside = heads >= 0
                known = heads[inside]
                codes = np.empty(len(ws), np.uint16)
                codes[inside] = head_class[known]
                absent = np.flatnonzero(~inside)
                codes[absent] = [tail_class(ws[i]) for i in absent.tolist()]
                marks = np.where(inside, heads, NO_HEAD).astype(np.uint32)
                sums = (len(known), float(head_base[known].sum()), float(head_inner[known].sum()))
                for part, start in enumerate(range(0, len(ws), SEGMENT)):
                    cut = slice(start, start + SEGMENT)
                    one = codes[cut]
                    others_at = (start + np.flatnonzero(~inside[cut])).tolist()
                    block.add(row, part, one, marks[cut][one >= CLASS_WORDS], [ws[i] for i in others_at],
                              *(sums if part == 0 else (0, 0.0, 0.0)))
                    if block.tokens >= BLOCK_TOKENS:
                        yield block.batch(number, batch.columns[1:], others, per_class)
                        number, block = number + 1, _Block()
            if block.segments:
                yield block.batch(number, batch.columns[1:], others, per_class)
                number += 1

    picked = docs.select(text, *others)
    kept = "".join(f"`{f.name}`: {f.dataType.simpleString()}, " for f in picked.schema[1:])
    return picked.mapInArrow(run, f"block long, segs array<struct<{kept}part: int, classes: binary, marks: binary, rare: binary, "
                                  "known: bigint, base: double, inner: double>>, buckets array<int>, words array<string>")


def segments_of(blocks: DataFrame, training: str | None = None) -> DataFrame:
    """One row per segment with its ``classes``, of those where the field ``training`` holds."""
    each = blocks.select(F.explode("segs").alias("s"))
    return (each.where(F.col("s")[training]) if training else each).select("s.classes")


def base_term(n: int, v: Vocabulary) -> float:
    return float(np.log10((n + 0.5) / (v.tokens + 0.5 * (v.types + 1))))


def inner_term(n: int, c: int, v: Vocabulary) -> float:
    """log10 of a word's share of its class; a tail class keeps half a count for words never seen."""
    if c < CLASS_WORDS:
        return 0.0
    return float(np.log10((n + 0.5) / (v.class_tokens[c] + 0.5 * (v.class_types[c] + 1))))


@dataclass
class Hmm:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray

    @classmethod
    def initial(cls, weights: np.ndarray, states: int = STATES) -> Hmm:
        """Corpus shares of the classes, tilted differently in each state by a fixed pseudo-random factor."""
        rng = np.random.default_rng(11)
        emit = (weights + 1) * rng.uniform(0.2, 1.8, (states, len(weights)))
        move = rng.uniform(0.5, 1.5, (states, states)) + 30 * np.eye(states)
        return cls(np.full(states, 1 / states), move / move.sum(axis=1, keepdims=True),
                   emit / emit.sum(axis=1, keepdims=True))


def _grouped(lengths: np.ndarray, tokens: int = 400_000) -> Iterator[np.ndarray]:
    """Rows by falling length, in groups of about so many tokens."""
    order = np.argsort(-lengths, kind="stable")
    at = 0
    while at < len(order):
        n = max(1, tokens // max(1, int(lengths[order[at]])))
        yield order[at: at + n]
        at += n


def _padded(codes: list[bytes], rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of falling length side by side, and how many rows reach each position."""
    arrays = [np.frombuffer(codes[r], np.uint16) for r in rows]
    lengths = np.array([len(a) for a in arrays])
    out = np.zeros((len(arrays), lengths[0]), np.uint16)
    for i, a in enumerate(arrays):
        out[i, : len(a)] = a
    alive = len(lengths) - np.searchsorted(lengths[::-1], np.arange(lengths[0]), side="right")
    return out, alive


def posteriors(model: Hmm, codes: list[bytes], tally: tuple) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows, classes and state shares by position, by scaled forward and backward passes; adds starts and moves."""
    start, move, _, loglik = tally
    lengths = np.array([len(c) // 2 for c in codes])
    for rows in _grouped(lengths):
        x, alive = _padded(codes, rows)
        n, steps = x.shape
        forward = np.zeros((steps, n, len(model.start)))
        likely = model.emit.T
        scale = np.ones((steps, n))
        for t in range(steps):
            k = alive[t]
            now = (model.start if t == 0 else forward[t - 1, :k] @ model.move) * likely[x[:k, t]]
            scale[t, :k] = now.sum(axis=1)
            forward[t, :k] = now / scale[t, :k, None]
        loglik[0] += np.log10(scale).sum()
        back = np.ones((n, len(model.start)))
        for t in range(steps - 1, -1, -1):
            k = alive[t]
            gamma = forward[t, :k] * back[:k]
            gamma /= gamma.sum(axis=1, keepdims=True)
            forward[t, :k] = gamma
            if t:
                ahead = likely[x[:k, t]] * back[:k] / scale[t, :k, None]
                move += model.move * (forward[t - 1, :k].T @ ahead)
                back[:k] = ahead @ model.move.T
            else:
                start += gamma.sum(axis=0)
        yield rows, x, forward


def expected_counts(model: Hmm, codes: list[bytes], tally: tuple) -> None:
    """Add expected starts, moves and emissions of each segment."""
    emit = tally[2]
    for _, x, shares in posteriors(model, codes, tally):
        for s in range(len(model.start)):
            emit[s] += np.bincount(x.T.ravel(), shares[:, :, s].ravel(), minlength=emit.shape[1])


def train(segments: DataFrame, weights: np.ndarray, states: int = STATES, rounds: int = ROUNDS) -> Hmm:
    """Baum-Welch: each partition adds up expected counts, Spark adds up the partitions, the driver divides.

    The first ``START_ROUNDS`` settle the starting point on every ``START_PART``-th segment by hash of its
    classes, and are left out if that is none; the
    ``rounds`` that make the model read all training segments.  What comes back is one row per parameter,
    states times classes.
    """
    spark = segments.sparkSession
    model = Hmm.initial(weights, states)
    size = len(weights)
    some = segments.where(F.pmod(F.xxhash64("classes"), F.lit(START_PART)) == 0)
    for source in [some] * START_ROUNDS + [segments] * rounds:
        shared = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tally = (np.zeros(states), np.zeros((states, states)), np.zeros((states, size)), np.zeros(1))
            for batch in batches:
                expected_counts(shared.value, batch.column(0).to_pylist(), tally)
            flat = np.concatenate([a.ravel() for a in tally])
            cells = np.flatnonzero(flat)
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(flat[cells], pa.float64())], ["cell", "n"])

        flat = np.zeros(states + states * states + states * size + 1)
        for r in source.select("classes").mapInArrow(run, "cell long, n double").groupBy("cell").agg(
                F.sum("n").alias("n")).collect():
            flat[r.cell] = r.n
        a, b = states, states + states * states
        if source is some and not flat[:a].any():
            continue  # counts of nothing would make all states alike
        move, emit = flat[a:b].reshape(states, states) + 0.1, flat[b:-1].reshape(states, size)
        emit = emit + 0.1 * (weights + 1) / (weights + 1).mean()
        model = Hmm((flat[:a] + 0.1) / (flat[:a] + 0.1).sum(), move / move.sum(axis=1, keepdims=True),
                    emit / emit.sum(axis=1, keepdims=True))
    return model


def _written(df: DataFrame) -> DataFrame:
    """``df`` from its rows in the shared folder, written once."""
    path = scratch_path(df.sparkSession, "hmm")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _floats(rows: np.ndarray) -> bytes:
    return rows.astype(np.float32).tobytes()


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
    """Rows one by one, so that only one block is held as Python values."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield [c[i].as_py() for c in batch.columns]


def word_entries(blocks: DataFrame, model: Hmm, vocab, training: str) -> DataFrame:
    """Expected counts by state of the words of the hash classes in training segments.

    For words outside the head one row per block and bucket: ``words`` as in the block, ``n`` their counts as
    64-bit numbers and ``s`` the counts in all states but the last as 32-bit floats, all zero for words of
    other texts.  For head words one row per task with ``head``, their number, and ``s0``, ``s1``... for the
    same states.
    """
    shared = blocks.sparkSession.sparkContext.broadcast(model)
    states = len(model.start)
    names = [f"s{i}" for i in range(states - 1)]
    columns = ["bucket", "block", "words", "n", "s", "head", *names]
    kinds = [pa.int32(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.int32(), *[pa.float32()] * (states - 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        sums = np.zeros((states, len(vocab.value.head)))
        for block, trains, classes, marks, rare, buckets, words in _rows(batches):
            codes, marks, rare = ([x for x, yes in zip(each, trains) if yes] for each in (classes, marks, rare))
            spare = (np.zeros(states), np.zeros((states, states)), None, np.zeros(1))
            found, at = [np.zeros((0, states))], [np.zeros(0, np.uint32)]
            for group, x, shares in posteriors(model, codes, spare):
                for i, r in enumerate(group):
                    one = np.frombuffer(marks[r], np.uint32)
                    n = len(codes[r]) // 2
                    mine = shares[:n, i][x[i, :n] >= CLASS_WORDS]
                    inside = one != NO_HEAD
                    np.add.at(sums.T, one[inside], mine[inside])
                    found.append(mine[~inside])
                    at.append(np.frombuffer(rare[r], np.uint32))
            found, at = np.concatenate(found), np.concatenate(at)
            ends = np.cumsum([w.count(" ") + 1 for w in words]).tolist()
            size = ends[-1] if ends else 0
            n = np.bincount(at, minlength=size).astype(np.int64)
            s = np.stack([np.bincount(at, found[:, i], size) for i in range(states - 1)], axis=1)
            cuts = [slice(x, y) for x, y in zip([0, *ends], ends)]
            none = [None] * len(cuts)
            values = [buckets, [block] * len(cuts), words, [n[c].tobytes() for c in cuts], [_floats(s[c]) for c in cuts],
                      *[none] * states]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(values, kinds)], columns)
        some = np.flatnonzero(sums.sum(axis=0))
        values = [*[[None] * len(some)] * 5, some, *sums[:-1, some].astype(np.float32)]
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(values, kinds)], columns)

    picked = blocks.select("block", f"segs.{training}", "segs.classes", "segs.marks", "segs.rare", "buckets", "words")
    return picked.mapInArrow(run, "bucket int, block long, words string, n binary, s binary, head int, " + ", ".join(
        f"{n} float" for n in names))


def word_totals(entries: DataFrame, states: int) -> DataFrame:
    """The entries with corpus totals in place of their own counts.

    ``sums``, in one row of each bucket, are what ``word_ratios`` adds up over its words.  A bucket holds
    about ``BUCKET_WORDS`` entries, since buckets grow with the corpus, a word of one block being one entry.
    """
    def run(group: pa.Table) -> pa.Table:
        group = group.select(["bucket", "block", "words", "n", "s"]).combine_chunks()
        numbers: dict[str, int] = {}
        at = [np.array([numbers.setdefault(w, len(numbers)) for w in text.split(" ")]) for text in group["words"].to_pylist()]
        every = np.concatenate(at)
        n = np.bincount(every, np.frombuffer(b"".join(group["n"].to_pylist()), np.int64), len(numbers))
        one = np.frombuffer(b"".join(group["s"].to_pylist()), np.float32).reshape(-1, states - 1)
        s = np.stack([np.bincount(every, one[:, i], len(numbers)) for i in range(states - 1)], axis=1)
        full = _all_states(n, s)[n > 0]
        seen = n[n > 0]
        share = ((seen + 0.5) / (seen + OWN))[:, None]
        sums = [*full.sum(axis=0), *(full * share).sum(axis=0), OWN * share.sum()]
        counts = n.astype(np.int64)
        return pa.table({
            "bucket": group["bucket"], "block": group["block"],
            "n": pa.array([counts[i].tobytes() for i in at], pa.binary()),
            "s": pa.array([_floats(s[i]) for i in at], pa.binary()),
            "sums": pa.array([sums, *[None] * (len(at) - 1)], pa.list_(pa.float64()))})

    return entries.where("bucket is not null").groupBy("bucket").applyInArrow(
        run, "bucket int, block long, n binary, s binary, sums array<double>")


def _all_states(n: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Counts by state; the last state has what the others leave of ``n``."""
    return np.column_stack([s, np.maximum(n - s.sum(axis=1), 0)])


@dataclass
class Ratios:
    """How much likelier than by its class alone a word is in each state.

    A word's count, with the half that smooths it, is shared out by its states, of which ``OWN`` counts are
    those of its class; the words of a class and the unseen one add up to one in each state.
    """

    part: np.ndarray  # shares of the states by hash class
    factor: np.ndarray
    head: np.ndarray  # ratios of the head words by number

    def of(self, n: np.ndarray, s: np.ndarray, c: np.ndarray) -> np.ndarray:
        return (s + OWN * self.part[c]) / (n + OWN)[:, None] * self.factor[c]


def word_ratios(entries: DataFrame, totals: DataFrame, v: Vocabulary, states: int) -> Ratios:
    """What is collected is one row of sums per hash class and the head's rows."""
    head_n = np.array([n for _, n in v.head.values()], np.float64)
    head_c = np.array([c for c, _ in v.head.values()], np.int64) - CLASS_WORDS
    head_s = np.zeros((len(v.head), states - 1))
    names = [f"s{i}" for i in range(states - 1)]
    for r in entries.where("head is not null").groupBy("head").agg(*[F.sum(x).alias(x) for x in names]).collect():
        head_s[r.head] = [r[x] for x in names]
    head_s = _all_states(head_n, head_s)
    hashed = head_c >= 0
    part, own, spread = np.zeros((TAIL_CLASSES, states)), np.zeros((TAIL_CLASSES, states)), np.zeros((TAIL_CLASSES, 1))
    share = (head_n + 0.5) / (head_n + OWN)
    np.add.at(part, head_c[hashed], head_s[hashed])
    np.add.at(own, head_c[hashed], (head_s * share[:, None])[hashed])
    np.add.at(spread[:, 0], head_c[hashed], OWN * share[hashed])
    some = totals.where("sums is not null").groupBy((F.col("bucket") % TAIL_CLASSES).alias("c")).agg(
        *[F.sum(F.col("sums")[i]).alias(f"x{i}") for i in range(2 * states + 1)])
    for r in some.collect():
        part[r.c] += r[1: 1 + states]
        own[r.c] += r[1 + states: 1 + 2 * states]
        spread[r.c] += r[1 + 2 * states]
    part = (part + 1 / states) / (part.sum(axis=1, keepdims=True) + 1)
    whole = (v.class_tokens + 0.5 * (v.class_types + 1))[CLASS_WORDS:, None]
    ratios = Ratios(part, whole / (0.5 * part + own + part * spread), np.ones((len(v.head), states)))
    ratios.head[hashed] = ratios.of(head_n[hashed], head_s[hashed], head_c[hashed])
    return ratios


def transfer(model: Hmm, codes: list[bytes], first: np.ndarray, ratios: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Per segment the scaled product of move and emission matrices, and the natural log of its scale.

    The first segment of a text begins with the start weights, whatever row is asked for.  ``ratios`` are
    the factors by state of the tokens in hash classes.
    """
    states = len(model.start)
    products, logs = np.zeros((len(codes), states, states)), np.zeros(len(codes))
    for starts in (True, False):
        chosen = np.flatnonzero(first == starts)
        if len(chosen):
            _recursion(model, codes, chosen, starts, ratios, products, logs)
    return products, logs


def _recursion(model: Hmm, codes: list[bytes], chosen: np.ndarray, starts: bool, ratios: list | None,
               products: np.ndarray, logs: np.ndarray) -> None:
    """The chosen segments' part of ``transfer``: those at the start of a text need one row of their matrix only."""
    states = len(model.start)
    lengths = np.array([len(codes[r]) // 2 for r in chosen])
    likely = model.emit.T
    for group in _grouped(lengths, 200_000):
        rows = chosen[group]
        x, alive = _padded(codes, rows)
        now = np.ones((len(rows), 1, states)) if starts else np.repeat(np.eye(states)[None], len(rows), axis=0)
        log = np.zeros(len(rows))
        factors = None if ratios is None else np.ones((x.shape[1], len(rows), states))
        if ratios is not None:
            for i, r in enumerate(rows):
                factors[np.flatnonzero(x[i, : lengths[group[i]]] >= CLASS_WORDS), i] = ratios[r]
        for t in range(x.shape[1]):
            k = alive[t]
            if starts and t == 0:
                step = np.repeat(model.start[None, None], k, axis=0)
            else:
                step = (now[:k].reshape(-1, states) @ model.move).reshape(k, -1, states)
            seen = likely[x[:k, t]]
            step = step * (seen if factors is None else seen * factors[t, :k])[:, None, :]
            scale = step.sum(axis=(1, 2))
            now[:k] = step / scale[:, None, None]
            log[:k] += np.log(scale)
        products[rows], logs[rows] = now, log


def forward_scores(segments: DataFrame, model: Hmm, key: list[str]) -> DataFrame:
    """log10 likelihood of the classes of each text by the forward recursion, ``key`` and ``hmm``.

    Each segment becomes a small matrix where its data lie, from any state before it to any state at its
    end; only these matrices move, and multiplying those of a text in order is the recursion itself.
    """
    shared = segments.sparkSession.sparkContext.broadcast(model)
    n_key = len(key)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, codes = batch.columns[n_key: n_key + 2]
            m, logs = transfer(shared.value, codes.to_pylist(), part.to_numpy() == 0)
            yield pa.RecordBatch.from_arrays([*batch.columns[: n_key + 1], _matrices(m), pa.array(logs)], [*key, "part", "m", "log"])

    kept = segments.select(*key, "part", "classes")
    names = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept.schema[: n_key + 1])
    parts = kept.mapInArrow(products, names + "m array<double>, log double")
    return parts.groupBy(*key).agg(_chain(len(model.start)).alias("hmm"))


def _matrices(m: np.ndarray) -> pa.Array:
    return pa.array(list(m.reshape(len(m), m.shape[1] * m.shape[2])), pa.list_(pa.float64()))


def _chain(states: int):
    """log10 likelihood from the matrices of a text's segments."""
    zero = F.struct(F.array(*[F.lit(float(i == 0)) for i in range(states)]).alias("v"), F.lit(0.0).alias("log"))

    def times(acc, p):
        v = [sum((acc["v"][i] * p["m"][i * states + j] for i in range(1, states)), acc["v"][0] * p["m"][j]) for j in range(states)]
        total = sum(v[1:], v[0])
        return F.struct(F.array(*[x / total for x in v]).alias("v"), (acc["log"] + p["log"] + F.log(total)).alias("log"))

    parts = F.sort_array(F.collect_list(F.struct("part", "m", "log")))
    return F.aggregate(parts, zero, times)["log"] / np.log(10)


def block_scores(blocks: DataFrame, totals: DataFrame, model: Hmm, ratios: Ratios, vocab, carry: list[str]) -> DataFrame:
    """One row per segment: the carried fields, ``part``, counts and sums over all its words, and its matrix.

    Blocks meet the totals of their words by block number.
    """
    shared = blocks.sparkSession.sparkContext.broadcast((model, ratios))
    states = len(model.start)
    got = totals.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("bucket", "n", "s"))).alias("got"))
    joined = blocks.select("block", "segs").join(got, "block", "left").select(
        *[f"segs.{c}" for c in (*carry, *_OWN)], "got.bucket", "got.n", "got.s")
    names = [*carry, "part", "k", "known", "base", "inner", "m", "log"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, ratios = shared.value
        v = vocab.value
        small = v.tokens + 0.5 * (v.types + 1)
        within = (v.class_tokens + 0.5 * (v.class_types + 1))[CLASS_WORDS:]
        for batch in batches:
            for b in range(batch.num_rows):
                row = batch.slice(b, 1)
                kept = [row.column(i).flatten() for i in range(len(carry))]
                part, classes, marks, rare, known, base, inner = (
                    row.column(len(carry) + i).flatten() for i in range(len(_OWN)))
                buckets, n, s = (row.column(len(carry) + len(_OWN) + i).to_pylist()[0] or [] for i in range(3))
                counts = [len(x) // 8 for x in n]
                n = np.frombuffer(b"".join(n), np.int64).astype(np.float64)
                s = np.frombuffer(b"".join(s), np.float32).reshape(-1, states - 1).astype(np.float64)
                c = np.repeat(np.array(buckets, np.int64) % TAIL_CLASSES, counts)
                own = ratios.of(n, _all_states(n, s), c)
                terms = np.stack([n > 0, np.log10((n + 0.5) / small), np.log10((n + 0.5) / within[c])], axis=1)
                sums = np.column_stack([known.to_numpy(), base.to_numpy(), inner.to_numpy()]).astype(np.float64)
                factors = []
                for i, (mark, words) in enumerate(zip(marks.to_pylist(), rare.to_pylist())):
                    mark, words = np.frombuffer(mark, np.uint32), np.frombuffer(words, np.uint32)
                    mine, outside = np.ones((len(mark), states)), mark == NO_HEAD
                    mine[~outside] = ratios.head[mark[~outside]]
                    mine[outside] = own[words]
                    sums[i] += terms[words].sum(axis=0)
                    factors.append(mine)
                codes = classes.to_pylist()
                m, logs = transfer(model, codes, part.to_numpy() == 0, factors)
                k = pa.array([len(x) // 2 for x in codes], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*kept, part, k, pa.array(sums[:, 0].astype(np.int64)), pa.array(sums[:, 1]), pa.array(sums[:, 2]),
                     _matrices(m), pa.array(logs)], names)

    fields = {f.name: f.dataType.simpleString() for f in blocks.schema["segs"].dataType.elementType}
    return joined.mapInArrow(run, "".join(f"`{c}` {fields[c]}, " for c in carry)
                             + "part int, k long, known long, base double, inner double, m array<double>, log double")


def score(docs: DataFrame, training, doc_id: str = "doc_id", text: str = "text", states: int = STATES,
          rounds: int = ROUNDS, carry: list[str] | None = None) -> DataFrame:
    """Train on the rows where the column ``training`` holds and score all rows.

    Returns ``doc_id``, the carried columns, ``n_tokens, n_known, train_tokens, base_score, score``.  Every
    text ends in an end token; a null or empty text is that alone.  Long texts are taken whole, in segments
    that are put together again exactly.  Rows are told apart by a number of their own, so repeated rows and
    null ids keep theirs; ids and carried columns may be of any type and name.  A row whose ``training`` is
    null is not trained on.  Without training rows all words are unknown and equally likely.
    """
    kept = [doc_id, *(carry or [])]
    held = [f"_c{i}" for i in range(len(kept))]
    docs = docs.select(F.col(text).alias("_text"), F.coalesce(training, F.lit(False)).alias("_train"),
                       *[F.col(c).alias(h) for c, h in zip(kept, held)]).withColumn("_row", F.monotonically_increasing_id())
    counts = _written(word_counts(docs.where("_train"), "_text"))
    v = vocabulary(counts)
    shared = docs.sparkSession.sparkContext.broadcast(v)
    blocks = _written(encode(docs, shared, "_text", buckets_per_class(v)))
    model = train(segments_of(blocks, "_train"), v.class_tokens, states, rounds)
    entries = _written(word_entries(blocks, model, shared, "_train"))
    totals = _written(word_totals(entries, states))
    ratios = word_ratios(entries, totals, v, states)
    parts = block_scores(blocks, totals, model, ratios, shared, ["_row", *held])
    sums = {"n_tokens": "k", "n_known": "known", "base_score": "base", "inner": "inner"}
    out = parts.groupBy("_row").agg(*[F.first(h).alias(h) for h in held], *[F.sum(c).alias(n) for n, c in sums.items()],
                                    _chain(states).alias("hmm"))
    return out.select(*[F.col(h).alias(c) for h, c in zip(held, kept)], "n_tokens", "n_known",
                      F.lit(int(v.tokens)).cast("long").alias("train_tokens"), "base_score",
                      (F.col("hmm") + F.col("inner")).alias("score"))
