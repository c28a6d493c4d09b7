"""Toxicity of text whose spelling may be disguised.

Noisy channel: a token is a lattice of what each written character may stand for (itself, a letter it
resembles, a repeat, a separator); Viterbi search under a character trigram model picks the reading.  The
restored text is scored by a word model learned from labelled rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Bounded, hash_sample, one_per, present

# Labelled rows that word weights and the score are learned from, at most.
SAMPLE_ROWS = 20_000
LEXICON_WORDS = 2_000
# Letters that a written sign may stand for.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i",
}
_SIGNS = re.escape("".join(LOOKALIKES))
_EDGE_SIGN = re.compile(rf"^[{_SIGNS}]+[^\W\d_]|[^\W\d_][{_SIGNS}]+$")
_DISGUISED = re.compile(rf"[^\W\d_][{_SIGNS}*.\-_]+[^\W\d_]|[{_SIGNS}][^\W\d_]|[^\W\d_][0-9@$]+|([^\W\d_])\1\1")
# Single letters, digits or signs that resemble letters, apart from each other, between punctuation or space.
_GAP = r"[\s.\-_*]{1,3}"
_SPACED = re.compile(rf"(?<![^\W_])(?:[^\W_]|[{_SIGNS}])(?:{_GAP}(?:[^\W_]|[{_SIGNS}])){{2,}}(?![^\W_])")
_MEMBER = re.compile(rf"({_GAP})?([^\W_]|[{_SIGNS}])")
# Letters of a reading that stand in one piece, and what begins a further piece.
_PART, _MORE = 128, "\0"
_N = 28  # classes: 0 edge, 1 to 26 a to z, 27 any other letter
_CODES = bytes([0 if not (chr(b).isalpha() or b > 127) else 27 if b > 127 else ord(chr(b).lower()) - 96 for b in range(256)])
# Channel costs, natural logs: look-alike, dropped repeat, dropped sign, a sign at an end as punctuation (some
# letter's worth, as a dropped sign also saves one), a new word within a spaced run; prior of a marked word,
# and by letter of one within a spaced run.
_LOOK, _REPEAT, _DROP, _END, _BREAK, _KNOWN, _EACH = -1.0, -0.5, -6.0, -2.0, -1.0, 6.0, 2.0


def trigram_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Counts of the three-character classes over all whole texts: 28^3 cells at any corpus size."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_N ** 3, np.int64)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                a = np.frombuffer(f" {t or ''} ".encode().translate(_CODES), np.uint8).astype(np.int32)
                if len(a) > 2:
                    total += np.bincount((a[:-2] * _N + a[1:-1]) * _N + a[2:], minlength=_N ** 3)
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(total[cells], pa.int64())], ["cell", "n"])

    out = np.zeros(_N ** 3)
    rows = docs.select(text).mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    for r in rows.collect():  # one row per cell
        out[r.cell] = r.n
    return out


def _codes(word: str) -> list[int]:
    return [ord(c) - 96 if "a" <= c <= "z" else 27 for c in word]


def log_model(counts: np.ndarray, lexicon: list[str]) -> np.ndarray:
    """Log probabilities of a class after two others.  Words of the lexicon count as a part of the text."""
    counts = counts.copy()
    weight = max(1.0, 0.002 * counts.sum() / max(1, len(lexicon)))
    for w in lexicon:
        a = [0, 0, *_codes(w), 0]
        for x, y, z in zip(a, a[1:], a[2:]):
            counts[(x * _N + y) * _N + z] += weight
    table = counts.reshape(_N, _N, _N)
    pairs = table.sum(axis=0)
    back = (pairs + 0.5) / (pairs + 0.5).sum(axis=1, keepdims=True)
    total = table.sum(axis=2, keepdims=True)
    return np.log((table + 5 * back[None]) / (total + 5))


def prefixes(known) -> frozenset[str]:
    """All beginnings of the marked words."""
    return frozenset(w[:i] for w in known for i in range(1, len(w) + 1))


def restore(token: str, model: list, known=(), beam: int = 48, readings_kept: int = 3, begun=frozenset(), part: int = _PART) -> str:
    """The likeliest reading of a disguised token: Viterbi over its lattice, a state being the last two classes.

    A reading among the ``known`` marked words has a prior of its own: such words are what is disguised.
    Beginnings of such words (``begun``) are never pruned.  Signs at either end of the token may also be
    punctuation.
    """
    lead, tail = _ends(token)
    ends = [i < lead or i >= tail for i in range(len(token))]
    return _decode(token, ends, [None] * len(token), model, known, beam, readings_kept, begun, part=part)[-1]


def _ends(token: str) -> tuple[int, int]:
    """Where the signs in front of a token end and where those behind it begin; signs alone are all front."""
    lead, tail = 0, len(token)
    while lead < tail and not token[lead].isalnum():
        lead += 1
    while tail and not token[tail - 1].isalnum():
        tail -= 1
    return lead, tail


def _decode(chars, ends: list[bool], breaks: list[float | None], model: list, known, beam: int, readings_kept: int,
            begun, each: float = 0.0, part: int = _PART) -> list[str]:
    """Words of the best path.  ``ends`` are the signs that may be punctuation; ``breaks`` is what it costs to
    begin a new word before a character, None where none can begin; ``each`` adds to the prior by letter.
    A reading of over ``part`` letters, more than any known word has, goes on in a further piece, so that the
    time grows with the length of the token and not with its square."""
    # state: (class before last, last class) -> the best readings that end there: (log probability, word) -> words before
    states: dict[tuple[int, int], dict[tuple[float, str], tuple | None]] = {(0, 0): {(0.0, ""): None}}
    before = ""
    for c, at_end, gap in zip(chars, ends, breaks):
        if gap is not None:
            ended = {}
            for (a, b), readings in states.items():
                for (p, word), done in readings.items():
                    if word:
                        ended[p + gap + model[a][b][0] + (_KNOWN + each * len(word) if word in known else 0.0), ""] = (done, word)
            best = sorted([*states.pop((0, 0), {}).items(), *ended.items()], key=lambda r: r[0], reverse=True)
            states[0, 0] = dict(best[:readings_kept])
        letter = c.isalpha()
        options = [(c, 0.0)] if letter else []
        options += [(x, _LOOK) for x in LOOKALIKES.get(c, "")]
        drop = _REPEAT if c == before and letter else None if letter else _END if at_end else (
            _DROP if c in LOOKALIKES else _REPEAT)
        then: dict[tuple[int, int], dict[tuple[float, str], tuple | None]] = {}
        for (a, b), readings in states.items():
            row = model[a][b]
            for (p, word), done in readings.items():
                for x, cost in options:
                    k = ord(x) - 96 if "a" <= x <= "z" else 27
                    if len(word) < part:
                        then.setdefault((b, k), {}).setdefault((p + cost + row[k], word + x), done)
                    else:
                        then.setdefault((b, k), {}).setdefault((p + cost + row[k], _MORE + x), (done, word))
                if drop is not None:
                    then.setdefault((a, b), {}).setdefault((p + drop, word), done)
        top = sorted(((max(r), s) for s, r in then.items()), reverse=True)
        states, before = {}, c
        for i, (_, s) in enumerate(top):
            kept, begins = {}, set()
            for n, r in enumerate(sorted(then[s], reverse=True)):
                if i < beam and n < readings_kept or r[1] in begun and r[1] not in begins:
                    kept[r] = then[s][r]
                    begins.add(r[1])
            if kept:
                states[s] = kept
    whole = ((p + model[a][b][0] + (_KNOWN + each * len(word) if word in known else 0.0), word, done)
             for (a, b), readings in states.items() for (p, word), done in readings.items())
    _, word, done = max(whole, key=lambda r: r[:2])
    out = [word]
    while done is not None:
        done, word = done
        out.append(word)
    words: list[list[str]] = []
    for piece in reversed(out):
        if piece.startswith(_MORE):
            words[-1].append(piece[1:])
        else:
            words.append([piece])
    return ["".join(pieces) for pieces in words]


def plain(token: str) -> str:
    lead, tail = _ends(token)
    return token[lead:tail]


class Reader:
    """Lower-case words of a text with disguises undone; the readings of tokens are kept in a bounded memo."""

    def __init__(self, scorer: Scorer):
        self.model, self.known = scorer.model.tolist(), scorer.weights
        self.begun = prefixes(self.known)
        self.part = max([_PART, *[len(word) + 1 for word in self.known]])
        self.memo = Bounded(self._read)

    def _read(self, token: str) -> str:
        word = plain(token)
        lead, tail = _ends(token)
        # signs at the ends that resemble no letter are punctuation
        signs = [c if i >= lead and i < tail or c in LOOKALIKES else "" for i, c in enumerate(token)]
        bare = "".join(signs)
        if word.isalpha() and bare == word and not _DISGUISED.search(word):
            return word
        if _DISGUISED.search(bare) or _EDGE_SIGN.search(bare):
            return restore(bare, self.model, self.known, begun=self.begun, part=self.part)
        return word

    def spaced(self, low: str) -> list[str]:
        """Words of runs of single characters, in which any gap may part two words."""
        out: list[str] = []
        for m in _SPACED.finditer(low):
            members = _MEMBER.findall(m[0])
            chars = [c for _, c in members]
            if any(c.isalpha() for c in chars):
                usual = min(len(gap) for gap, _ in members[1:])
                breaks = [None] + [_BREAK if len(gap) == usual else 0.0 for gap, _ in members[1:]]
                lead, tail = _ends("".join(chars))
                ends = [i < lead or i >= tail for i in range(len(chars))]
                out += _decode(chars, ends, breaks, self.model, self.known, 48, 3, self.begun, _EACH, self.part)
        return out

    def words(self, text: str) -> list[str]:
        low = text.lower()
        tokens = [self.memo[t] if len(t) <= _PART else self._read(t) for t in low.split()]
        return [*tokens, *self.spaced(low)]


@dataclass
class Scorer:
    """Word weights, character model and logistic coefficients over (strongest, total, number, bias)."""

    weights: dict[str, float]
    model: np.ndarray
    coefficients: list[float]

    def probability(self, x: tuple[float, float, float]) -> float:
        c = self.coefficients
        return float(1 / (1 + np.exp(-(c[0] * x[0] + c[1] * x[1] + c[2] * x[2] + c[3]))))


def _word_weights(rows: DataFrame, first: Scorer, smallest: int) -> dict[str, float]:
    """Words that mark toxic rows, with the log ratio of their rates by row; the strongest ``LEXICON_WORDS``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(first)
        for batch in batches:
            seen: dict[bool, Counter[str]] = {True: Counter(), False: Counter()}
            for t, y in zip(present(batch.column(0).to_pylist()), batch.column(1).to_pylist()):
                seen[bool(y)].update(set(reader.words(t)))
            words = list(seen[True].keys() | seen[False].keys())
            yield pa.RecordBatch.from_pydict({"word": pa.array(words, pa.string()), **{
                k: pa.array([seen[y][w] for w in words], pa.int64()) for k, y in (("bad", True), ("good", False))}})

    totals = rows.groupBy("toxic").count().collect()
    n = {int(r["toxic"]): r["count"] for r in totals}
    bad, good = n.get(1, 0), n.get(0, 0)
    words = rows.select("text", "toxic").mapInArrow(run, "word string, bad long, good long").groupBy("word").agg(
        F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    weight = F.log((F.col("bad") + 0.25) / (bad + 0.5)) - F.log((F.col("good") + 0.25) / (good + 0.5))
    words = words.where(f"bad >= {smallest} and length(word) > 1").withColumn("weight", weight).where("weight > 2")
    top = words.orderBy(F.desc(F.col("weight") * F.log1p("bad")), "word").limit(LEXICON_WORDS).collect()
    return {r.word: round(r.weight, 6) for r in top}


def _logistic(x: np.ndarray, y: np.ndarray) -> list[float]:
    """Ridge logistic regression by Newton steps."""
    x = np.column_stack((x, np.ones(len(x))))
    c, ridge = np.zeros(x.shape[1]), np.eye(x.shape[1]) * 0.1
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ c)
        c = c + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return [float(v) for v in c]


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", sample_rows: int = SAMPLE_ROWS,
        corpus: DataFrame | None = None) -> Scorer:
    """Character model from all texts of ``corpus`` (``docs`` by default), words and score from labelled rows.

    ``labels``: ``doc_id``, ``toxic`` (0/1; null is no label).  At most ``sample_rows`` labelled rows are
    used, those of the smallest hash of the id; the score takes one row of a repeated id.  Without any toxic row all scores are the base rate's.
    """
    counts = trigram_counts(docs if corpus is None else corpus, text)
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = hash_sample(known, "doc_id", sample_rows)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(chosen), "doc_id")
    weights = _word_weights(rows, Scorer({}, log_model(counts, []), [0.0] * 4), 3)
    scorer = Scorer(weights, log_model(counts, sorted(w for w in weights if w.isalpha())), [0.0, 0.0, 0.0, 0.0])
    data = one_per(_features(rows, scorer, ["doc_id", "toxic"]), "doc_id").toPandas().sort_values(["strongest", "total", "hits", "toxic"])
    if len(data):
        scorer.coefficients = _logistic(data[["strongest", "total", "hits"]].to_numpy(), data["toxic"].to_numpy(float))
    return scorer


def _features(docs: DataFrame, scorer: Scorer, carry: list[str], text: str = "text") -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(scorer)
    names = carry if text in carry else [*carry, text]
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shared.value
        reader = Reader(scorer)
        memo = Bounded(lambda token: scorer.weights.get(reader.memo[token]))
        for batch in batches:
            rows = []
            for t in present(batch.column(at).to_pylist()):
                low = t.lower()
                hits = [w for w in map(memo.__getitem__, low.split()) if w is not None]
                hits += [scorer.weights[w] for w in reader.spaced(low) if w in scorer.weights]
                x = (max(hits), float(np.log1p(sum(hits))), float(np.log1p(len(hits)))) if hits else (0.0, 0.0, 0.0)
                rows.append((*x, scorer.probability(x)))
            cols = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carry)], *[pa.array(c, pa.float64()) for c in cols]],
                                             [*carry, "strongest", "total", "hits", "score"])

    picked = docs.select(*names)
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in picked.schema[: len(carry)])
    return picked.mapInArrow(run, kept + "strongest double, total double, hits double, score double")


def score(docs: DataFrame, scorer: Scorer, doc_id: str = "doc_id", text: str = "text",
          carry: list[str] | None = None) -> DataFrame:
    """``doc_id``, the carried columns, ``score`` (0 to 1) and ``predicted`` (1 from one half on) per document.

    Whole texts are read at any length.  A null or empty text has the score of a text without marked
    words; repeated rows and null ids keep their rows; columns that are not carried are dropped.
    """
    keep = [doc_id, *[c for c in carry or [] if c != doc_id]]
    out = _features(docs, scorer, keep, text)
    return out.select(*keep, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
