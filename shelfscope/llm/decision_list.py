"""Document quality: base rules, then a learned decision list emitted as Spark conditional expressions."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import crc_fold, hash_sample, one_per, present

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
# Labelled rows that the list is learned from, at most.
SAMPLE_ROWS = 20_000
_SYMBOLS = b"#*$%&|<>"
_BLANK = " \t\n\r\x0b\x0c"
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = b"abcdefghijklmnopqrstuvwxyz"
_OTHER_ASCII = bytes(c for c in range(128) if not chr(c).isalpha() and chr(c) not in _BLANK)
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
          "n_lines", "n_distinct", "n_upper", "n_ascii_letters", "n_other"]
# Feature names and their expressions over the counts.
FEATURES: dict[str, Column | str] = {
    "words": "double(n_words)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "duplicate_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeated_words": "n_repeat_words / greatest(n_words, 1)",
    "distinct_words": "n_distinct / greatest(n_words, 1)",
    "upper_case": "n_upper / greatest(n_ascii_letters, 1)",
    "marks_per_char": "n_other / greatest(word_chars, 1)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
}


def _gone(data: bytes, drop: bytes) -> int:
    return len(data) - len(data.translate(None, drop))


def counts(text: str) -> tuple[int, ...]:
    """The numbers of ``COUNTS`` for one whole text; repeats are counted case-sensitively."""
    data = text.encode()
    words = data.split()
    n = len(words)
    lines = [x for x in text.split("\n") if x.strip(_BLANK)]
    seen = Counter(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(seen) < n - 2:
        inside = np.zeros(n, bool)
        again = np.fromiter((seen[w] > 1 for w in zip(words, words[1:], words[2:])), bool, n - 2)
        for shift in range(3):
            inside[shift: n - 2 + shift] |= again
        repeated = int(inside.sum())
    upper = _gone(data, _UPPER)
    return (n, len(text) - sum(map(text.count, _BLANK)), _gone(data, _SYMBOLS), len(lines) - len(set(lines)), repeated,
            len(lines), len(set(words)), upper, upper + _gone(data, _LOWER), _gone(data, _OTHER_ASCII))


def with_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``doc_id`` and the numbers of ``COUNTS`` per document; ``carry`` names columns to keep beside them."""
    keep = [doc_id, *[c for c in carry or [] if c != doc_id]]
    names = keep if text in keep else [*keep, text]
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [counts(t) for t in present(batch.column(at).to_pylist())]
            cols = list(zip(*rows)) or [[]] * len(COUNTS)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *[pa.array(c, pa.int64()) for c in cols]],
                                             [*keep, *COUNTS])

    picked = docs.select(*names)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema[: len(keep)])
    return picked.mapInArrow(run, f"{kept}, " + ", ".join(f"{c} long" for c in COUNTS))


@dataclass(frozen=True)
class Rule:
    """Feature conditions that must all hold: ``(name, above, threshold)``."""

    tests: tuple[tuple[str, bool, float], ...]

    def column(self) -> Column:
        tests = [F.expr(FEATURES[f]) > t if above else F.expr(FEATURES[f]) <= t for f, above, t in self.tests]
        return reduce(lambda a, b: a & b, tests, F.lit(True))

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), bool)
        for f, above, t in self.tests:
            out &= x[f] > t if above else x[f] <= t
        return out

    def text(self) -> str:
        return " and ".join(f"{f} {'>' if above else '<='} {t:g}" for f, above, t in self.tests)


def _grow(x: dict, y: np.ndarray, cuts: dict, max_tests: int) -> Rule:
    """Add the condition of the largest information gain until no good row is covered."""
    rule, inside = Rule(()), np.ones(len(y), bool)
    while len(rule.tests) < max_tests:
        p, n = (inside & y).sum(), (inside & ~y).sum()
        if not p or not n:
            break
        now, best = np.log2(p / (p + n)), (1e-9, None, None)
        for f in x:
            for t in cuts[f]:
                for above in (True, False):
                    test = inside & (x[f] > t if above else x[f] <= t)
                    p1, n1 = (test & y).sum(), (test & ~y).sum()
                    gain = p1 * (np.log2(p1 / (p1 + n1)) - now) if p1 else 0
                    if gain > best[0]:
                        best = (gain, (f, above, float(t)), test)
        if best[1] is None:
            break
        rule, inside = Rule((*rule.tests, best[1])), best[2]
    return rule


def _prune(rule: Rule, x: dict, y: np.ndarray) -> Rule:
    """Drop last conditions as long as that does not lower precision, less its spread, on the other rows."""
    def worth(r: Rule) -> float:
        inside = r.holds(x)
        p, n = (inside & y).sum(), (inside & ~y).sum()
        return (p - 2 * n) / (p + n + 1)

    best = max((Rule(rule.tests[:k]) for k in range(1, len(rule.tests) + 1)), key=lambda r: (worth(r), -len(r.tests)),
               default=rule)
    return best


def learn(x: dict[str, np.ndarray], bad: np.ndarray, part: np.ndarray, min_precision: float = 0.9, min_cover: int = 3,
          max_rules: int = 12, max_tests: int = 3, n_cuts: int = 24) -> list[Rule]:
    """Sequential covering: rules for bad documents, each grown on two thirds and pruned on one third.

    A rule stays if over all rows not yet covered it has ``min_precision`` and covers ``min_cover`` bad ones.
    """
    x = {k: np.asarray(v, float) for k, v in x.items()}
    open_rows, rules = np.ones(len(bad), bool), []
    while len(rules) < max_rules:
        y = bad & open_rows
        grow, check = open_rows & (part != 0), open_rows & (part == 0)
        if (y & grow).sum() < min_cover:
            break
        sub = {k: v[grow] for k, v in x.items()}
        cuts = {k: np.unique(np.quantile(v[y[grow]], np.linspace(0, 1, n_cuts), method="lower")) for k, v in sub.items()}
        cuts = {k: np.unique(np.concatenate((c, np.quantile(sub[k], np.linspace(0, 1, n_cuts), method="lower"))))
                for k, c in cuts.items()}
        rule = _prune(_grow(sub, bad[grow], cuts, max_tests), {k: v[check] for k, v in x.items()}, bad[check])
        inside = rule.holds(x) & open_rows
        hits, misses = (inside & bad).sum(), (inside & ~bad).sum()
        if not rule.tests or hits < min_cover or hits < min_precision * (hits + misses):
            break
        rules.append(rule)
        open_rows &= ~inside
    return rules


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
        sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Learn the list from at most ``sample_rows`` labelled rows, those of the smallest hash of the id.

    ``labels``: ``doc_id``, ``quality`` (0 bad, 1 good; null is no label).  Of the rows of a repeated id the
    one of the smallest features is taken, so that no more rows than ids are collected.
    """
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("_good"))
    chosen = hash_sample(known, "doc_id", sample_rows)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(chosen), "doc_id")
    part = crc_fold("doc_id", 3).alias("part")
    data = with_counts(rows, carry=["_good"]).select(
        "doc_id", "_good", part, *[F.expr(e).alias(f) for f, e in FEATURES.items()])
    data = one_per(data, "doc_id").toPandas()
    data = data.sort_values(["doc_id", *FEATURES])
    return learn({f: data[f].to_numpy() for f in FEATURES}, data["_good"].to_numpy() == 0, data["part"].to_numpy())


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def verdict(rules: list[Rule]) -> Column:
    """Number of the first rule that rejects a document, null if none does."""
    out = F.lit(None).cast("int")
    for i in reversed(range(len(rules))):
        out = F.when(rules[i].column(), i).otherwise(out)
    return out


def judge_quality(docs: DataFrame, rules: list[Rule], doc_id: str = "doc_id", text: str = "text",
                  carry: list[str] | None = None) -> DataFrame:
    """Counts, ``base_failed``, ``rule`` (number of the rejecting rule or null) and ``kept`` per document.

    A null or empty text has no words and fails the base rules; texts of any length are taken whole;
    repeated rows and null ids keep their rows; only ``carry`` of the other columns comes along.
    """
    out = with_counts(docs, doc_id, text, carry).withColumn("base_failed", base_failed())
    out = out.withColumn("rule", verdict(rules))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
