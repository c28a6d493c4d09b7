import hashlib
import random
import time
import zlib
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as entry
from shelfscope.llm import periodic_runs as pr
from tests.conftest import SF
from tests.llm.test_texts import WORD


def brute(w):
    """All maximal runs by comparing each word with the one q later."""
    out, n = {}, len(w)
    for q in range(1, n // 3 + 1):
        j = 0
        while j < n - q:
            start = j
            while j < n - q and w[j] == w[j + q]:
                j += 1
            if j - start + q >= max(24, 3 * q):
                out.setdefault((start, j - start + q), q)
            j += 1
    return sorted([(s, n, q) for (s, n), q in out.items()], key=lambda r: (r[0], r[2]))


def some_words(rnd):
    n, kinds = rnd.randint(0, 260), rnd.choice([1, 2, 3, 20])
    w = [rnd.randint(1, kinds) for _ in range(n)]
    for _ in range(rnd.randint(0, 3)):
        if n > 30:
            a, p = rnd.randrange(n - 20), rnd.randint(1, 14)
            for i in range(a, min(n, a + rnd.randint(p, 3 * p + 60))):
                w[i] = w[a + (i - a) % p]
    return w


def test_runs_against_brute_force():
    rnd = random.Random(7)
    for _ in range(400):
        w = some_words(rnd)
        assert [tuple(r) for r in pr.runs(np.array(w, np.int64)).tolist()] == brute(w)


def test_extensions_against_comparing():
    rnd = random.Random(8)
    for _ in range(60):
        w = some_words(rnd)
        if len(w) < 2:
            continue
        ask = pr.Extensions(np.array(w, np.int64))
        pairs = [(i, j) for i, j in ((rnd.randrange(len(w)), rnd.randrange(len(w))) for _ in range(80)) if i != j]
        want = []
        for i, j in pairs:
            k = 0
            while max(i, j) + k < len(w) and w[i + k] == w[j + k]:
                k += 1
            want.append(k)
        a, b = np.array(pairs).T if pairs else np.zeros((2, 0), np.int64)
        assert ask(a, b).tolist() == want


def test_cover_is_a_difference_set():
    assert {(a - b) % pr.CYCLE for a in pr.COVER for b in pr.COVER} == set(range(pr.CYCLE))


def test_grid_of_long_texts_is_that_of_short_ones(monkeypatch):
    w = np.tile(np.arange(1, 41), 30)
    short = pr.runs(w).tolist()
    monkeypatch.setattr(pr, "_KEPT", 100)
    monkeypatch.setattr(pr, "_BLOCK", 64)
    assert pr.runs(w).tolist() == short == [[0, 1200, 40]]


def want_row(doc_id, text):
    w = WORD.findall(text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute(w)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None,
            sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_op13_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = entry.queries()["op13_periodic_runs"](spark, SF)
    assert sorted(map(tuple, got.collect())) == sorted(want_row(r.doc_id, r.text) for r in docs)


def test_cases_by_docstring(spark, odd_docs):
    docs = odd_docs.withColumns({"runs": F.lit(1), "n_words": F.lit("x")})
    got = pr.find_runs(docs)
    assert got.count() == odd_docs.count()
    assert [c for c in got.columns if c not in ("n_words", "runs", "collapsed")] == odd_docs.columns
    for r in got.collect():
        w = WORD.findall(r.text or "")
        assert r.n_words == len(w)
        assert [tuple(x) for x in r.runs] == ([(0, 12000, 3)] if len(w) == 12000 else brute(w))
        assert r.collapsed == ("lorem ipsum dolor" if len(w) == 12000 else " ".join(w))
    assert pr.find_runs(docs.limit(0)).count() == 0
    assert pr.find_runs(docs, carry=[]).columns == ["n_words", "runs", "collapsed"]


def test_very_long_text_of_one_word():
    start = time.time()
    assert pr.runs(np.ones(200_000, np.int64)).tolist() == [[0, 200_000, 1]]
    assert time.time() - start < 60
