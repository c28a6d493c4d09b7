import re
from collections import Counter

import numpy as np
import pytest

import __spark_entry__ as entry
from shelfscope.llm import decision_list as dl, deobfuscate as de
from shelfscope.llm.common import crc_fold
from tests.conftest import SF

BIG = "/root/testdata/sf0.1"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    tri = Counter(zip(w, w[1:], w[2:]))
    inside = {i + j for i in range(len(w) - 2) if tri[tuple(w[i: i + 3])] > 1 for j in range(3)}
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside))


def test_op5_counts(spark, odd_docs):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = {r.doc_id: base(r.text) for r in docs}
    got = entry.queries()["op5_quality_rules"](spark, SF).collect()
    assert {r.doc_id: tuple(r)[1:6] for r in got} == want
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    odd = dl.judge_quality(odd_docs, []).collect()
    short = [r for r in odd if r.doc_id != 5]
    assert all(r.base_failed for r in odd) and len(short) == 9
    want = sorted(map(str, (base(r.text)[:3] for r in odd_docs.collect())))
    assert sorted(str(tuple(r[c] for c in dl.COUNTS[:3])) for r in odd) == want


def test_op5_learns(spark):
    docs, labels = (spark.read.parquet(f"{BIG}/{t}.parquet") for t in ("documents", "labels"))
    train, test = labels.where(crc_fold("doc_id") != 0), labels.where(crc_fold("doc_id") == 0)
    rules = dl.fit(docs, train)
    assert rules
    rows = dl.judge_quality(docs, rules).where("not base_failed").join(test, "doc_id").select("kept", "quality").collect()
    good = [r.kept for r in rows if r.quality == 1]
    bad = [r.kept for r in rows if r.quality == 0]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.15


def test_decision_list_matches_its_columns(spark):
    rng = np.random.default_rng(1)
    x = {f: rng.random(2000) for f in dl.FEATURES}
    bad = ((x["words"] > 0.8) & (x["upper_case"] <= 0.5)) | (x["word_length"] > 0.95)
    rules = dl.learn(x, bad, rng.integers(0, 3, 2000))
    hit = np.zeros(2000, bool)
    for r in rules:
        hit |= r.holds(x)
    assert (hit == bad).mean() > 0.95
    assert dl.learn(x, np.zeros(2000, bool), np.zeros(2000)) == []


def test_no_labels(spark, odd_docs, labels):
    assert dl.fit(odd_docs, labels.limit(0)) == []
    assert dl.fit(odd_docs, labels) == []
    scorer = de.fit(odd_docs, labels.limit(0))
    assert {r.score for r in de.score(odd_docs, scorer).collect()} == {0.5}
    assert de.score(odd_docs, de.fit(odd_docs, labels)).count() == 10
    assert de.score(odd_docs.limit(0), scorer).count() == 0


def test_op7_held_out(spark):
    labels = spark.read.parquet(f"{BIG}/labels.parquet")
    rows = entry.queries()["op7_toxicity"](spark, BIG).where("held_out").join(labels, "doc_id").collect()
    y = np.array([r.toxic for r in rows])
    s = np.array([r.score for r in rows])
    order = s.argsort(kind="stable")
    rank = np.empty(len(s))
    for v in np.unique(s):
        at = np.flatnonzero(np.sort(s) == v)
        rank[s == v] = at.mean() + 1
    auc = (rank[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / ((y == 1).sum() * (y == 0).sum())
    hard = (s >= 0.5).astype(int)
    assert order.size and auc > 0.85 and (hard == y).mean() > 0.95 and hard[y == 0].mean() < 0.03


@pytest.fixture(scope="module")
def scorer(spark):
    docs, labels = (spark.read.parquet(f"{BIG}/{t}.parquet") for t in ("documents", "labels"))
    return de.fit(docs, labels)


def test_disguises(spark, scorer):
    clean = "the and of that with this from they have into more some"
    marks = ["1d10t", "stupid", "m0r0n", "i d i o t", "l.o.s.e.r", "trrraaash", "p@thetic", "cl0wn", "w0rthl3ss", "$cum"]
    docs = spark.createDataFrame([(i, f"{clean} {m} {clean} {m}") for i, m in enumerate(marks)] + [(99, clean)], "doc_id long, text string")
    got = {r.doc_id: r.predicted for r in de.score(docs, scorer).collect()}
    assert got.pop(99) == 0
    assert sum(got.values()) >= 9, {marks[i]: p for i, p in got.items()}


def test_viterbi_is_the_best_path(scorer):
    """The beam finds what trying all readings finds."""
    from itertools import product

    model = scorer.model
    for token in ("1d10t", "0f", "a11", "b00k5"):
        best = None
        for reading in product(*[([c] if c.isalpha() else []) + list(de.LOOKALIKES.get(c, "")) + ([] if c.isalpha() else [""]) for c in token]):
            p = sum(0 if x == c else de._LOOK if x else de._DROP for x, c in zip(reading, token))
            a = [0, 0, *de._codes("".join(reading)), 0]
            p += sum(model[x][y][z] for x, y, z in zip(a, a[1:], a[2:]))
            if best is None or p > best[0]:
                best = (p, "".join(reading))
        assert de.restore(token, model.tolist()) == best[1]


def test_signs_at_the_ends(spark, scorer):
    """A sign in front or behind may be a letter or punctuation."""
    reader = de.Reader(scorer)
    marks = {"$tupid": "stupid", "!diot": "idiot", "(lown": "clown", "worthle$$": "worthless", "$cum": "scum", "+rash!": "trash",
             '"!diot",': "idiot", "($tupid)": "stupid", "idiot!": "idiot", "(stupid": "stupid", "(moron)!!": "moron"}
    marks = {k: v for k, v in marks.items() if v in scorer.weights}
    assert len(marks) >= 9 and {k: reader.memo[k] for k in marks} == marks
    assert [reader.memo[w] for w in ("(the", "that!", "from|", "+with", "more", "!!!", "(12)")] == [
        "the", "that", "from", "with", "more", "", "12"]


def test_every_disguise(spark, scorer):
    clean = "the and of that with this from they have into more some"
    marks = ["1d10t", "stupid", "m0r0n", "i d i o t", "l.o.s.e.r", "trrraaash", "p@thetic", "cl0wn", "w0rthl3ss", "$cum",
             "!diot", "worthle$$"]
    docs = spark.createDataFrame([(i, f"{clean} {m} {clean} {m}") for i, m in enumerate(marks)], "doc_id long, text string")
    got = {marks[r.doc_id]: r.predicted for r in de.score(docs, scorer).collect()}
    assert got == dict.fromkeys(marks, 1)


def test_spaced_words(scorer):
    """A spaced word is found beside punctuation, other single characters and other spaced words."""
    reader = de.Reader(scorer)
    runs = {"an i d i o t.": ["idiot"], '"i d i o t"': ["idiot"], "s t u p i d, yes": ["stupid"], "a i d i o t now": ["idiot"],
            "$ c u m": ["scum"], "i d i o t l o s e r": ["idiot", "loser"], "x q i d i o t z z k": ["idiot"],
            "s t u p i d  m 0 r 0 n": ["stupid", "moron"], "(l-o-s-e-r)": ["loser"], "the w_o_r_t_h_l_e_$_$!": ["worthless"],
            "see ! d i o t": ["idiot"], "| a | b | c |": [], "a b c d e f": [], "1 2 3 4 5": [], "u.s.a.": []}
    assert {k: [w for w in reader.spaced(k) if w in scorer.weights] for k in runs} == runs


def test_a_repeated_id_is_not_collected(spark, monkeypatch):
    """The sample bounds the rows that reach the driver, not only the ids."""
    rows = [(i % 40 if i < 80 else 7, f"some text {i} " + "idiot " * (i % 3) + "word " * (i % 50)) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    seen, plain = [], type(docs).toPandas

    def counted(self):
        out = plain(self)
        seen.append(len(out))
        return out

    monkeypatch.setattr(type(docs), "toPandas", counted)
    dl.fit(docs, labels)
    de.fit(docs, labels)
    assert seen == [40, 40]


def test_long_tokens_cost_time_by_length_only():
    """Readings beyond one piece stay whole, pieces change no reading, and no form of token is quadratic."""
    import time

    rng = np.random.default_rng(8)
    model = np.log(rng.dirichlet(np.ones(28), (28, 28)) + 1e-9).tolist()
    for token in ("st" + "u" * 400 + "p1d" * 150, "a0" * 300, "".join(rng.choice(list("abc013@$"), 500))):
        whole = de.restore(token, model, part=10_000)
        assert len(whole) > 128 and de.restore(token, model) == whole and de.restore(token, model, part=7) == whole
    scorer = de.Scorer.__new__(de.Scorer)
    scorer.model, scorer.weights = np.array(model), {"stupid": 1.0}
    reader = de.Reader(scorer)

    def seconds(token):
        t0 = time.perf_counter()
        reader.words(token)
        return time.perf_counter() - t0

    for form in ("a1", "!", "0", "a!", "ab", "_a"):
        small, large = seconds(f"x{form * 4_000}y"), seconds(f"x{form * 32_000}y")
        assert large < 24 * small + 1.0, form
    assert reader.words("st" + "u" * 300 + "pid s t u p i d")[-1] == "stupid"
