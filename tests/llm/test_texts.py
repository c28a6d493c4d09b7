import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import __spark_entry__ as entry
from shelfscope.llm import hmm_lm as hl, popcount_dedup as pd
from shelfscope.llm.common import components, crc_fold
from tests.conftest import SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def simhash(text):
    w = words(text)
    if not w:
        return 0
    shingles = [" ".join(w[i: i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(prints):
    """Smallest id reachable, by brute force over distinct fingerprints."""
    fps = sorted(set(prints.values()))
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    least = {}
    for d, f in prints.items():
        r = find(f)
        least[r] = min(least.get(r, d), d)
    return {d: least[find(f)] for d, f in prints.items()}


def test_op10_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    prints = {r.doc_id: simhash(r.text) for r in docs}
    want = groups(prints)
    got = entry.queries()["op10_simhash"](spark, SF).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {d: (f"{f:016x}", want[d]) for d, f in prints.items()}


def test_op10_odd_rows(spark, odd_docs):
    got = sorted(map(str, map(tuple, pd.near_duplicates(odd_docs).collect())))
    prints = [(r.doc_id, simhash(r.text)) for r in odd_docs.collect()]
    want = groups({i: f for i, (_, f) in enumerate(prints)})
    least = {}
    for i, (d, _) in enumerate(prints):
        if d is not None:
            least[want[i]] = min(least.get(want[i], d), d)
    assert got == sorted(str((d, f"{f:016x}", least.get(want[i]))) for i, (d, f) in enumerate(prints))
    assert pd.near_duplicates(odd_docs.limit(0)).count() == 0


@pytest.mark.parametrize("part", [5, 4096])
def test_links_lose_nothing(spark, part):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = {int(b) for b in base}
    for b in base[:6]:  # dense groups, chains and pairs at the limit
        for _ in range(120):
            x = int(b)
            for bit in rng.integers(0, 64, rng.integers(1, 5)):
                x ^= 1 << int(bit)
            fps.add(x)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    edges = [tuple(r) for r in pd.links(df, cell_part=part).collect()]
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 3 for a, b in edges)
    want = groups(dict(zip(signed, [f & (1 << 64) - 1 for f in signed])))
    root = {f: f for f in signed}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for a, b in edges:
        root[find(a)] = find(b)
    assert len({find(f) for f in signed}) == len(set(want.values()))
    got = {r.node: r.root for r in components(pd.links(df, cell_part=part)).collect()}
    for a in signed:
        assert want[a] == got.get(a, a)


def test_embedding_is_a_lower_bound():
    def point(x):
        return (x | x >> 1) & pd._LOW | (x & x >> 1 & pd._LOW) << 1

    rng = np.random.default_rng(0)
    for a, b in rng.integers(0, 2**63, (500, 2)).tolist():
        counts = sum(abs((a >> s & 3).bit_count() - (b >> s & 3).bit_count()) for s in range(0, 64, 2))
        assert (point(a) ^ point(b)).bit_count() == counts <= (a ^ b).bit_count()


def test_op9_base_and_counts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    train = [r for r in docs if zlib.crc32(str(r.doc_id).encode()) % 5 != 1]
    c = Counter(w for r in train for w in [*words(r.text), None])
    n, v = sum(c.values()), len(c)
    got = {r.doc_id: r for r in entry.queries()["op9_hmm_scores"](spark, SF).collect()}
    assert len(got) == len(docs)
    for r in docs:
        t, g = [*words(r.text), None], got[r.doc_id]
        assert (g.held_out, g.n_tokens, g.n_known, g.train_tokens) == (
            zlib.crc32(str(r.doc_id).encode()) % 5 == 1, len(t), sum(w in c for w in t), n)
        assert math.isclose(g.base_score, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), rel_tol=1e-9)
        assert g.score < 0
    held = [g for g in got.values() if g.held_out]
    assert sum(g.score for g in held) > sum(g.base_score for g in held)


def tiny(states, size, seed):
    rng = np.random.default_rng(seed)
    norm = lambda a: a / a.sum(axis=-1, keepdims=True)
    return hl.Hmm(norm(rng.random(states)), norm(rng.random((states, states))), norm(rng.random((states, size))))


def forward(model, seq):
    a, total = model.start * model.emit[:, seq[0]], 0.0
    for t in range(len(seq)):
        if t:
            a = (a @ model.move) * model.emit[:, seq[t]]
        total += math.log10(a.sum())
        a = a / a.sum()
    return total


def test_forward_in_segments(spark, monkeypatch):
    model, rng = tiny(3, 7, 1), np.random.default_rng(2)
    seqs = [rng.integers(0, 7, n) for n in (1, 2, 5, 40, 41, 300)]
    rows = [(i, p, bytearray(s[a: a + 40].astype(np.uint16).tobytes())) for i, s in enumerate(seqs) for p, a in enumerate(range(0, len(s), 40))]
    df = spark.createDataFrame(rows, "_row long, part int, classes binary")
    got = {r["_row"]: r.hmm for r in hl.forward_scores(df, model, ["_row"]).collect()}
    for i, s in enumerate(seqs):
        assert math.isclose(got[i], forward(model, s), rel_tol=1e-9)


def test_baum_welch_counts_and_ascent(spark):
    model, rng = tiny(2, 5, 4), np.random.default_rng(6)
    seqs = [rng.integers(0, 5, n) for n in (1, 3, 6, 6)]
    tally = (np.zeros(2), np.zeros((2, 2)), np.zeros((2, 5)), np.zeros(1))
    hl.expected_counts(model, [s.astype(np.uint16).tobytes() for s in seqs], tally)
    from itertools import product

    start, move, emit = np.zeros(2), np.zeros((2, 2)), np.zeros((2, 5))
    for s in seqs:  # all paths
        paths = []
        for z in product(range(2), repeat=len(s)):
            p = model.start[z[0]] * np.prod([model.emit[k, x] for k, x in zip(z, s)]) * np.prod([model.move[a, b] for a, b in zip(z, z[1:])])
            paths.append((p, z))
        total = sum(p for p, _ in paths)
        for p, z in paths:
            start[z[0]] += p / total
            for k, x in zip(z, s):
                emit[k, x] += p / total
            for a, b in zip(z, z[1:]):
                move[a, b] += p / total
    assert np.allclose(tally[0], start) and np.allclose(tally[1], move) and np.allclose(tally[2], emit)
    assert math.isclose(tally[3][0], sum(forward(model, s) for s in seqs))


def test_op9_odd_rows(spark, odd_docs):
    from pyspark.sql import functions as F

    got = hl.score(odd_docs, crc_fold("doc_id") != 1, rounds=1).collect()
    assert len(got) == 10 and {r.n_tokens for r in got if r.doc_id in (3, 4, 6)} == {1}
    assert next(r.n_tokens for r in got if r.doc_id == 5) == 12001
    assert hl.score(odd_docs.limit(0), F.lit(True), rounds=1).count() == 0
    none = hl.score(odd_docs, F.lit(False), rounds=1).collect()
    assert {r.n_known for r in none} == {0} and {r.train_tokens for r in none} == {0}


def test_sums_to_one_over_words(spark):
    """Over all words and an unseen one per class, the model's first-token probabilities add up."""
    docs = spark.createDataFrame([(i, f"w{i % 7} x{i} y{i % 3}") for i in range(50)], "doc_id long, text string")
    v = hl.vocabulary(hl.word_counts(docs))
    assert v.tokens == 200 and v.types == 61
    within = sum(10 ** hl.inner_term(n, c, v) for c, n in v.head.values() if c < hl.CLASS_WORDS)
    assert within == len(v.head)


def test_words_of_one_hash_class_differ_by_state(spark):
    """Rare words are emissions of their own: one of the text's topic fits better than one of the other topic."""
    rng = np.random.default_rng(4)
    topics = [[f"{k}{i}" for i in range(3000)] for k in "ab"]
    texts = [" ".join(rng.choice(topics[i % 2], 300)) for i in range(300)]
    n = Counter(w for t in texts for w in t.split())
    last = sorted(n.values(), reverse=True)[2 * hl.CLASS_WORDS // 2 + 200]
    same = [{}, {}]
    for k in range(2):
        for w in topics[k]:
            if 0 < n[w] < last:
                same[k].setdefault((hl.tail_class(w), n[w]), w)
    pairs = [(same[0][key], same[1][key]) for key in sorted(same[0].keys() & same[1].keys())]
    assert len(pairs) > 20
    around = " ".join(rng.choice(topics[0], 40))
    asked = [f"{around} {w} {around}" for pair in pairs for w in pair]
    rows = [(i, t, i < 300) for i, t in enumerate(texts + asked)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, train boolean")
    got = {r.doc_id: r.score for r in hl.score(docs, F.col("train")).collect()}
    gain = [got[300 + 2 * i] - got[301 + 2 * i] for i in range(len(pairs))]
    assert sum(g > 0.01 for g in gain) > 0.9 * len(pairs)


def forward_backward(model, codes):
    """State shares by position, one sequence, step by step."""
    f, scale = [], []
    for t, x in enumerate(codes):
        now = (model.start if t == 0 else f[-1] @ model.move) * model.emit[:, x]
        scale.append(now.sum())
        f.append(now / scale[-1])
    back, out = np.ones(len(model.start)), []
    for t in range(len(codes) - 1, -1, -1):
        out.append(f[t] * back / (f[t] * back).sum())
        back = model.move @ (model.emit[:, codes[t]] * back) / scale[t]
    return out[::-1]


@pytest.mark.parametrize("head", [0, 60, 3000])
def test_scores_against_brute_force(spark, monkeypatch, head):
    """All words by hand: counts, posteriors, ratios that add up to one, and the forward recursion."""
    for name, value in (("HEAD_WORDS", head), ("BLOCK_TOKENS", 1500), ("BUCKET_WORDS", 50)):
        monkeypatch.setattr(hl, name, value)
    rng = np.random.default_rng(9)
    sizes = [0, 1, 511, 512, 1300, *rng.integers(2, 400, 100)]
    texts = [" ".join(f"W{k}" for k in rng.integers(0, 4000, size)) for size in sizes]
    rows = [(i, t, i % 5 != 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, train boolean")
    words = [[*t.lower().encode().split(), b""] for t in texts]
    n = Counter(w for i, ws in enumerate(words) if i % 5 != 1 for w in ws)

    v = hl.vocabulary(hl.word_counts(docs.where("train")))
    blocks = hl.encode(docs, spark.sparkContext.broadcast(v), "text", hl.buckets_per_class(v))
    model = hl.train(hl.segments_of(blocks, "train"), v.class_tokens)
    code = {w: v.head[w][0] if w in v.head else hl.tail_class(w) for ws in words for w in ws}
    s = {w: np.zeros(hl.STATES) for w in n}
    for i, ws in enumerate(words):
        for a in range(0, len(ws) if i % 5 != 1 else 0, hl.SEGMENT):
            for w, share in zip(ws[a: a + hl.SEGMENT], forward_backward(model, [code[w] for w in ws[a: a + hl.SEGMENT]])):
                s[w] += share
    ratio, within, whole = {}, {}, {}
    if head == 3000:
        assert len(v.head) > hl.CLASS_WORDS + 50 and len(n) > len(v.head) + 500
    for c in {c for c in code.values() if c >= hl.CLASS_WORDS}:
        mine = [w for w in n if code[w] == c]
        part = sum((s[w] for w in mine), np.zeros(hl.STATES)) + 1 / hl.STATES
        part /= part.sum()
        share = {w: (s[w] + hl.OWN * part) / (n[w] + hl.OWN) for w in mine}
        mass = 0.5 * part + sum(((n[w] + 0.5) * share[w] for w in mine), np.zeros(hl.STATES))
        whole[c] = sum(n[w] + 0.5 for w in mine) + 0.5
        ratio |= {w: share[w] * whole[c] / mass for w in mine} | {(c, None): part * whole[c] / mass}
        within |= {w: (n[w] + 0.5) / whole[c] for w in mine}
        total = sum((within[w] * ratio[w] for w in mine), 0.5 / whole[c] * ratio[c, None])
        assert np.allclose(total, 1)
    small = sum(n.values()) + 0.5 * (len(n) + 1)
    got = {r.doc_id: r for r in hl.score(docs, F.col("train")).collect()}
    assert len(got) == len(texts)
    for i, ws in enumerate(words):
        want, now = 0.0, None
        for w in ws:
            e = model.emit[:, code[w]]
            if code[w] >= hl.CLASS_WORDS:
                e = e * (ratio[w] * within[w] if w in n else ratio[code[w], None] * 0.5 / whole[code[w]])
            now = (model.start if now is None else now @ model.move) * e
            want += math.log10(now.sum())
            now = now / now.sum()
        assert math.isclose(got[i].score, want, rel_tol=1e-5)
        assert math.isclose(got[i].base_score, sum(math.log10((n[w] + 0.5) / small) for w in ws), rel_tol=1e-9)
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(ws), sum(w in n for w in ws), sum(n.values()))


def test_op9_ids_and_carried_names(spark):
    rows = [("x", "a b", 7, 1.5), (None, None, None, None), ("x", "a b", 7, 1.5), ("y", "b", 3, 0.5)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, known int, base double")
    got = hl.score(docs, F.col("known").isNotNull(), carry=["known", "base", "text"])
    assert got.columns[:4] == ["doc_id", "known", "base", "text"] and got.schema["doc_id"].dataType.simpleString() == "string"
    assert Counter((r.doc_id, r.known, r.base, r.text, r.n_tokens) for r in got.collect()) == Counter(
        [(*row[:1], row[2], row[3], row[1], 1 + len((row[1] or "").split())) for row in rows])


@pytest.mark.parametrize("n", [3])
def test_few_segments_keep_the_states_apart(spark, n):
    """Starting rounds without any segment do not make the states alike, whatever the rows' numbers."""
    codes = [np.full(20, i, np.uint16).tobytes() for i in range(40)]
    df = spark.createDataFrame([(i, 0, c) for i, c in enumerate(codes)], "_row long, part int, classes binary")
    chosen = F.pmod(F.xxhash64("classes"), F.lit(hl.START_PART)) == 0
    few = [r.classes for r in df.where(~chosen).limit(n).collect()]
    got = []
    for first in (0, 1000):
        df = spark.createDataFrame([(first + i, 0, c) for i, c in enumerate(few)], "_row long, part int, classes binary")
        got.append(hl.train(df, np.ones(40), rounds=1).emit)
    assert np.allclose(*got) and np.ptp(got[0], axis=0).max() > 0.01


@pytest.mark.parametrize("kind", ["int", "string"])
def test_op10_with_ids_of_another_type(spark, kind):
    rows = [(7, "a b c d e"), (3, "a b c d e"), (5, "x y z u v w"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id int, text string").withColumn("doc_id", F.col("doc_id").cast(kind))
    got = pd.near_duplicates(docs)
    assert got.schema["doc_id"].dataType.simpleString() == got.schema["component_id"].dataType.simpleString() == kind
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got.collect()) == [
        ("3", "3"), ("5", "5"), ("7", "3"), ("None", "None")]


def test_op10_broadcasts_no_fingerprints(spark):
    """Spark sizes exploded cells like the fingerprints they come from, and tables by their compressed files."""
    docs = spark.createDataFrame([(i, f"a b c d e {i // 2}") for i in range(60)], "doc_id long, text string")
    got = pd.near_duplicates(docs)
    cells = pd.links(got.select(F.conv("fingerprint", 16, -10).cast("long").alias("fp")).distinct())
    for df in (got, cells):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    assert {(r.doc_id, r.component_id <= r.doc_id) for r in got.collect()} == {(i, True) for i in range(60)}
