import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from shelfscope.llm import odd_sketch as os_
from tests.conftest import SF
from tests.llm.test_texts import words


def shingles(text):
    w = words(text)
    return {" ".join(w[i: i + 3]) for i in range(max(1, len(w) - 2))} if w else set()


def smallest(texts, percent=85):
    """Smallest id reachable of each row, by brute force over all pairs; texts: (id, text) rows."""
    sets, root = [shingles(t) for _, t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(texts):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted([(d, len(sets[i]), least.get(find(i)), d == least.get(find(i))) for i, (d, _) in enumerate(texts)], key=str)


def as_rows(df):
    return sorted([(r[0], r.n_shingles, r.component_id, r.kept) for r in df.collect()], key=str)


def test_op11_against_brute_force(spark):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert as_rows(entry.queries()["op11_odd_sketches"](spark, SF)) == smallest(texts)


@pytest.fixture(scope="module")
def hot():
    """A chain of near copies, a dense group of them, and unlike texts, all with a common passage."""
    rnd = random.Random(4)
    base = [f"w{rnd.randrange(5000)}" for _ in range(120)]
    texts, text = [], list(base)
    for i in range(40):  # each like the one before, the ends are not alike
        text[3 * i: 3 * i + 2] = [f"c{i}", f"c{i}x"]
        texts.append(" ".join(text))
    for i in range(40):  # all alike
        text = base + ["dense"] * 2
        text[rnd.randrange(120)] = f"d{i}"
        texts.append(" ".join(text))
    for i in range(40):  # half alike: they meet in cells and stay apart
        texts.append(" ".join(base[:90] + [f"u{i}-{k}" for k in range(40)]))
    order = list(range(len(texts)))
    rnd.shuffle(order)
    return [(i, texts[k]) for i, k in enumerate(order)]


@pytest.mark.parametrize("listed, part", [(48, 512), (1, 16), (0, 512)])
def test_large_cells_by_parts_lose_no_link(spark, hot, listed, part):
    docs = spark.createDataFrame(hot, "doc_id long, text string")
    assert as_rows(os_.near_duplicates(docs, listed=listed, part=part)) == smallest(hot)


def test_cases_by_docstring(spark, odd_docs):
    got = os_.near_duplicates(odd_docs)
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    found = sorted([(r.doc_id, r.n_shingles, r.component_id) for r in got.collect()], key=str)
    assert found == sorted([x[:3] for x in smallest(rows)], key=str)
    assert {r.kept for r in got.where("doc_id is null").collect()} == {True}
    assert os_.near_duplicates(odd_docs.limit(0)).count() == 0
    text_ids = odd_docs.withColumn("doc_id", F.col("doc_id").cast("string"))
    assert os_.near_duplicates(text_ids).schema["component_id"].dataType.simpleString() == "string"
    assert os_.near_duplicates(text_ids).count() == odd_docs.count()
    null = spark.createDataFrame([(None, "a b c d"), (4, "a b c d")], "doc_id int, text string")
    assert sorted(map(tuple, os_.near_duplicates(null).collect()), key=str) == [(4, 2, 4, True), (None, 2, 4, False)]


def test_sketch_cutoff_and_estimate(spark):
    """Sketches of sets at the threshold stay below the cutoff, and estimate their similarity closely."""
    rng = np.random.default_rng(2)
    rows = []
    for j in (0.85, 0.9, 0.95, 0.99):
        for _ in range(100):
            both = int(2000 * j)
            pool = rng.integers(0, 1 << 64, 2000, np.uint64, endpoint=False)
            apart = (2000 - both) // 2
            a, b = pool[: both + apart], np.concatenate((pool[:both], pool[both + apart:]))
            s = os_.odd_sketches(np.array([os_.minima(a), os_.minima(b)]))
            rows.append((j, s[0].tolist(), s[1].tolist()))
    df = spark.createDataFrame(rows, "j double, a array<long>, b array<long>").withColumn("z", os_.differing(F.col("a"), F.col("b")))
    df = df.withColumn("found", os_.estimate(F.col("z"))).cache()
    assert df.agg(F.max("z")).first()[0] <= os_.cutoff(85)
    for r in df.groupBy("j").agg(F.avg("found").alias("m"), F.stddev("found").alias("s")).collect():
        assert abs(r.m - r.j) < 0.02 and r.s < 0.05
    assert os_.cutoff(85) < os_.SKETCH_BITS // 4
    far = [os_.odd_sketches(np.array([os_.minima(rng.integers(0, 1 << 63, 500).astype(np.uint64)) for _ in range(2)])) for _ in range(50)]
    assert all(np.bitwise_count((s[0] ^ s[1]).view(np.uint64)).sum() > os_.cutoff(85) for s in far)
