from collections import Counter, defaultdict
from itertools import combinations

from pyspark.sql import functions as F

import corpus_pipeline as cp
from shelfscope.llm import jaccard_dedup as jd
from shelfscope.llm.common import components, cut_lineage
from tests.conftest import SF

NEAR = "/root/testdata/sf0.01"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in cp.STAGES[:-1]:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == columns
        assert 0 < docs.count() < before or name == "toxicity"
        before = docs.count()
    packed = cp.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == before


def test_odd_rows(spark, odd_docs):
    for _, stage in cp.STAGES:
        out = stage(spark, odd_docs, SF)
        assert out.count() >= 0
        assert stage(spark, odd_docs.limit(0), SF).count() == 0
    near = cp.near_dedup(spark, odd_docs, SF)
    assert near.columns == odd_docs.columns
    assert sorted(str(r.doc_id) for r in near.collect()) == ["1", "3", "5", "7", "8", "None"]


def test_run(spark):
    assert cp.run(spark, SF).where("offset + length > 2048").count() == 0


def shingle_sets(docs):
    out = {}
    for r in docs.collect():
        w = (r.text or "").encode().lower().split()
        out[r.doc_id] = {tuple(w[i: i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    return out


def least_of_groups(sets):
    """Smallest id of each group of five-word Jaccard similarity 0.8 or more, from all pairs that share a shingle."""
    root = {k: k for k in sets}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    holders, both = defaultdict(list), Counter()
    for k in sorted(sets):
        for s in sets[k] or [None]:
            holders[s].append(k)
    for ks in holders.values():
        both.update(combinations(ks, 2))
    for (a, b), n in both.items():
        if not sets[a] or 9 * n >= 4 * (len(sets[a]) + len(sets[b])):
            a, b = sorted((top(a), top(b)))
            root[b] = a
    return {top(k) for k in sets}


def test_near_dedup_finds_all_near_copies(spark):
    docs = spark.read.parquet(f"{NEAR}/documents.parquet")
    want = least_of_groups(shingle_sets(docs))
    got = cp.near_dedup(spark, docs, NEAR).collect()
    assert len(got) == len(want) and {r.doc_id for r in got} == want


def test_large_cells_give_the_same_groups(spark):
    """A cell cut into parts links what its listed pairs link, chains without a common centre included."""
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join([*words[:i], "odd", *words[i:]])) for i in range(0, 120)]
    rows += [(200 + i, " ".join(words[3 * i: 3 * i + 100])) for i in range(90)] + [(999, "some other text of seven words")]
    docs = spark.createDataFrame(rows, "_row long, text string")
    docs = cut_lineage(jd.prints(docs, "text"))
    def groups(**k):
        roots = {r.node: r.root for r in components(jd.links(docs, "text", **k)).collect()}
        out = defaultdict(set)
        for r in docs.collect():
            out[roots.get(r["_set"], r["_set"])].add(r["_row"])
        return sorted(map(sorted, out.values()))
    assert groups(listed=1, part=7) == groups(listed=1) == groups(listed=1000) == [
        list(range(120)), list(range(200, 290)), [999]]


def test_near_dedup_goes_by_rows(spark):
    """Different texts under one id all stay; copies go whether their ids repeat, clash or are null."""
    a, b, c = (" ".join(f"{k}{i}" for i in range(30)) for k in "abc")
    rows = [(7, a, 1), (7, b, 2), (3, a + " end", 3), (None, c, 4), (None, c, 5), (None, b, 6), (9, b, 7)]
    for parts in (1, 4):
        docs = spark.createDataFrame(rows, "doc_id long, text string, n long").repartition(parts, "n")
        assert {(r.doc_id, r.text) for r in cp.near_dedup(spark, docs, NEAR).collect()} == {(3, a + " end"), (7, b), (None, c)}
        assert cp.near_dedup(spark, docs, NEAR).count() == 3


def test_near_dedup_goes_through_the_popcount_grid(spark, monkeypatch):
    """The grid's links alone connect near copies and equal fingerprints; a near fingerprint of another text links nothing."""
    from shelfscope.llm import popcount_dedup

    seen, links = [], popcount_dedup.links
    monkeypatch.setattr(popcount_dedup, "links", lambda fps, *a: seen.append(fps.count()) or links(fps, *a))
    words = [f"w{i}" for i in range(900)]
    texts = [" ".join(words), " ".join([*words, "end"]), " ".join([*words, "other"]), "some other text of seven words"]
    docs = spark.createDataFrame(list(enumerate(texts)), "_row long, text string")
    rows = cut_lineage(jd.prints(docs, "text").withColumn("_bands", F.array().cast("array<long>")))
    roots = jd.roots(rows, "text").collect()
    assert seen and len(roots) == 3 and len({r.root for r in roots}) == 1
    forged = cut_lineage(rows.withColumn("_fp", F.lit(5).cast("long")).withColumn("_n", F.lit(9).cast("long")))
    assert jd.roots(forged.where("_row in (0, 3)"), "text").count() == 0


def test_stages_hand_over_small_batches(spark):
    cp.near_dedup(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000
