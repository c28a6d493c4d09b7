import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

import __spark_entry__ as entry
from shelfscope.llm import vp_tree as vt, warc_bundles as wb
from tests.conftest import SF


def test_bundles_round_trip(spark, tmp_path):
    rows = [(3, "http://a/", "same"), (1, None, "same"), (2, "u\r\nv", ""), (4, "x", None), (5, "y", "é" * 300_000), (None, "z", "same"),
            (7, "q", "WARC/1.1\r\n\r\n"), (7, "q", "WARC/1.1\r\n\r\n")]
    pages = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, bundle string")
    index = wb.write_bundles(pages, str(tmp_path / "a"), frame_bytes=1000, bundle_bytes=4000)
    got = wb.read_bundles(index, payloads=True).collect()
    assert len(got) == len(rows)
    kind = sorted(((r.page_id, r.record_type, r.refers_to) for r in got), key=str)
    assert kind == sorted([(3, "revisit", 1), (1, "response", None), (2, "response", None), (4, "revisit", 2), (5, "response", None),
                           (None, "revisit", 1), (7, "response", None), (7, "response", None)], key=str)
    for r in got:
        html = next((h or "").encode() for i, _, h in rows if i == r.page_id)
        assert r.payload_bytes == len(html) and r.payload_digest == wb.base32_sha1(html)
        assert r.payload == (html if r.record_type == "response" else None)
    some = wb.read_records(index.where("page_id in (5, 7)")).collect()
    assert sorted(r.page_id for r in some) == [5, 7, 7] and {len(r.payload) for r in some} == {600_000, 12}
    # a plain decoder reads the bundle as well: the seek table is a skippable frame
    name = index.first().bundle
    with open(tmp_path / "a" / name, "rb") as f:
        whole = zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read()
    assert whole.startswith(b"WARC/1.1")
    assert wb.read_bundles(wb.write_bundles(pages.limit(0), str(tmp_path / "b"))).count() == 0
    small = wb.read_bundles(wb.write_bundles(pages, str(tmp_path / "c"), min_revisit_bytes=1)).where("payload_bytes = 0")
    assert {r.record_type for r in small.collect()} == {"response"}


def test_a_bundle_is_read_by_several_tasks(spark, tmp_path):
    """One bundle of 40 frames: every frame once, over more than one task, also for a few records of it."""
    pages = spark.createDataFrame([(i, "u", f"{i} " * 300) for i in range(40)], "page_id long, url string, html string").coalesce(1)
    index = wb.write_bundles(pages, str(tmp_path / "one"), frame_bytes=500)
    assert index.select("bundle").distinct().count() == 1 and index.select("frame").distinct().count() == 40
    assert index.first().folder.startswith("file:///")
    for read, n in ((wb.read_bundles(index), 40), (wb.read_records(index.where("page_id % 2 = 0")), 20)):
        got = read.withColumn("task", F.spark_partition_id()).collect()
        assert len({r.page_id for r in got}) == len(got) == n
        assert len({r.task for r in got}) > 1


def brute(ids, x, query_ids, q, k):
    out = []
    for i, v in zip(query_ids, q):
        s = vt.exact_scores(np.tile(v, (len(x), 1)), x)
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
        out += [(int(i), r + 1, int(ids[j]), float(s[j])) for r, j in enumerate(order)]
    return out


def test_op8_against_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    ask = ids % 20 == 0
    got = sorted(map(tuple, entry.queries()["op8_nearest_neighbours"](spark, SF).collect()))
    assert got == brute(ids, x, ids[ask], x[ask], 20)


@pytest.mark.parametrize("leaf", [4, 64])
def test_exact_and_relaxed(leaf, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 12)) + 6 * rng.normal(size=(8, 12))[rng.integers(0, 8, 3000)]
    x[:900] = x[0]  # a third are copies
    ids, ask = np.arange(3000), np.arange(0, 3000, 20)
    norm = np.sqrt((x * x).sum(axis=1).max())
    want = brute(ids, x, ask, x[ask], 10)

    def rows(factor):
        monkeypatch.setattr(vt.Tree.__init__, "__defaults__", (leaf,))
        q, v, s = vt.search_shard(ids, x, ask, x[ask], 10, norm, factor)
        q = ask[q]
        order = np.lexsort((v, -s, q))
        return list(zip(q[order].tolist(), v[order].tolist(), s[order].tolist()))

    assert rows(1.0) == [(q, v, s) for q, _, v, s in want]
    near = {(q, v) for q, _, v, _ in want}
    assert len(near & {(q, v) for q, v, _ in rows(1.1)}) > 0.9 * len(near)


def test_shards_blocks_and_odd_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(v) for v in rng.normal(size=3)], "c") for i in range(60)]
    rows += [(100, None, "c"), (101, [0.0, 0.0, 0.0], "c"), (102, [1.0, None, 0.0], "c"), (103, [float("nan"), 1.0, 1.0], "c"),
             (104, [float("inf"), 1.0, 1.0], "c"), (105, [], "c"), (None, [1.0, 1.0, 1.0], "c"), (40, rows[40][1], "c")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank string")
    asked = df.where("vec_id % 20 = 0")
    x = [(r.vec_id, r.v) for r in vt.usable(df).collect()]
    ids, v = np.array([i for i, _ in x]), np.array([y for _, y in x])
    got = sorted(map(tuple, vt.nearest(df, asked.dropDuplicates(["vec_id"]), k=5, shard_rows=7, query_rows=2).collect()))
    want = brute(ids, v, np.array([0, 20, 40]), np.array([v[list(ids).index(i)] for i in (0, 20, 40)]), 5)
    assert got == want
    assert vt.nearest(df.limit(0), asked, k=5).count() == 0
    assert vt.nearest(df, asked.limit(0), k=5).count() == 0


def test_queries_of_one_id_are_ranked_apart(spark):
    points = spark.createDataFrame([(i, [float(i), float(i % 7)]) for i in range(1, 60)], "vec_id long, embedding array<double>")
    asked = [(20, [1.0, 20.0]), (20, [1.0, -3.0]), (20, [1.0, -3.0]), (40, [-1.0, 0.5])]
    queries = spark.createDataFrame(asked, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, vt.nearest(points, queries, k=4, shard_rows=11, query_rows=2).collect()))
    ids, x = np.arange(1, 60), np.array([[i, i % 7] for i in range(1, 60)], float)
    want = sorted(row for q, v in asked for row in brute(ids, x, np.array([q]), np.array([v]), 4))
    assert got == want
