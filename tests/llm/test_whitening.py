import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from shelfscope.llm import lanczos_whiten as lw
from tests.conftest import SF


def brute(vectors, shift=1_000_000):
    x = np.floor(64 * np.array(vectors, float)).astype(np.int64) + shift
    n, s = len(x), x.sum(axis=0)
    c = (n * x - s) / n
    e, p = np.linalg.eigh(c.T @ c / n)
    e, p = e[::-1], p[:, ::-1]
    return e, c @ p, ((n * x - s) ** 2).sum(axis=1)


def check(got, vectors, ids, components=32):
    e, z, deviation = brute(vectors)
    k = min(components, int((e > 1e-20 * e[0]).sum()))
    rows = sorted(got.collect(), key=lambda r: (r[0], r.component))
    assert len(rows) == k * len(ids)
    w = np.array([r.whitened for r in rows]).reshape(-1, k)
    order = np.argsort(ids, kind="stable")
    z = z[order][:, :k] / np.sqrt(e[:k])
    assert np.abs(w * np.sign((w * z).sum(axis=0)) - z).max() < 1e-8
    assert [int(r.deviation) for r in rows[::k]] == deviation[order].tolist()
    assert np.allclose([r.explained for r in rows[:k]], e[:k] / e.sum(), rtol=1e-9)
    assert {r.n for r in rows} == {len(ids)} and len({r.identity_error for r in rows}) == 1
    assert rows[0].identity_error < 1e-9


def test_op12_against_eigenvectors(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    rows = [r for r in rows if r.embedding is not None and all(v is not None and np.isfinite(v) for v in r.embedding)]
    check(entry.queries()["op12_lanczos_whitening"](spark, SF), [r.embedding for r in rows], [r.vec_id for r in rows])


def test_few_and_equal_directions(spark):
    """Constant and dependent dimensions give no component; equal eigenvalues give all of theirs."""
    rng = np.random.default_rng(3)
    a = rng.normal(0, 20, (200, 3))
    vectors = np.column_stack((a, a[:, 0], np.ones(200), a[:, 1] * 0))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    check(lw.whiten(df), vectors, list(range(200)))
    cube = np.array([[a, b, c, d] for a in (-1.0, 1) for b in (-1.0, 1) for c in (-1.0, 1) for d in (-3.0, 3)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(cube)], "vec_id long, embedding array<double>")
    rows = lw.whiten(df).collect()
    assert {r.component for r in rows} == {1, 2, 3, 4} and rows[0].identity_error < 1e-9
    assert sorted({round(r.explained, 9) for r in rows}) == [round(1 / 12, 9), 0.75]


def test_settles_before_all_dimensions(spark):
    """With clear components it ends after fewer rounds than dimensions."""
    rng = np.random.default_rng(5)
    vectors = rng.normal(0, 1, (400, 90)) * 0.9 ** np.arange(90) * 300
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    asked = []
    keep, lw.totals = lw.totals, lambda *a: asked.append(1) or keep(*a)
    try:
        check(lw.whiten(df, components=3), vectors, list(range(400)), components=3)
    finally:
        lw.totals = keep
    assert len(asked) < 60


def test_cases_by_docstring(spark):
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [3.0, -1.0]), (2, None), (3, [1.0, None]), (4, [float("nan"), 1.0]),
            (5, [float("inf"), 1.0]), (6, []), (7, [1.0]), (8, [0.5, 7.25])]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<float>").withColumns({c: F.lit(1) for c in ("n", "component", "_x", "whitened")})
    got = lw.whiten(df)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert sorted(((r.vec_id, r.component, r.n) for r in got.collect()), key=str) == sorted(
        [(i, c, 4) for i in (1, 1, None, 8) for c in (1, 2)], key=str)
    for none in (df.limit(0), df.where("vec_id = 8"), df.where("vec_id = 1"), df.where("vec_id = 2")):
        assert lw.whiten(none).collect() == []


@pytest.mark.parametrize("scale, offset", [(1e15, 0.0), (1.0, 3e12), (3e38, 0.0)])
def test_wide_entries_stay_exact(spark, scale, offset):
    values = [[1.5 * scale + offset, 2.0], [0.25 * scale + offset, -7.0], [-scale + offset, 1.0]]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "vec_id long, embedding array<double>")
    grid = [[min(max(int(np.floor(64 * v)), -(1 << 62)), 1 << 62) + 1_000_000 for v in r] for r in values]
    sums = [sum(c) for c in zip(*grid)]
    want = [sum((3 * v - s) ** 2 for v, s in zip(r, sums)) for r in grid]
    got = {r.vec_id: r.deviation for r in lw.whiten(df).collect()}
    assert got == {i: (w if w < 10**38 else None) for i, w in enumerate(want)}
