"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation of the centred rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import cut_lineage

COMPONENTS = 32
# Residual, against the largest singular value, at which a component is settled.
SETTLED = 1e-15
_LONG = np.iinfo(np.int64)
_WIDEST = 10**38 - 1


@dataclass(frozen=True)
class Whitening:
    """What the rows' whitening needs: row count, exact sums, and one column of each matrix per component.

    ``directions`` are unit eigenvectors of the covariance, ``values`` their eigenvalues, falling; ``total`` is
    the covariance's trace.
    """

    n: int
    sums: tuple[int, ...]
    directions: np.ndarray
    values: np.ndarray
    total: float

    @property
    def scale(self) -> np.ndarray:
        return self.directions / np.sqrt(self.values)


def grid_rows(rows: DataFrame, vec_id: str, embedding: str, steps: int, shift: int) -> DataFrame:
    """``_id`` and ``_x``, entries as ``floor(steps * c) + shift``; rows without a whole finite vector are left out.

    Vectors of another length than the commonest one (the longer of ties) are left out too.
    """
    c = F.transform(F.col(embedding), lambda v: v.cast("double"))
    sound = F.col(embedding).isNotNull() & (F.size(embedding) > 0) & F.forall(
        c, lambda v: F.coalesce(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    # beyond long the nearest long counts
    whole = lambda v: F.when(v * steps >= 2.0**62, F.lit(1 << 62)).when(v * steps <= -(2.0**62), F.lit(-(1 << 62))).otherwise(
        F.floor(v * steps))
    found = rows.where(sound).select(F.col(vec_id).alias("_id"), F.transform(c, lambda v: whole(v) + shift).alias("_x"))
    found = cut_lineage(found)
    sizes = found.groupBy(F.size("_x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    return found.where(F.size("_x") == sizes[0]["size"]) if sizes else found


def _blocks(batch: pa.RecordBatch, at: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of a batch with their vectors as an integer matrix."""
    for start in range(0, batch.num_rows, 2048):
        piece = batch.slice(start, 2048)
        yield piece, piece.column(at).flatten().to_numpy().reshape(piece.num_rows, -1)


def sums_of(grid: DataFrame) -> tuple[int, tuple[int, ...]]:
    """Number of rows and the exact sum of each dimension."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in batches:
            for _, x in _blocks(batch, 0):
                n += len(x)
                high, low = (x >> 31).sum(axis=0), (x & 0x7FFFFFFF).sum(axis=0)
                part = high.astype(object) * (1 << 31) + low.astype(object)
                total = part if total is None else total + part
        if n:
            values = pa.array([n, *total.tolist()], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total) + 1), pa.int32()), values], ["at", "value"])

    parts = grid.select("_x").mapInArrow(run, "at int, value decimal(38,0)")
    got = [int(r.value) for r in parts.groupBy("at").agg(F.sum("value").alias("value")).orderBy("at").collect()]
    return (got[0], tuple(got[1:])) if got else (0, ())


def centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """``x - sums / n``: the whole part of the mean goes as an integer, only the rest as a fraction."""
    whole = np.array([s // n for s in sums], np.int64)
    return (x - whole) - np.array([(s % n) / n for s in sums])


def deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int | None]:
    """Exact sum over dimensions of ``(n x - sums)^2`` of each row; None beyond 38 digits."""
    y = x - np.array([s // n for s in sums], np.int64)
    rest = [s % n for s in sums]
    reach = (float(np.abs(y).max(initial=0)) + 1) * n
    if reach * reach * max(1, len(sums)) < 2.0**62:
        d = n * y - np.array(rest, np.int64)
        return (d * d).sum(axis=1).tolist()
    d = n * y.astype(object) - np.array(rest, object)
    return [v if v <= _WIDEST else None for v in (d * d).sum(axis=1)]


def totals(grid: DataFrame, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows of what ``of`` returns for blocks of rows: one vector of fixed length.

    Each task sends the sums of its rows, one number a place; they meet in an aggregate, so the driver gets
    that vector alone.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for _, x in _blocks(batch, 0):
                part = of(x)
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], ["at", "value"])

    parts = grid.select("_x").mapInArrow(run, "at int, value double")
    got = parts.groupBy("at").agg(F.sum("value").alias("value")).collect()
    return np.array([v for _, v in sorted((r.at, r.value) for r in got)])


def _another(v: list[np.ndarray], d: int) -> np.ndarray | None:
    """A unit vector at right angles to ``v``; None if they span the space."""
    if len(v) == d:
        return None
    new = np.random.default_rng(len(v)).standard_normal(d)
    for _ in range(3):
        for a in v:
            new -= a * (a @ new)
        new /= np.linalg.norm(new)
    return new


def bidiagonalise(grid: DataFrame, n: int, sums: tuple[int, ...], components: int = COMPONENTS,
                  settled: float = SETTLED) -> tuple[np.ndarray, np.ndarray]:
    """Leading singular values of the centred rows X and their right singular vectors, as columns.

    Each round is one job: ``u = X v`` less the earlier left vectors, its norm, and ``X' u``.  A left vector is as
    long as the table and never leaves the rows: it is ``X w`` for a short ``w`` that the driver keeps, so a lost
    task is simply run again.  Left and right vectors are orthogonalised against all earlier ones; the left
    ones by the products ``X' u`` on hand, then by the overlap that the job measures.  A right vector of
    zero length starts again from another direction, so repeated values are found.  It ends when the wanted
    residuals are settled, or with as many vectors as dimensions.
    """
    d = len(sums)
    v, w, y = [_another([], d)], [], []
    alpha: list[float] = []
    beta: list[float] = []
    largest = 0.0
    while True:
        start = v[-1].copy()
        for a, b in zip(w, y):
            start -= a * (b @ v[-1])
        ask = np.column_stack([start, *w])

        def product(x: np.ndarray) -> np.ndarray:
            c = centred(x, n, sums)
            u = c @ ask
            return np.concatenate((c.T @ u[:, 0], u.T @ u[:, 0]))

        got = totals(grid, product)
        back, norm, overlap = got[:d], got[d], got[d + 1:]
        for a, b, h in zip(w, y, overlap):
            start -= a * h
            back = back - b * h
        a = float(np.sqrt(max(0.0, norm - overlap @ overlap)))
        largest = max(largest, a)
        if a > 1e-13 * largest:
            alpha.append(a)
            w.append(start / a)
            y.append(back / a)
            rest = y[-1] - a * v[-1]
            for _ in range(2):
                for x in v:
                    rest = rest - x * (x @ rest)
            b = float(np.linalg.norm(rest))
        else:
            alpha.append(0.0)
            w.append(np.zeros(d))
            y.append(np.zeros(d))
            b = 0.0
        small = np.diag(alpha) + np.diag(beta, 1)
        left, values, right = np.linalg.svd(small)
        if len(v) == d or (len(v) > components and b > 0 and (b * np.abs(left[-1, :components]) <= settled * values[0]).all()):
            break
        if b > 1e-13 * largest:
            v.append(rest / b)
        else:
            b = 0.0
            v.append(_another(v, d))
        beta.append(b)
    return values[:components], np.column_stack(v) @ right[:components].T


def fit(grid: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Components of all rows of ``grid``; fewer where the rows vary in fewer directions, None without any."""
    n, sums = sums_of(grid)
    if not n:
        return None
    trace = float(totals(grid, lambda x: np.array([np.square(centred(x, n, sums)).sum()]))[0]) / n
    if not trace > 0:
        return None
    sigma, directions = bidiagonalise(grid, n, sums, components)
    values = sigma * sigma / n
    kept = sigma > 1e-12 * sigma[0]
    return Whitening(n, sums, directions[:, kept], values[kept], trace)


def identity_error(grid: DataFrame, fitted: Whitening) -> float:
    """Largest absolute entry of the whitened rows' covariance less the identity."""
    k, scale, n, sums = len(fitted.values), fitted.scale, fitted.n, fitted.sums

    def moments(x: np.ndarray) -> np.ndarray:
        z = centred(x, n, sums) @ scale
        return np.concatenate(((z.T @ z).ravel(), z.sum(axis=0)))

    got = totals(grid, moments) / n
    mean = got[k * k:]
    return float(np.abs(got[: k * k].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max())


def project(grid: DataFrame, fitted: Whitening) -> DataFrame:
    """``_id``, ``deviation`` and ``whitened``, an array over the components, of each row."""
    scale, n, sums = fitted.scale, fitted.n, fitted.sums
    k = scale.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, x in _blocks(batch, 1):
                z = np.ascontiguousarray(centred(x, n, sums) @ scale)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, z.size + 1, k), pa.int32()), pa.array(z.ravel()))
                apart = pa.array(deviations(x, n, sums), pa.decimal128(38, 0))
                yield pa.RecordBatch.from_arrays([piece.column(0), apart, lists], ["_id", "deviation", "whitened"])

    kind = grid.schema["_id"].dataType.simpleString()
    return grid.mapInArrow(run, f"_id {kind}, deviation decimal(38,0), whitened array<double>")


def whiten(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", components: int = COMPONENTS,
           steps: int = 64, shift: int = 1_000_000) -> DataFrame:
    """Whitened coordinates of all rows with a whole finite vector, one row per component.

    Returns ``vec_id, component, n, deviation decimal(38,0), whitened, explained, identity_error``; components
    from 1 by falling eigenvalue.  Null vectors and those with null or non-finite entries are dropped, and
    those of another length than the commonest.  Repeated rows and ids count each time; equal eigenvalues
    give any basis of their space.  Directions in which the rows do not vary give no component, so an empty
    table, one row, or equal rows give no rows.  ``deviation`` is null beyond 38 digits.  Other columns are
    dropped.
    """
    grid = grid_rows(rows, vec_id, embedding, steps, shift)
    fitted = fit(grid, components)
    spark = rows.sparkSession
    if fitted is None:
        kind = rows.schema[vec_id].dataType.simpleString()
        return spark.createDataFrame([], f"`{vec_id}` {kind}, component int, n long, deviation decimal(38,0), "
                                         "whitened double, explained double, identity_error double")
    error = identity_error(grid, fitted)
    share: Column = F.element_at(F.array(*[F.lit(float(v / fitted.total)) for v in fitted.values]), F.col("component"))
    out = project(grid, fitted).select("_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    out = out.withColumn("component", (F.col("at") + 1).cast("int"))
    return out.select(F.col("_id").alias(vec_id), "component", F.lit(fitted.n).cast("long").alias("n"), "deviation", "whitened",
                      share.alias("explained"), F.lit(error).alias("identity_error"))
