"""Embedding whitening by Chebyshev-filtered subspace iteration.

Entries become whole numbers, floor(``SCALE`` * c) + ``SHIFT``, so counts,
sums and deviations are exact.  The covariance is never formed: a pass over
the rows multiplies it by a block Q of ``BLOCK`` columns, each row centred
first, and adds up one dimensions x BLOCK matrix a task.  A cycle filters the
block by a Chebyshev polynomial (three-term recurrence, one pass a degree)
that keeps the unwanted part of the spectrum, [0, cut], within 1 while the
wanted end grows; QR and a Rayleigh-Ritz step (one more pass) give eigenpairs
and their residuals.  The cut is the block's least Ritz value.  Cycles go on
until every wanted pair is certified: its residual is at most ``TOLERANCE``
times the largest eigenvalue.

The driver holds matrices of dimensions x BLOCK only.

Defined results: vectors that are null or hold null or non-finite entries are
dropped, so are entries beyond 2^43 (not a whole number that doubles hold) and
vectors of another length than the most frequent one (ties: the longer);
repeated rows count and are returned each; directions without variance (least
``FLAT`` of the trace) are no components, so equal vectors or a single one
give an empty result, like an empty table; a deviation beyond 64 bits is null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import discard, written

SCALE = 1024
SHIFT = 100_000
COMPONENTS = 8
#: Columns of the iterated block; more columns damp more of the spectrum.
BLOCK = 32
DEGREE = 10
CYCLES = 60
TOLERANCE = 2e-14
FLAT = 1e-12
LARGEST = float(1 << 43)
#: Rows that one step of a pass centres at a time.
STEP_ROWS = 4_096


def _usable(v: Column) -> Column:
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST))


def whole_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and x (whole numbers) of the rows that take part."""
    v = F.col(vector_col).cast("array<double>")
    x = F.transform(v, lambda c: F.floor(c * SCALE).cast("long") + SHIFT)
    rows = vectors.where(_usable(v)).select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x"))
    sizes = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.col("count").desc(), F.col("d").desc()).first()
    return rows.where(F.size("x") == (sizes["d"] if sizes else 0))


def _matrices(batches: Iterator[pa.RecordBatch], column: int, dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for b in batches:
        for lo in range(0, b.num_rows, STEP_ROWS):
            part = b.slice(lo, STEP_ROWS)
            yield part, part.column(column).flatten().to_numpy().reshape(-1, dim)


def added(rows: DataFrame, shape: tuple[int, int], term: Callable[[np.ndarray], np.ndarray], dim: int) -> np.ndarray:
    """Sum of ``term(x)`` (``shape``) over all rows, added up by task first and
    then cell by cell."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for _, x in _matrices(batches, 0, dim):
            total += term(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["cell", "value"])

    got = rows.mapInArrow(run, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(shape)
    out.ravel()[got.column("cell").to_numpy()] = got.column("value").to_numpy()
    return out


def exact_sums(rows: DataFrame, dim: int) -> tuple[int, list[int], list[int], list[int]]:
    """Row count, and the sum, least and largest entry of each dimension, as
    whole numbers (halves of 32 bits keep the sums within 64)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, least, most = 0, np.zeros((2, dim), np.int64), np.full(dim, 1 << 62), np.full(dim, -(1 << 62))
        for _, x in _matrices(batches, 0, dim):
            n += len(x)
            total += np.stack([(x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)])
            least, most = np.minimum(least, x.min(axis=0)), np.maximum(most, x.max(axis=0))
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim)), pa.array(np.full(dim, n)), *map(pa.array, (*total, least, most))],
                                             ["i", "n", "high", "low", "least", "most"])

    parts = rows.mapInArrow(run, "i long, n long, high long, low long, least long, most long")
    got = parts.groupBy("i").agg(F.sum("n"), F.sum("high"), F.sum("low"), F.min("least"), F.max("most")).collect()
    got = sorted(tuple(r) for r in got)
    return got[0][1] if got else 0, [(r[2] << 32) + r[3] for r in got], [r[4] for r in got], [r[5] for r in got]


class Moments:
    """Exact first moments of whole vectors, and rows centred by them."""

    def __init__(self, n: int, sums: list[int], least: list[int], most: list[int]):
        self.n, self.sums = n, sums
        self.base = np.array([s // n for s in sums], np.int64)
        self.part = np.array([s % n for s in sums], np.float64) / n
        widest = [max(n * hi - s, s - n * lo) for s, lo, hi in zip(sums, least, most)]
        #: Deviations fit into 64 bits whatever the row.
        self.small = sum(w * w for w in widest) < 1 << 63

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.base) - self.part

    def deviations(self, x: np.ndarray) -> list[int | None]:
        if self.small:
            return ((self.n * x - np.array(self.sums, np.int64)) ** 2).sum(axis=1).tolist()
        each = (sum((self.n * c - s) ** 2 for c, s in zip(row, self.sums)) for row in x.tolist())
        return [v if v < 1 << 63 else None for v in each]


def leading_pairs(times: Callable[[np.ndarray], np.ndarray], dim: int, wanted: int, block: int = BLOCK,
                  degree: int = DEGREE, tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray]:
    """The largest ``wanted`` eigenvalues, falling, and unit eigenvectors of a
    positive semidefinite matrix that is known by ``times(Q)`` only."""
    width = min(dim, max(block, 2 * wanted))
    q = np.linalg.qr(np.random.default_rng(11).standard_normal((dim, width)))[0]
    best = np.inf
    for _ in range(CYCLES):
        vq = times(q)
        h = q.T @ vq
        values, turn = np.linalg.eigh((h + h.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, vq = q @ turn, vq @ turn
        residual = np.linalg.norm(vq[:, :wanted] - q[:, :wanted] * values[:wanted], axis=0).max()
        if residual <= tolerance * values[0] or width == dim or values[0] <= 0:
            return values[:wanted], q[:, :wanted]
        # Rounding sets a floor: two cycles there without progress end the search too.
        if residual <= 100 * tolerance * values[0] and residual > best / 2:
            return values[:wanted], q[:, :wanted]
        best = min(best, residual)
        cut = max(values[-1], FLAT * values[0])
        centre = radius = cut / 2
        # Chebyshev polynomials of (V - centre) / radius, scaled to 1 at the largest eigenvalue.
        scale = first = radius / (values[0] - centre)
        before, now = q, (vq - centre * q) * (scale / radius)
        for _ in range(degree - 1):
            after = 1 / (2 / first - scale)
            before, now = now, (times(now) - centre * now) * (2 * after / radius) - scale * after * before
            scale = after
        q = np.linalg.qr(now)[0]
    raise ArithmeticError(f"not certified after {CYCLES} cycles: residual {residual:.3g} of {values[0]:.3g}")


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS,
           block: int = BLOCK) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error
    of every row that takes part and every component."""
    spark = vectors.sparkSession
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = written(whole_vectors(vectors, id_col, vector_col), "whole")
    some = rows.first()
    if some is None:
        return spark.createDataFrame([], schema)
    dim, x = len(some["x"]), rows.select("x")
    moments = Moments(*exact_sums(x, dim))
    n = moments.n

    def times(q: np.ndarray) -> np.ndarray:
        def term(x: np.ndarray) -> np.ndarray:
            c = moments.centred(x)
            return c.T @ (c @ q)
        return added(x, q.shape, term, dim) / n

    trace = added(x, (1, 1), lambda x: np.array([[(moments.centred(x) ** 2).sum()]]), dim)[0, 0] / n
    if trace <= 0:
        discard(rows)
        return spark.createDataFrame([], schema)
    values, vectors_ = leading_pairs(times, dim, min(components, dim), block)
    keep = values > FLAT * trace
    values, project = values[keep], vectors_[:, keep] / np.sqrt(values[keep])
    size = len(values)

    def gram(x: np.ndarray) -> np.ndarray:
        z = moments.centred(x) @ project
        return np.vstack([z.T @ z, z.sum(axis=0)])

    total = added(x, (size + 1, size), gram, dim) / n
    error = float(np.abs(total[:size] - np.outer(total[size], total[size]) - np.eye(size)).max())
    explained = values / trace

    def project_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _matrices(batches, 1, dim):
            z = moments.centred(x) @ project
            each = np.repeat(np.arange(len(x)), size)
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, size + 1), len(x)), pa.int32()),
                 pa.array(np.full(len(each), n)), pa.array(moments.deviations(x), pa.int64()).take(pa.array(each)),
                 pa.array(z.ravel()), pa.array(np.tile(explained, len(x))), pa.array(np.full(len(each), error))],
                [c.split()[0] for c in schema.split(", ")])

    return rows.select("vec_id", "x").mapInArrow(project_rows, schema)
