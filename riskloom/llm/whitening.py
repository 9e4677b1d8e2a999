"""Whitening by Chebyshev-filtered subspace iteration.

The covariance is never formed: a pass over the written centred vectors gives XᵀXQ for a block Q of a few columns, one
sum a partition.  A cycle applies a Chebyshev polynomial in the covariance to the block by its three-term recurrence;
the polynomial is small on [0, b], b the block's least Ritz value, and grows fast beyond it, so that the unwanted
spectrum is damped.  QR and Rayleigh-Ritz follow, until the residuals of the wanted pairs certify them.
"""
from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .numeric_rows import matrix, sum_over, valid_vectors
from .store import Scratch

GUARD = 40                     # columns of the block beyond the wanted ones
DEGREE = 10                    # passes of a cycle
CYCLES = 40
RESIDUAL = 1e-14               # of the largest eigenvalue: certified at once
ACCEPTED = 1e-11               # certified if more cycles don't lessen it
LEAST = 1e-11                  # eigenvalues below this share of the largest count as 0
SEED = 11
PART = 32 << 20                # bytes of vectors in a task of a pass, unless there are fewer tasks than cores then
_HALF = 1 << 26


def scaled(x: np.ndarray, scale: int, shift: int) -> np.ndarray:
    """floor(scale * x) + shift as whole numbers: longs, or Python's where a long is too short."""
    if not x.size or np.abs(x).max() < 2**62 / scale:
        return np.floor(scale * x).astype(np.int64) + shift
    return np.array([int(v) * scale if abs(v) >= 2**53 else math.floor(scale * v) for v in x.ravel().tolist()], dtype=object).reshape(x.shape) + shift


def centred(x: np.ndarray, sums: list[int], n: int) -> np.ndarray:
    """n * x - sums, exactly."""
    most = max(max((abs(int(v)) for v in (x.max(), x.min())), default=0) * n, max(map(abs, sums), default=0)) if x.size else 0
    if most < 2**61 and x.dtype != object:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, dtype=object)


def deviations(d: np.ndarray) -> list[int | None]:
    """Exact sums of squares a row; None where one passes the range of a long."""
    if d.dtype != object and d.size and float(np.abs(d).max()) ** 2 * d.shape[1] < 2**62:
        return (d * d).sum(axis=1).tolist()
    exact = [sum(int(v) ** 2 for v in row) for row in d]
    return [v if v < 2**63 else None for v in exact]


def leading_eigenpairs(times: Callable[[np.ndarray], np.ndarray], size: int, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors of a positive semidefinite operator given by its products."""
    block = min(size, wanted + GUARD)
    q, _ = np.linalg.qr(np.random.default_rng(SEED).standard_normal((size, block)))
    best = None
    for _ in range(CYCLES):
        product = times(q)                                     # Rayleigh-Ritz
        small = q.T @ product
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, product = q @ turn, product @ turn
        if values[0] <= 0:
            return values[:0], q[:, :0]
        keep = int((values[:wanted] > LEAST * values[0]).sum())
        off = float(np.linalg.norm(product[:, :keep] - q[:, :keep] * values[:keep], axis=0).max()) / values[0]
        if best is None or off < best[0]:
            best, better = (off, values[:keep], q[:, :keep]), best is None or off < 0.5 * best[0]
        else:
            better = False
        if off <= RESIDUAL or (best[0] <= ACCEPTED and not better):
            return best[1], best[2]
        edge = max(float(values[-1]), LEAST * values[0])
        middle = half = edge / 2
        if block == size or values[0] <= edge * (1 + 1e-9):    # nothing outside the block to damp: one more turn
            q, _ = np.linalg.qr(product)
            continue
        sigma = first = half / (values[0] - middle)
        before, now = q, (product - middle * q) * (sigma / half)
        for _ in range(DEGREE - 1):
            after = 1 / (2 / first - sigma)
            before, now = now, (times(now) - middle * now) * (2 * after / half) - sigma * after * before
            sigma = after
        q, _ = np.linalg.qr(now)
    raise ArithmeticError(f"not certified after {CYCLES} cycles: residual {best[0]:.1e} of the largest eigenvalue")


def whiten(vectors: DataFrame, components: int = 8, scale: int = 1024, shift: int = 100_000, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for every vector that is left and each
    of the leading components of x = floor(scale * c) + shift.

    Null vectors and vectors that hold a null or non-finite entry are left out; all others make the fit, repeated rows
    each for itself, rows without id too.  A vector shorter than the longest counts as filled up with c = 0.
    Components whose eigenvalue is 0 (below 1e-11 of the largest) can't be whitened and have no rows: vectors of fewer
    dimensions or ranks than ``components`` give fewer rows, a single vector or equal vectors none, nor does an empty
    table.  Of equal eigenvalues any orthonormal vectors are components.  A deviation beyond a long is null.  Other
    columns are ignored.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "whiten")
    rows = scratch.save(valid_vectors(vectors, id_col, vec_col), "vectors")
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    n, size = rows.agg(F.count("*"), F.max("size")).first()
    if not n or not size:
        return spark.createDataFrame([], schema)

    def peaks(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([np.abs(matrix(batch.column("packed"), size)).max(initial=0.0)], pa.float64())], ["peak"])

    peak, = rows.mapInArrow(peaks, "peak double").agg(F.max("peak")).first()
    unit = n << max(0, math.frexp(peak)[1] - 300)              # squares of enormous entries would not be finite

    def whole(batch) -> np.ndarray:
        return scaled(matrix(batch.column("packed"), size), scale, shift)

    def halves(batches):                                       # exact: longs in two parts, both below 2**53 in sum
        for batch in batches:
            x = whole(batch)
            if x.size:
                yield np.stack([(x // _HALF).sum(axis=0), (x % _HALF).sum(axis=0)])

    high, low = sum_over(rows, halves, (2, size))
    sums = [int(h) * _HALF + int(v) for h, v in zip(high, low, strict=True)]

    def centre(batches):
        for batch in batches:
            d = centred(whole(batch), sums, n)
            y = (d / unit).astype(np.float64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(deviations(d), pa.int64()), pa.array([r.tobytes() for r in y], pa.binary())], ["id", "deviation", "packed"])

    # each of some fifty passes starts a task a part: as many as the data need, however finely the input is dealt
    parts = max(spark.sparkContext.defaultParallelism, -(-n * size * 8 // PART))
    data = scratch.save(rows.coalesce(parts).mapInArrow(centre, "id long, deviation long, packed binary"), "centred")
    packed = data.select("packed")

    def times(q: np.ndarray) -> np.ndarray:
        def part(batches):
            for batch in batches:
                if batch.num_rows:
                    y = matrix(batch.column(0), size)
                    yield y.T @ (y @ q)

        return sum_over(packed, part, q.shape) / n

    def squares(batches):
        for batch in batches:
            if batch.num_rows:
                yield np.array([np.square(matrix(batch.column(0), size)).sum()])

    trace = float(sum_over(packed, squares, (1,))[0]) / n
    if trace <= 0:
        return spark.createDataFrame([], schema)
    values, axes = leading_eigenpairs(times, size, min(components, size))
    onto = axes / np.sqrt(values)
    k = len(values)

    def means(batches):
        for batch in batches:
            if batch.num_rows:
                yield (matrix(batch.column(0), size) @ onto).sum(axis=0)

    middle = sum_over(packed, means, (k,)) / n

    def spread(batches):
        for batch in batches:
            if batch.num_rows:
                w = matrix(batch.column(0), size) @ onto - middle
                yield w.T @ w

    error = float(np.abs(sum_over(packed, spread, (k, k)) / n - np.eye(k)).max())
    explained = values / trace

    def project(batches):
        for batch in batches:
            m = batch.num_rows
            w = matrix(batch.column("packed"), size) @ onto
            again = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays([
                batch.column("id").take(again), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, n), pa.int64()), batch.column("deviation").take(again),
                pa.array(w.ravel(), pa.float64()), pa.array(np.tile(explained, m), pa.float64()), pa.array(np.full(m * k, error), pa.float64())], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return data.mapInArrow(project, schema)
