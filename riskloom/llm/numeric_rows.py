"""Vectors as packed numbers: valid rows of an array column, and sums over partitions that no order of adding changes
by more than a rounding of the last bit."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import plain, tree_sum


def valid_vectors(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, size, packed): components as float64 bytes of every vector that is not null and holds neither a null nor a
    non-finite component.  Ids may be null."""
    def pack(batches):
        for batch in batches:
            ids, sizes, packed = [], [], []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if v.values.null_count:
                    continue
                x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if np.isfinite(x).all():
                    ids.append(i)
                    sizes.append(len(x))
                    packed.append((x + 0.0).tobytes())      # -0.0 becomes 0.0
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int32()), pa.array(packed, pa.binary())], ["id", "size", "packed"])

    rows = plain(vectors, id_col, vec_col).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vec_col}`").alias("v"))
    return rows.where("v IS NOT NULL").mapInArrow(pack, "id long, size int, packed binary")


def matrix(packed: pa.Array, size: int) -> np.ndarray:
    """Rows of float64 of one size; shorter rows are filled up with zeros."""
    raw = [v.as_buffer() for v in packed]
    if all(b.size == 8 * size for b in raw):
        return np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), size)
    out = np.zeros((len(raw), size))
    for row, b in zip(out, raw, strict=True):
        row[:b.size // 8] = np.frombuffer(b, np.float64)
    return out


def two_sum(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sum of two arrays of (sum, error) pairs, stacked along the first axis as halves."""
    a, b = np.split(x, 2), np.split(y, 2)
    total = a[0] + b[0]
    back = total - a[0]
    error = (a[0] - (total - back)) + (b[0] - back) + a[1] + b[1]
    return np.concatenate([total, error])


def sum_over(df: DataFrame, part: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], shape: tuple[int, ...]) -> np.ndarray:
    """Sum of the arrays of one shape that ``part`` makes of a task's batches, errors of adding carried along."""
    def run(batches):
        total = np.zeros(2 * int(np.prod(shape)))
        for x in part(batches):
            total = two_sum(total, np.concatenate([np.asarray(x, np.float64).ravel(), np.zeros(x.size)]))
        yield pa.RecordBatch.from_arrays([pa.array([zlib_pack(total)], pa.binary())], ["total"])

    got = tree_sum(df.mapInArrow(run, "total binary"), "total", np.float64, two_sum)
    return np.zeros(shape) if got is None else np.add(*np.split(got, 2)).reshape(shape)


def zlib_pack(x: np.ndarray) -> bytes:
    import zlib

    return zlib.compress(x.tobytes(), 1)
