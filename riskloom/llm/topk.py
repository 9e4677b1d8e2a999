"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are grouped by dimension and length (buckets whose lengths differ by at most a tenth), a bucket with many
vectors into several blocks.  A first pass against the block of the longest vectors gives each query a lower bound of
its k-th score.  That bound, the query's length and a block's largest length give the cosine a hit must reach there:
above 1 the block is left out, else the vectors' lengths choose the candidates.  Products of a block of queries with a
block of vectors are one matrix product of whole numbers, exact in doubles up to 2**53.  Beyond that a query goes alone:
from ``COORDINATE_FROM`` on the feasible intervals of its largest coordinates choose the candidates, which are verified
by exact integer products.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import Scratch, plain

STEP = math.log(1.1)           # width of a length bucket
BLOCK_NUMBERS = 1 << 18        # numbers in a block of vectors: 2 MB
QUERY_NUMBERS = 1 << 17        # numbers in a block of queries
PRODUCTS = 1 << 21             # products held at once: 16 MB
COORDINATE_FROM, FOCUS = 0.5, 3
SLACK = 1e-9                   # bounds give way by this much, so that rounding never drops a hit


def integer_vectors(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(id, dim, norm, packed, row): floor(scale * x) of every component as float64 bytes, and a number of the row;
    vectors that are null or hold a null or a non-finite component, and rows without id, are left out."""
    def pack(batches):
        for batch in batches:
            ids, dims, norms, packed = [], [], [], []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                values = v.values
                if values.null_count:
                    continue
                x = np.floor(scale * values.to_numpy(zero_copy_only=False).astype(np.float64))
                if not np.isfinite(x).all():
                    continue
                ids.append(i)
                dims.append(len(x))
                norms.append(float(np.sqrt(x @ x)))
                packed.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(norms, pa.float64()), pa.array(packed, pa.binary())], ["id", "dim", "norm", "packed"])

    rows = plain(vectors, id_col, vec_col).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vec_col}`").alias("v"))
    return rows.where("id IS NOT NULL AND v IS NOT NULL").mapInArrow(pack, "id long, dim int, norm double, packed binary").withColumn("row", F.monotonically_increasing_id())


def blocks(rows: DataFrame, numbers: int, by_length: bool) -> DataFrame:
    """A row for each block of (id, dim, norm, packed, row): dim, bucket, part, longest, ids, rows, norms and matrix,
    longest first."""
    bucket = F.when(F.col("norm") > 0, F.floor(F.log("norm") / STEP)).otherwise(F.lit(-(1 << 40))) if by_length else F.lit(0).cast("long")
    rows = rows.withColumn("bucket", bucket)
    counts = rows.groupBy("dim", "bucket").agg(F.count("*").alias("n"))
    per = F.greatest(F.lit(16), (numbers / F.greatest("dim", F.lit(1))).cast("long"))
    placed = rows.join(counts, ["dim", "bucket"]).withColumn("part", F.pmod(F.xxhash64("row"), F.ceil(F.col("n") / per)))
    members = F.sort_array(F.collect_list(F.struct("norm", "id", "row", "packed")), asc=False)      # about ``per`` rows
    grouped = placed.groupBy("dim", "bucket", "part").agg(members.alias("m"))
    return grouped.select("dim", "bucket", "part", F.col("m")[0]["norm"].alias("longest"), F.col("m.id").alias("ids"), F.col("m.row").alias("rows"), F.col("m.norm").alias("norms"), F.col("m.packed").alias("matrix"))


def _matrix(packed: list[bytes], dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(packed), np.float64).reshape(len(packed), dim)


def products(a: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact integer products of integer rows with a vector; past the range of a long an error, not a wrap."""
    if not a.size:
        return np.zeros(len(a), np.int64)
    most = float(np.abs(a).max()) * float(np.abs(q).max()) * a.shape[1]
    if most < 2**53:
        return (a @ q).astype(np.int64)
    if most < 2**62:
        return a.astype(np.int64) @ q.astype(np.int64)
    big = [sum(int(x) * int(y) for x, y in zip(row, q, strict=True)) for row in a]
    return np.array(big, dtype=np.int64)


def hits(query: int, q: np.ndarray, length: float, bound: int | None, ids: np.ndarray, numbers: np.ndarray, norms: np.ndarray, rows: np.ndarray, unit: np.ndarray, k: int) -> list[tuple[int, int]]:
    """The k best (score, id) of a block for the query of row ``query``, none below ``bound``; vectors longest first."""
    chosen = np.arange(len(ids))
    if bound is not None and bound > 0 and length > 0:
        need = bound / length * (1 - SLACK)
        cosine = need / norms[0] if norms[0] > 0 else 2.0
        if cosine > 1 + SLACK:
            return []
        if cosine >= COORDINATE_FROM:
            keep, direction = norms >= need, q / length
            for f in np.argsort(-np.abs(direction))[:FOCUS]:
                middle, reach = direction[f] * cosine, math.sqrt(max(0.0, (1 - direction[f] ** 2) * (1 - min(cosine, 1.0) ** 2)))
                low = middle - reach - SLACK
                high = middle + reach + SLACK
                if direction[f] <= -cosine:
                    low = -1 - SLACK
                if direction[f] >= cosine:
                    high = 1 + SLACK
                keep &= (unit[:, f] >= low) & (unit[:, f] <= high)
            chosen = np.flatnonzero(keep)
        else:
            chosen = np.arange(int(np.searchsorted(-norms, -need, "right")))
    chosen = chosen[numbers[chosen] != query]
    score = products(rows[chosen], q)
    if bound is not None:
        chosen, score = chosen[score >= bound], score[score >= bound]
    best = np.lexsort((ids[chosen], -score))[:k]
    return [(int(score[i]), int(ids[chosen[i]])) for i in best]


def block_hits(queries: np.ndarray, q: np.ndarray, bounds: list[int | None], ids: np.ndarray, numbers: np.ndarray, norms: np.ndarray, rows: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(place, score, id) of the k best of a block for each query of a block, as ``hits`` finds them; ``queries`` are the
    queries' rows.  Products must be below 2**53."""
    known = np.array([b is not None for b in bounds], bool)
    least = np.array([-np.inf if b is None else b for b in bounds], np.float64)
    lengths = np.sqrt(np.square(q).sum(axis=1))
    need = np.where((least > 0) & (lengths > 0), least / np.where(lengths > 0, lengths, 1) * (1 - SLACK), -np.inf)
    alive = np.flatnonzero(need <= norms[0] * (1 + SLACK)) if len(rows) else np.zeros(0, np.int64)
    out: list[tuple[int, int, int]] = []
    for low in range(0, len(alive), max(1, PRODUCTS // max(len(rows), 1))):
        some = alive[low:low + max(1, PRODUCTS // max(len(rows), 1))]
        many = int(np.searchsorted(-norms, -need[some].min(), "right"))
        score = q[some] @ rows[:many].T
        score[queries[some][:, None] == numbers[None, :many]] = -np.inf         # its own row
        if many > k:
            own = np.partition(score, many - k, axis=1)[:, many - k] if not known[some].all() else least[some]
            floor = np.where(known[some], least[some], own)
        else:
            floor = least[some]
        at, who = np.nonzero((score >= floor[:, None]) & (score > -np.inf))
        for i, found in zip(*_runs(at, who), strict=True):
            own = score[i, found]
            best = np.lexsort((ids[found], -own))[:k]
            out += [(int(some[i]), int(own[j]), int(ids[found[j]])) for j in best]
    return out


def _runs(at: np.ndarray, who: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    """The different values of the sorted ``at``, and the part of ``who`` that goes with each."""
    first = np.flatnonzero(np.diff(at, prepend=-1))
    return at[first].tolist(), np.split(who, first[1:]) if len(first) else []


def _scan(pairs: DataFrame, k: int) -> DataFrame:
    """(query, query_id, vec_id, score) of each block pair's best; ``query`` is the query's row."""
    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                ids, numbers, norms, rows = np.array(r["ids"]), np.array(r["rows"]), np.array(r["norms"]), _matrix(r["matrix"], r["dim"])
                queries, asked, bounds = np.array(r["q_rows"]), _matrix(r["q_matrix"], r["dim"]), r["bounds"]
                if not rows.size or float(np.abs(rows).max()) * float(np.abs(asked).max()) * r["dim"] < 2**53:
                    out = [(r["q_rows"][at], r["q_ids"][at], i, s) for at, s, i in block_hits(queries, asked, bounds, ids, numbers, norms, rows, k)]
                else:
                    unit = rows / np.where(norms > 0, norms, 1)[:, None]
                    out = [(query, query_id, i, s) for query, query_id, q, b in zip(r["q_rows"], r["q_ids"], asked, bounds, strict=True)
                           for s, i in hits(query, q, float(np.sqrt(q @ q)), b, ids, numbers, norms, rows, unit, k)]
                columns = list(zip(*out, strict=True)) or [[], [], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query", "query_id", "vec_id", "score"])

    columns = ["q_rows", "q_ids", "q_matrix", "bounds", "dim", "ids", "rows", "norms", "matrix"]
    return pairs.select(*columns).mapInArrow(run, "query long, query_id long, vec_id long, score long")


def top_products(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each vector whose id is divisible by ``every`` the k highest integer
    products with the other vectors of its dimension, ties to the smaller id.

    Null vectors, vectors with null or non-finite components and rows without id take no part.  Rows count each for
    itself: a row that repeats an id or a vector is a candidate, and a query if its id is one, and a query only never
    meets its own row.  Vectors of length 0 score 0.  Fewer candidates
    than k give fewer rows, an empty table none; other columns are ignored.  Scores beyond a long raise an error.
    """
    scratch = Scratch(vectors.sparkSession, "topk")
    rows = scratch.save(integer_vectors(vectors, id_col, vec_col, scale), "vectors")
    data = scratch.save(blocks(rows, BLOCK_NUMBERS, True), "blocks")
    asked = blocks(rows.where(F.col("id") % every == 0), QUERY_NUMBERS, False)
    asked = asked.select(F.col("dim").alias("q_dim"), F.col("part").alias("q_part"), F.col("ids").alias("q_ids"), F.col("rows").alias("q_rows"), F.col("norms").alias("q_norms"), F.col("matrix").alias("q_matrix"))
    asked = scratch.save(asked, "queries")

    first = data.groupBy("dim").agg(F.max(F.struct("longest", "bucket", "part")).alias("f")).select("dim", F.col("f.bucket").alias("bucket"), F.col("f.part").alias("part"))
    seed = data.join(first, ["dim", "bucket", "part"], "left_semi")
    none = F.transform("q_ids", lambda _: F.lit(None).cast("long"))
    found = _scan(asked.join(seed, F.col("q_dim") == F.col("dim")).withColumn("bounds", none), k)
    bounds = found.groupBy("query").agg(F.count("*").alias("c"), F.min("score").alias("bound")).where(F.col("c") >= k)
    each = asked.select("q_dim", "q_part", F.posexplode(F.arrays_zip("q_rows", "q_norms")).alias("at", "q"))
    each = each.join(bounds, F.col("q.q_rows") == F.col("query"), "left")
    reach = F.when(F.col("bound") > 0, F.col("bound") / F.col("q.q_norms")).otherwise(F.lit(float("-inf")))
    known = each.groupBy("q_dim", "q_part").agg(F.sort_array(F.collect_list(F.struct("at", "bound"))).alias("b"), F.min(reach).alias("least"))   # one query block
    asked = scratch.save(asked.join(known.withColumn("bounds", F.col("b.bound")), ["q_dim", "q_part"]).drop("b"), "bounded")

    near = data.select("dim", "bucket", "part", "longest").join(asked.select("q_dim", "q_part", "least"), (F.col("q_dim") == F.col("dim")) & (F.col("longest") >= F.col("least") * (1 - SLACK)))
    pairs = near.drop("least", "longest", "q_dim").join(data, ["dim", "bucket", "part"]).join(asked.withColumnRenamed("q_dim", "dim"), ["dim", "q_part"])
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    ranked = _scan(pairs, k).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


#: DuckDB SQL of the query: every product of a query with every other vector.
SQL = """
WITH v AS (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.row, q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.row <> c.row WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
