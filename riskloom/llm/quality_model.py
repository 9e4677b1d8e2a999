"""Quality classifier: ridge regression on random Fourier features of document statistics, isotonic calibration.

The statistics are squashed and standardised, and mapped to ``FEATURES`` random cosines that approximate a Gaussian
kernel.  Every partition sums its normal equations, one part for each of ``FOLDS`` folds; the sums meet in a tree and
the driver solves systems of a fixed size.  The folds' left-out scores, counted in a fixed grid, are calibrated by
pool-adjacent-violators.  All labelled rows given are used; only the statistics of a text enter its score.
"""
from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .store import Scratch, plain, tree_sum

FEATURES, FOLDS, RIDGE, BANDWIDTH, GRID, SEED = 256, 4, 1e-4, 4.0, 4096, 5
STATISTICS = ("log_words", "word_bytes", "upper", "symbols", "marks", "bars", "stops", "commas", "digits", "distinct", "twins", "repeats", "lines", "non_ascii", "short_words", "plain_ends")


def _table(chars: str) -> np.ndarray:
    out = np.zeros(256, np.float64)
    out[[ord(c) for c in chars]] = 1
    return out


_SYMBOLS, _MARKS, _BARS, _STOPS, _COMMAS, _LINES = (_table(c) for c in ("#*$%&|<>", "!?", "|", ".", ",", "\n"))
_UPPER, _LOWER, _DIGITS = (_table("".join(map(chr, range(a, b)))) for a, b in ((65, 91), (97, 123), (48, 58)))
_HIGH = np.zeros(256)
_HIGH[128:] = 1
_LETTER = (_UPPER + _LOWER + _HIGH) > 0


def statistics(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, statistic) values between 0 and about 1, and a hash of each row's words."""
    n = len(offsets) - 1
    starts, ends, rows = tb.words(raw, offsets)
    hashes = tb.word_hashes(raw, starts, ends, lower=False)
    n_words = np.bincount(rows, minlength=n).astype(np.float64)
    words = np.maximum(n_words, 1)
    ink = np.bincount(rows, ends - starts, n)

    def chars(table):
        return np.diff(np.concatenate([[0.0], np.cumsum(table[raw])])[offsets]) if len(raw) else np.zeros(n)

    def distinct(values, of):
        order = np.lexsort((values, of))
        values, of = values[order], of[order]
        new = np.ones(len(of), bool)
        new[1:] = (values[1:] != values[:-1]) | (of[1:] != of[:-1])
        return np.bincount(of[new], minlength=n)

    upper, letters = chars(_UPPER), chars(_UPPER + _LOWER + _HIGH)
    together = rows[1:] == rows[:-1]
    twins = np.bincount(rows[1:][together & (hashes[1:] == hashes[:-1])], minlength=n)
    grams, of, _ = tb.shingles(hashes, rows, n, 3)
    n_grams = np.maximum(np.bincount(of, minlength=n), 1)
    plain_ends = np.bincount(rows, _LETTER[raw[ends - 1]] if len(ends) else None, n) if len(ends) else np.zeros(n)
    short = np.bincount(rows, ends - starts == 1, n) if len(ends) else np.zeros(n)
    out = np.stack([
        np.log1p(n_words) / 12, np.minimum(ink / words / 20, 2), upper / np.maximum(letters, 1), np.sqrt(chars(_SYMBOLS) / np.maximum(ink, 1)),
        np.sqrt(np.minimum(chars(_MARKS) / words, 4)), np.sqrt(np.minimum(chars(_BARS) / words, 4)), np.minimum(chars(_STOPS) / words, 2), np.minimum(chars(_COMMAS) / words, 2),
        np.sqrt(chars(_DIGITS) / np.maximum(ink, 1)), np.where(n_words > 0, _distinct_share(distinct(hashes, rows), words), 1.0), np.sqrt(twins / words),
        np.where(n_words > 2, 1 - distinct(grams, of) / n_grams, 0.0), np.minimum(chars(_LINES) / words, 2), chars(_HIGH) / np.maximum(ink, 1), short / words, plain_ends / words], 1)
    mark, filled = np.zeros(n, np.uint64), np.flatnonzero(n_words)
    if len(filled):
        mark[filled] = np.add.reduceat(tb.mix(hashes, 60), np.flatnonzero(np.diff(rows, prepend=-1)))
    return out, mark


def _distinct_share(distinct: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Distinct words against words ** 0.85: ordinary texts of all lengths come out much alike."""
    return np.minimum(distinct / words**0.85, 2)


def with_statistics(documents: DataFrame) -> DataFrame:
    """(doc_id, fold, stats) for every row of ``documents(doc_id, text)``; a null text counts as empty."""
    def run(batches):
        for batch in batches:
            for at, raw, offsets in tb.text_slices(batch.column(1)):
                stats, mark = statistics(raw, offsets)
                n = len(stats)
                values = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * stats.shape[1]), pa.array(stats.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), pa.array((mark % np.uint64(FOLDS)).astype(np.int32)), values], ["doc_id", "fold", "stats"])

    rows = plain(documents, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, fold int, stats array<double>")


@dataclass
class Model:
    """Centre and scale of the statistics, random directions and phases, ridge weights, calibration steps."""

    centre: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    xs: np.ndarray
    ys: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = 2 * np.tanh((stats - self.centre) / self.scale / 2)
        return np.concatenate([np.sqrt(2 / FEATURES) * np.cos(z @ self.directions + self.phases), np.ones((len(z), 1))], 1)

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.features(stats) @ self.weights, self.xs, self.ys)


def pool(ys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Isotonic fit of means with weights: neighbours that fall are pooled."""
    blocks: list[list[float]] = []
    for y, c in zip(ys, counts, strict=True):
        blocks.append([y * c, c, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            total, weight, size = blocks.pop()
            blocks[-1] = [blocks[-1][0] + total, blocks[-1][1] + weight, blocks[-1][2] + size]
    return np.concatenate([np.full(int(size), total / weight) for total, weight, size in blocks])


def _stacked(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(STATISTICS))


def fit(labelled: DataFrame) -> Model | float:
    """A model from ``labelled(fold, stats, y)``, y 0 or 1; the mean label, 0.5 without rows, if there is nothing to part."""
    d = len(STATISTICS)
    sums = labelled.agg(F.count("*"), F.avg("y"), *(f(F.col("stats")[i]) for i in range(d) for f in (F.avg, F.stddev_pop))).first()
    if not sums[0] or sums[1] in (0.0, 1.0):
        return float(sums[1]) if sums[0] else 0.5
    rng = np.random.default_rng(SEED)
    model = Model(np.array(sums[2::2], float), np.maximum(np.array(sums[3::2], float), 0.02), rng.normal(0, 1 / BANDWIDTH, (d, FEATURES)),
                  rng.uniform(0, 2 * np.pi, FEATURES), np.zeros(FEATURES + 1), np.zeros(1), np.zeros(1))
    size = FEATURES + 2

    def equations(batches):
        total = np.zeros((FOLDS, size, size))
        for batch in batches:
            x = np.concatenate([model.features(_stacked(batch, "stats")), batch.column("y").to_numpy(zero_copy_only=False)[:, None]], 1)
            fold = batch.column("fold").to_numpy(zero_copy_only=False)
            for k in range(FOLDS):
                total[k] += x[fold == k].T @ x[fold == k]
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], ["sums"])

    total = tree_sum(labelled.mapInArrow(equations, "sums binary"), "sums", np.float64).reshape(FOLDS, size, size)

    def solve(m):
        n = m[-2, -2]
        return np.linalg.solve(m[:-1, :-1] + RIDGE * max(n, 1) * np.eye(size - 1), m[:-1, -1])

    everything = total.sum(0)
    model.weights = solve(everything)
    left_out = [solve(everything - total[k]) for k in range(FOLDS)]

    def grid(batches):
        counts = np.zeros((2, GRID))
        for batch in batches:
            x, fold = model.features(_stacked(batch, "stats")), batch.column("fold").to_numpy(zero_copy_only=False)
            s = np.einsum("ij,ij->i", x, np.array(left_out)[fold])
            cell = np.clip(((s + 1) / 3 * GRID).astype(int), 0, GRID - 1)
            counts += np.stack([np.bincount(cell, minlength=GRID), np.bincount(cell, batch.column("y").to_numpy(zero_copy_only=False), GRID)])
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(counts.tobytes(), 1)], pa.binary())], ["sums"])

    counts, positive = tree_sum(labelled.mapInArrow(grid, "sums binary"), "sums", np.float64).reshape(2, GRID)
    used = np.flatnonzero(counts)
    model.xs, model.ys = (used + 0.5) / GRID * 3 - 1, pool(positive[used] / counts[used], counts[used])
    return model


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether crc32 of doc_id as text is divisible by ``folds``; false without doc_id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def quality_scores(documents: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``documents(doc_id, text)``, learned from the rows of
    ``labels(doc_id, quality)`` that are not held out.

    A null text counts as empty and is scored so; a label that is null or belongs to no document is not used; repeated
    documents are scored each, repeated labels count each.  Without labels of both kinds every score is the mean label,
    0.5 without any.  Other columns are ignored; an empty table gives an empty result.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "quality")
    rows = scratch.save(with_statistics(documents), "statistics")
    marks = plain(labels, "doc_id", "quality").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("y"))
    labelled = rows.where(~held_out(F.col("doc_id"))).join(marks.where("y IN (0, 1)"), "doc_id").select("fold", "stats", "y")
    model = fit(scratch.save(labelled, "labelled"))
    if isinstance(model, float):
        out = rows.select("doc_id", F.lit(model).alias("score"))
    else:
        def run(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.clip(model.score(_stacked(batch, "stats")), 0, 1))], ["doc_id", "score"])

        out = rows.mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
