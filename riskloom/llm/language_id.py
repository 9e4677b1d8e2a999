"""Language identification by a linear-chain conditional random field over words.

Words are runs of letters (a-z and non-ASCII bytes of the lower-cased text).  Features of a word: byte bigrams and
trigrams with word boundaries, prefixes and suffixes of 2 to 4 bytes, and its entry in a lexicon of frequent training
words.  Learned transitions join neighbouring words, forward-backward gives each word's label probabilities, so text
that switches language is labelled word by word.  A document's language has the highest mean probability.

Training uses a bounded sample of labelled rows: about ``docs_per_lang`` documents of each language, picked by a hash
of doc_id, and of each at most ``windows_per_doc`` windows of ``WINDOW`` words spread over the whole text.  A quarter of
the windows is spliced from two languages so that switches are seen.  Labelling reads every word of every text.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .store import plain

WINDOW = 32
BITS = 18                    # 2^18 hashed features
LEXICON_BITS = 14            # 2^14 places for lexicon words
MAX_LANGS = 256
SEED = 17

_LETTERS = np.zeros(256, bool)
_LETTERS[97:123] = True
_LETTERS[128:] = True
_KIND = tb.mix(np.arange(16, dtype=np.uint64), 23) | np.uint64(1)


def _runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row) of the letter runs of each row."""
    return tb.runs(_LETTERS[data], offsets)


def _place(code: np.ndarray, kind: int) -> np.ndarray:
    return ((code * _KIND[kind] + _KIND[15 - kind]) >> np.uint64(64 - BITS)).astype(np.int32)


def _features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lexicon: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of each byte of each word, first byte of each word, features of each word)."""
    inside = _LETTERS[data]
    clean = np.where(inside, data, np.uint8(32))
    padded = np.concatenate([np.full(5, 32, np.uint8), clean, np.full(5, 32, np.uint8)]).astype(np.uint64)
    lengths = ends - starts
    begin = np.cumsum(lengths) - lengths
    at = np.arange(int(lengths.sum())) + np.repeat(starts - begin, lengths) + 5
    two = padded[at - 1] << np.uint64(8) | padded[at]
    grams = np.stack([_place(two, 0), _place(two << np.uint64(8) | padded[at + 1], 1)], 1)
    head, tail = padded[starts + 5], padded[ends + 4]
    per_word = []
    for k in range(1, 4):
        more = np.uint64(8 * k)
        inner = lengths > k
        head = head | np.where(inner, padded[starts + 5 + np.minimum(k, lengths)], np.uint64(32)) << more
        tail = tail | np.where(inner, padded[np.maximum(ends + 4 - k, 0)], np.uint64(32)) << more
        per_word += [_place(head, 2 + k), _place(tail, 6 + k)]
    known = tb.word_hashes(data, starts, ends, lower=False)
    slot = (known >> np.uint64(64 - LEXICON_BITS)).astype(np.int64)
    entry = np.where(lexicon[slot] == known, (1 << BITS) + slot, (1 << BITS) + (1 << LEXICON_BITS)).astype(np.int32)
    return grams, begin, np.stack([*per_word, entry], 1)


@dataclass
class Crf:
    """langs; weights of features (a row each) and transitions (from, to); lexicon of word hashes."""

    langs: list[str]
    weights: np.ndarray
    moves: np.ndarray
    lexicon: np.ndarray

    def scores(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        grams, begin, words = _features(data, starts, ends, self.lexicon)
        by_byte = self.weights[grams[:, 0]] + self.weights[grams[:, 1]]
        total = np.add.reduceat(by_byte, begin, axis=0)
        for k in range(words.shape[1]):
            total += self.weights[words[:, k]]
        return total

    def documents(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sum of word probabilities for each row and language, words of each row)."""
        n = len(offsets) - 1
        starts, ends, rows = _runs(data, offsets)
        sums = np.zeros((n, len(self.langs)))
        if len(starts):
            shares = marginals(self.scores(data, starts, ends), rows, self.moves)
            first = np.flatnonzero(np.diff(rows, prepend=-1))
            sums[rows[first]] = np.add.reduceat(shares.astype(np.float64), first, axis=0)
        return sums, np.bincount(rows, minlength=n)


def marginals(scores: np.ndarray, rows: np.ndarray, moves: np.ndarray, block: int = 32) -> np.ndarray:
    """Forward-backward over every row's words at once: (word, label) probabilities.

    Rows are cut into blocks of words.  The blocks' transfer matrices are multiplied step by step for all blocks
    together, then chained along each row, then each block runs forward and backward from its ends.
    """
    e = np.exp(scores - scores.max(1, keepdims=True)).astype(np.float32)
    m = np.exp(moves - moves.max()).astype(np.float32)
    n, k = e.shape
    count = np.bincount(rows)
    start = np.cumsum(count) - count
    place = np.arange(n) - start[rows]
    blocks = -(-count // block)
    first_block = np.cumsum(blocks) - blocks
    of = first_block[rows] + place // block
    total = int(blocks.sum())
    steps = np.ones((block, total, k), np.float32)
    real = np.zeros((block, total), bool)
    steps[place % block, of], real[place % block, of] = e, True
    opening = np.zeros(total, bool)
    opening[first_block[count > 0]] = True

    def norm(x):
        return x / x.max(tuple(range(1, x.ndim)), keepdims=True)

    eye = np.eye(k, dtype=np.float32)
    x = np.where(opening[:, None, None], eye, m) * steps[0][:, None, :]
    for t in range(1, block):
        x = np.where(real[t][:, None, None], norm((x @ m) * steps[t][:, None, :]), x)
    before, after = np.ones((total, k), np.float32), np.ones((total, k), np.float32)
    live = np.flatnonzero(blocks > 1)
    for j in range(1, int(blocks.max())):
        live = live[blocks[live] > j]
        b = first_block[live] + j
        before[b] = norm((before[b - 1][:, None, :] @ x[b - 1])[:, 0])
    for j in range(int(blocks.max()) - 1, 0, -1):
        b = first_block[np.flatnonzero(blocks > j)] + j
        after[b - 1] = norm((x[b] @ after[b][:, :, None])[:, :, 0])
    forward = np.empty((block, total, k), np.float32)
    f = np.where(opening[:, None], steps[0], before @ m * steps[0])
    forward[0] = f = norm(f)
    for t in range(1, block):
        f = np.where(real[t][:, None], norm(f @ m * steps[t]), f)
        forward[t] = f
    g = after
    for t in range(block - 1, -1, -1):
        forward[t] *= g
        g = np.where(real[t][:, None], norm((g * steps[t]) @ m.T), g)
    out = forward[place % block, of]
    return out / out.sum(1, keepdims=True)


def held_out(doc_id: Column, folds: int = 3, fold: int = 1) -> Column:
    """Whether crc32 of doc_id as text leaves ``fold``; false without doc_id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def _windows(labelled: DataFrame, per_doc: int) -> list[tuple[str, str]]:
    """(lang, words joined by spaces) of the sampled windows, cut on the executors."""
    def cut(batches):
        tb.begin("language_id")
        for batch in batches:
            langs, texts = [], []
            for at, raw, offsets in tb.text_slices(batch.column(1)):
                starts, ends, rows = _runs(raw, offsets)
                count = np.bincount(rows, minlength=len(offsets) - 1)
                begin = np.cumsum(count) - count
                for r in np.flatnonzero(count):
                    m = min(per_doc, -(-int(count[r]) // WINDOW))
                    for s in np.unique(np.linspace(0, max(0, count[r] - WINDOW), m).astype(int)):
                        w = range(begin[r] + s, begin[r] + min(s + WINDOW, count[r]))
                        langs.append(batch.column(0)[at + int(r)].as_py())
                        texts.append(b" ".join(raw[starts[i]:ends[i]].tobytes() for i in w).decode(errors="replace"))
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(texts, pa.string())], ["lang", "window"])

    return sorted((r.lang, r.window) for r in labelled.mapInArrow(cut, "lang string, window string").collect())


def train(documents: DataFrame, docs_per_lang: int = 200, windows_per_doc: int = 8, epochs: int = 4) -> Crf | None:
    """Fit on ``documents(doc_id, text, lang)``, rows without one of them left out.  None if no row is left.  More
    than ``MAX_LANGS`` languages are refused."""
    rows = plain(documents, "doc_id", "text", "lang").where("doc_id IS NOT NULL AND lang IS NOT NULL").where(F.col("text").rlike("\\p{L}"))
    sizes = {r.lang: r["count"] for r in rows.groupBy("lang").count().limit(MAX_LANGS + 1).collect()}
    if len(sizes) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    if not sizes:
        return None
    share = F.create_map(*(F.lit(x) for lang, n in sorted(sizes.items()) for x in (lang, min(1.0, docs_per_lang / n))))
    drawn = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(SEED)), F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30)
    windows = list(dict.fromkeys(_windows(rows.where(drawn).select("lang", F.lower("text").alias("text")), windows_per_doc)))
    return fit(windows, epochs)


def fit(windows: list[tuple[str, str]], epochs: int = 4, rate: float = 0.2, decay: float = 1e-4) -> Crf:
    """AdaGrad on the log-likelihood of label sequences, from (lang, words) windows."""
    rng = np.random.default_rng(SEED)
    langs = sorted({lang for lang, _ in windows})
    index = {lang: i for i, lang in enumerate(langs)}
    tokens = [(w, index[lang]) for lang, window in windows for w in window.split(" ") if w]
    data = np.frombuffer((" ".join(w for w, _ in tokens) + " ").encode(), np.uint8)
    starts, ends, _ = _runs(data, np.array([0, len(data)]))
    y_all = np.array([y for _, y in tokens])
    hashes = tb.word_hashes(data, starts, ends, lower=False)
    seen, times = np.unique(hashes, return_counts=True)
    lexicon = np.zeros(1 << LEXICON_BITS, np.uint64)
    often = np.argsort(times, kind="stable")
    often = often[times[often] >= 3]
    lexicon[(seen[often] >> np.uint64(64 - LEXICON_BITS)).astype(np.int64)] = seen[often]
    grams, begin, per_word = _features(data, starts, ends, lexicon)
    size, k = (1 << BITS) + (1 << LEXICON_BITS) + 1, len(langs)
    weights, moves = np.zeros((size, k), np.float32), np.zeros((k, k))
    gw, gm = np.full((size, k), 1e-2, np.float32), np.full((k, k), 1e-2)
    length = ends - starts
    bounds = [0]
    for _, window in windows:
        bounds.append(bounds[-1] + len([w for w in window.split(" ") if w]))
    bounds = np.array(bounds)
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for i in range(0, len(order), 128):
            part = order[i:i + 128]
            pieces = []
            for j, a in enumerate(part):
                s = np.arange(bounds[a], bounds[a + 1])
                if rng.random() < 0.25 and len(s) > 1:     # a switch: the rest of the window comes from another one
                    b = part[(j + 1 + rng.integers(len(part))) % len(part)]
                    cut = rng.integers(1, len(s))
                    s = np.concatenate([s[:cut], np.arange(bounds[b], bounds[b + 1])[cut:]])
                pieces.append(s)
            ids, rows = np.concatenate(pieces), np.repeat(np.arange(len(pieces)), [len(p) for p in pieces])
            y = y_all[ids]
            own = np.repeat(np.arange(len(ids)), length[ids])
            at = np.concatenate([np.arange(begin[x], begin[x] + length[x]) for x in ids])
            flat = np.concatenate([grams[at].T.ravel(), per_word[ids].T.ravel()])
            owner = np.concatenate([own, own, np.tile(np.arange(len(ids)), per_word.shape[1])])
            scores = np.stack([np.bincount(owner, weights[flat, c], len(ids)) for c in range(k)], 1)
            p, pair = _expected(scores, rows, moves)
            p[np.arange(len(ids)), y] -= 1
            used, back = np.unique(flat, return_inverse=True)
            grad = np.stack([np.bincount(back, p[owner, c], len(used)) for c in range(k)], 1).astype(np.float32) / len(part) + decay * weights[used]
            gw[used] += grad * grad
            weights[used] -= rate * grad / np.sqrt(gw[used])
            joined = rows[1:] == rows[:-1]
            np.subtract.at(pair, (y[:-1][joined], y[1:][joined]), 1)
            pair = pair / len(part) + decay * moves
            gm += pair * pair
            moves -= rate * pair / np.sqrt(gm)
    return Crf(langs, weights, moves, lexicon)


def _expected(scores: np.ndarray, rows: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label probabilities of each word, and expected counts of transitions, of the rows together."""
    k = scores.shape[1]
    count = np.bincount(rows)
    start = np.cumsum(count) - count
    e, m = np.exp(scores - scores.max(1, keepdims=True)), np.exp(moves - moves.max())
    f, g = np.empty_like(e), np.ones_like(e)
    f[start] = e[start] / e[start].sum(1, keepdims=True)
    for t in range(1, int(count.max())):
        i = start[count > t] + t
        f[i] = f[i - 1] @ m * e[i]
        f[i] /= f[i].sum(1, keepdims=True)
    for t in range(int(count.max()) - 2, -1, -1):
        i = start[count > t + 1] + t
        g[i] = (e[i + 1] * g[i + 1]) @ m.T
        g[i] /= g[i].sum(1, keepdims=True)
    p = f * g
    p /= p.sum(1, keepdims=True)
    i = np.flatnonzero(rows[1:] == rows[:-1])
    pair = f[i][:, :, None] * m * (e[i + 1] * g[i + 1])[:, None, :]
    pair /= pair.sum((1, 2), keepdims=True)
    return p, pair.sum(0) if len(i) else np.zeros((k, k))


def identify(documents: DataFrame, model: Crf | None, keep: bool = False) -> DataFrame:
    """(doc_id, lang_pred, score) for every row of ``documents(doc_id, text)``: the language whose mean word
    probability is highest (ties: the smaller name), and that mean.  A null text, or one without a letter, or any
    text without a model, gives ``und`` and 0.  Other columns are ignored; rows are kept as they come.  With ``keep``
    the result has all columns of ``documents`` and lang_pred and lang_score, which replace columns of that name."""
    text = F.col("text").cast("string")
    readable = F.when(text.rlike("\\p{L}"), F.lower(text))
    if keep:
        found = F.struct(F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score")) if model is None else _predicted(documents, model)(readable)
        out = documents.drop("lang_pred", "lang_score").withColumn("_found", found)
        return out.withColumns({"lang_pred": F.col("_found.lang_pred"), "lang_score": F.col("_found.score")}).drop("_found")
    source = plain(documents, "doc_id", "text").select(F.col("doc_id").cast("long"), readable.alias("text"))
    if model is None:
        return source.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    return source.select("doc_id", _predicted(documents, model)(F.col("text")).alias("f")).select("doc_id", "f.lang_pred", "f.score")


def _predicted(documents: DataFrame, model: Crf):
    """A function of the lower-cased text column that gives struct(lang_pred, score), batch by batch."""
    shared = documents.sparkSession.sparkContext.broadcast(model)    # a fixed number of features times the languages

    @F.arrow_udf("lang_pred string, score double")
    def predict(texts: pa.Array) -> pa.Array:
        tb.begin("language_id")
        crf = shared.value
        names = np.array([*crf.langs, "und"], dtype=object)
        langs, scores = [], []
        for _, raw, offsets in tb.text_slices(texts, 1 << 19):
            n = len(offsets) - 1
            sums, count = crf.documents(raw, offsets)
            best, some = sums.argmax(1), count > 0
            langs.append(names[np.where(some, best, -1)])
            scores.append(np.where(some, np.minimum(1.0, sums[np.arange(n), best] / np.maximum(count, 1)), 0.0))
        flat = (np.concatenate(x) if x else np.array([], object) for x in (langs, scores))
        return pa.StructArray.from_arrays([pa.array(next(flat), pa.string()), pa.array(next(flat), pa.float64())], ["lang_pred", "score"])

    return predict.asNondeterministic()      # else a filter on the result would run it a second time


def words(documents: DataFrame, model: Crf) -> DataFrame:
    """(doc_id, words: array of (word, lang, probability)): every word's label, for code-switched text."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        crf = shared.value
        kind = pa.list_(pa.struct([("word", pa.string()), ("lang", pa.string()), ("probability", pa.float64())]))
        for batch in batches:
            for at, raw, offsets in tb.text_slices(batch.column(1), 1 << 19):
                out = [[] for _ in range(len(offsets) - 1)]
                starts, ends, rows = _runs(raw, offsets)
                if len(starts):
                    shares = marginals(crf.scores(raw, starts, ends), rows, crf.moves)
                    best = shares.argmax(1)
                    for i, r in enumerate(rows):
                        out[r].append({"word": raw[starts[i]:ends[i]].tobytes().decode(errors="replace"), "lang": crf.langs[best[i]], "probability": float(shares[i, best[i]])})
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(out)), pa.array(out, kind)], ["doc_id", "words"])

    source = plain(documents, "doc_id", "text").select(F.col("doc_id").cast("long"), F.lower("text").alias("text"))
    return source.mapInArrow(run, "doc_id long, words array<struct<word string, lang string, probability double>>")
