"""Byte-level BPE by backtracking: exact merge results in time linear in the text.

A piece (one match of the split pattern) is mapped byte for byte to Latin-1, so that an Aho-Corasick automaton over
the vocabulary finds the longest token at a place.  The encoder takes longest matches and accepts a token only if it
is compatible with the one before it, that is, if the merges of both tokens' bytes give just these two.  On a conflict
it takes the next shorter token; if there is none it steps back.  A place that was left once is never entered again.
Compatibility of a token pair is computed once and remembered; so are the pieces met last.
"""
from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .store import plain

REMEMBERED_PIECES = 400_000      # bound of a worker's memory of pieces; then it starts anew
REMEMBERED_PAIRS = 300_000       # token pairs whose compatibility is remembered
LONG_PIECE = 64                  # longer pieces are not remembered


class ByteBpe:
    """Encoder and decoder of one rank file (a line for each token: base64 bytes, rank)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.split = regex.compile(pattern).findall
        self.ranks, self.bytes_of = ranks, {i: b for b, i in ranks.items()}
        self.fits: dict[tuple[int, int], bool] = {}
        self.pieces = Pieces(self.piece, REMEMBERED_PIECES)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        self.widest = max(map(len, ranks))
        self.shorter: dict[int, int | None] = {}
        self.halves: dict[int, tuple[int, int]] = {}             # what the last merge of a token joined
        for token, rank in ranks.items():
            parts = self.merge(token, 2)
            if len(parts) == 2:
                self.halves[rank] = ranks[parts[0]], ranks[parts[1]]
            if len(parts) <= 2:                                  # a token that no merge makes is never an answer
                self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()

    def merge(self, data: bytes, least: int = 1) -> list[bytes]:
        """The definition: merge the pair of lowest rank, leftmost first, until no pair is a token or ``least`` parts
        are left.  Only run over the vocabulary itself."""
        parts = [data[i:i + 1] for i in range(len(data))]
        while len(parts) > least:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: int, right: int) -> bool:
        """Whether the merges of both tokens' bytes end in these two: undo their merges from the last to the first, and
        see whether the parts that then meet would have been merged before the merge undone."""
        got = self.fits.get((left, right))
        if got is None:
            if len(self.fits) > REMEMBERED_PAIRS:
                self.fits.clear()
            got = self.fits[left, right] = self._meet(left, right)
        return got

    def _meet(self, left: int, right: int) -> bool:
        before = 1 << 60
        while self.ranks.get(self.bytes_of[left] + self.bytes_of[right], before) >= before:
            l, r = (x if x in self.halves else -1 for x in (left, right))
            if l < 0 and r < 0:
                return True
            if l > r:
                before, left = l, self.halves[l][1]
            else:                       # of two equal ranks the left one is merged first
                before, right = r + 1, self.halves[r][0]
        return False

    def longest(self, text: str, at: int) -> int:
        """The longest token of ``text`` that begins at ``at``."""
        for _, rank in self.automaton.iter_long(text[at:at + self.widest]):
            return rank
        raise ValueError("the vocabulary lacks a byte")

    def next_shorter(self, token: int) -> int | None:
        """The longest token that is a proper prefix of ``token``."""
        if token not in self.shorter:
            text = self.bytes_of[token].decode("latin-1")
            cut = [n for n in range(len(text) - 1, 0, -1) if text[:n] in self.automaton]
            self.shorter[token] = self.automaton.get(text[:cut[0]]) if cut else None
        return self.shorter[token]

    def encode_piece(self, data: bytes) -> list[int]:
        """Longest matches from the left; from the first pair that does not fit on, the next shorter token is tried,
        and without one the token before is taken back.  A place left so is closed."""
        text, size = data.decode("latin-1"), len(data)
        out = [rank for _, rank in self.automaton.iter_long(text)]
        fits = self.fits
        wrong = 1
        while wrong < len(out) and (fits.get((out[wrong - 1], out[wrong])) or self.compatible(out[wrong - 1], out[wrong])):
            wrong += 1
        if wrong >= len(out):
            return out
        token, out = out[wrong], out[:wrong]
        at, closed = sum(len(self.bytes_of[i]) for i in out), bytearray(size + 1)
        while True:
            end = at + len(self.bytes_of[token])
            if not closed[end] and (not out or self.compatible(out[-1], token)):
                out.append(token)
                at = end
                if at == size:
                    return out
                token = self.longest(text, at)
                continue
            shorter = self.next_shorter(token)
            while shorter is None:
                closed[at] = 1
                if not out:
                    raise ValueError("no encoding")
                token = out.pop()
                at -= len(self.bytes_of[token])
                shorter = self.next_shorter(token)
            token = shorter

    def piece(self, text: str) -> tuple[int, str, bytes]:
        """(number of ids, ids joined by commas, bytes decoded from the ids) of one piece."""
        ids = self.encode_piece(text.encode())
        return len(ids), ",".join(map(str, ids)), self.decode(ids)

    def decode(self, ids) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids])

    def text(self, text: str) -> tuple[int, str, bytes]:
        found = list(map(self.pieces.__getitem__, self.split(text)))
        if not found:
            return 0, "", b""
        counts, ids, data = zip(*found)
        return sum(counts), ",".join(ids), b"".join(data)


class Pieces(dict):
    """What a function gives for the pieces met last: two generations, the older one dropped when the newer is full."""

    def __init__(self, make, bound: int):
        super().__init__()
        self.make, self.bound, self.older = make, bound // 2, {}

    def __missing__(self, text: str):
        found = self.older.get(text)
        if found is None:
            found = self.make(text)
        if len(text) <= LONG_PIECE:
            if len(self) >= self.bound:
                self.older = dict(self)
                self.clear()
            self[text] = found
        return found


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(maxsize=2)
def load(path: str, pattern: str) -> ByteBpe:
    """One encoder for each worker process."""
    return ByteBpe(read_ranks(path), pattern)


def encode(documents: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), and with ``with_ids`` also ids, for every row of
    ``documents(doc_id, text)``.

    Special tokens' strings are ordinary text.  A null text counts as empty: no ids, hashes of the empty string.
    Repeated rows are encoded alike, other columns are ignored, an empty table gives an empty result.  ``path`` is a
    rank file that every executor can read.
    """
    def run(batches):
        bpe = load(path, pattern)
        tb.begin("byte_bpe", load.cache_clear)
        for batch in batches:
            texts = batch.column(1)
            for at in range(0, len(texts), 256):
                part = texts.slice(at, 256).to_pylist()
                n, ids, plain_sha, back = [], [], [], []
                for text in part:
                    count, joined, data = bpe.text(text or "")
                    n.append(count)
                    plain_sha.append(hashlib.sha256(joined.encode()).hexdigest())
                    back.append(hashlib.sha256(data).hexdigest())
                    if with_ids:
                        ids.append([int(x) for x in joined.split(",")] if joined else [])
                columns = [batch.column(0).slice(at, 256), pa.array(n, pa.int64()), pa.array(plain_sha), pa.array(back)]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns, names = [*columns, pa.array(ids, pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    source = plain(documents, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return source.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, text) from ``encoded(doc_id, ids)``; a null list is an empty text, bytes that are no UTF-8 are replaced."""
    def run(batches):
        bpe = load(path, pattern)
        for batch in batches:
            texts = [bpe.decode(ids or ()).decode(errors="replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return plain(encoded, "doc_id", "ids").select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")
