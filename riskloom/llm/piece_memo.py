"""Whole-text encoding by a tokenizers file, with a memory of pieces.

A byte-level BPE tokenizer encodes each match of its split pattern on its own.  The matches are found for many texts
at once from the classes of their code points, and looked up by a 64-bit hash in a table of fixed size; those it does
not hold go through the tokenizers library in one call.  Texts that hold the content of an added token go through the
library whole.  The result is that of encoding each text by the library.
"""
from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np
import regex
from tokenizers import Tokenizer

from . import textbytes as tb

SLOTS_BITS, POOL = 21, 8_000_000     # pieces and ids that a worker remembers
OTHER, LETTER, NUMBER, SPACE = range(4)
#: Fixed value: the endings that the split pattern keeps with an apostrophe.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


def classes(tokenizer) -> np.ndarray:
    """The class of every code point, as the tokenizer's own splitting sees it.

    The large uniform blocks (CJK, Hangul, private use) are taken from the ``regex`` module; all else is tried out,
    since libraries know different versions of Unicode."""
    out = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, (c for c in range(0x110000) if not 0xD800 <= c < 0xE000)))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            out[[ord(c) for c in m.group()]] = kind
    blocks = ((0x80, 0x4E00), (0x9F00, 0xAC00), (0xD700, 0xD800), (0xF900, 0x20000), (0x2A600, 0x2FA20), (0x30000, 0x34000))
    tried = np.concatenate([np.arange(a, b) for a, b in blocks])
    for kind, partner in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")):
        probe = "".join(f"{partner}{chr(c)}\n" for c in tried)
        whole = {a for _, (a, b) in tokenizer.pre_tokenizer.pre_tokenize_str(probe) if b - a == 2 and a % 3 == 0}
        joins = np.zeros(len(tried), bool)
        joins[[a // 3 for a in whole]] = True
        out[tried[joins]] = kind
        out[tried[~joins & (out[tried] == kind)]] = SPACE        # corrected by a later partner, if one joins
    return out


@lru_cache(maxsize=1)
def _values() -> np.ndarray:
    return tb.mix(np.arange(0x110000, dtype=np.uint64), 90) | np.uint64(1)


def piece_starts(points: np.ndarray, offsets: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Where the matches of the byte-level split pattern begin, in texts laid end to end."""
    n = len(points)
    kind = classes[points]
    opens = np.ones(n, bool)
    opens[1:] = kind[1:] != kind[:-1]
    edge = offsets[:-1][offsets[:-1] < offsets[1:]]
    opens[edge] = True
    first = np.zeros(n + 1, bool)
    first[edge] = True
    first[n] = True
    after_space = np.zeros(n, bool)                    # the character before, of the same text, is white space
    after_space[1:] = (kind[:-1] == SPACE) & ~first[1:n]
    begins = opens.copy()
    words = opens & (kind != SPACE)
    joined = np.flatnonzero(words & after_space)       # runs whose white space, if it ends in a blank, goes with them
    begins[joined - 1] = True
    joined = joined[points[joined - 1] == 32]
    begins[joined] = False
    words[joined] = False
    quote = np.flatnonzero(words & (points == 39))
    quote = quote[quote + 1 < n]
    quote = quote[(kind[quote + 1] == LETTER) & ~first[quote + 1]]
    for ending in ENDINGS:
        at = quote[quote + len(ending) < n]
        fits = np.ones(len(at), bool)
        for k, c in enumerate(ending, 1):
            fits &= (points[at + k] == ord(c)) & ~first[at + k]
        at = at[fits]
        begins[at + 1] = False
        more = at[at + len(ending) + 1 < n] + len(ending) + 1
        begins[more[(kind[more] == LETTER) & ~first[more]]] = True
    return np.flatnonzero(begins)


class PieceMemo:
    """Encoder of many texts at once by the tokenizer file at ``path``.

    With ``special`` the strings of special tokens in a text become those tokens, as the library does by default;
    without, they are ordinary text."""

    def __init__(self, path: str, classes: np.ndarray, special: bool = False):
        self.tokenizer, self.classes = Tokenizer.from_file(path), classes
        self.tokenizer.encode_special_tokens = not special
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = spec["pre_tokenizer"]
        if spec["normalizer"] or spec["post_processor"] and spec["post_processor"]["type"] != "ByteLevel" or split["type"] != "ByteLevel" or split["add_prefix_space"] or not split.get("use_regex", True):
            raise ValueError("not a plain byte-level tokenizer file")
        self.added = [t["content"].encode() for t in spec["added_tokens"] if special or not t["special"]]
        self.size = self.tokenizer.get_vocab_size()
        self._clear()

    def _clear(self) -> None:
        self.keys, self.begin, self.count = np.zeros(1 << SLOTS_BITS, np.uint64), np.zeros(1 << SLOTS_BITS, np.int64), np.zeros(1 << SLOTS_BITS, np.int64)
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0

    def _store(self, ids: np.ndarray) -> int:
        at = self.used
        if at + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(ids), len(self.pool)), np.uint32)])
        self.pool[at:at + len(ids)] = ids
        self.used += len(ids)
        return at

    def _holding(self, data: bytes, offsets: np.ndarray) -> np.ndarray:
        """Whether each text holds the content of an added token (or one goes on into the next text)."""
        out = np.zeros(len(offsets) - 1, bool)
        for content in self.added:
            at = data.find(content)
            while at >= 0:
                out[np.searchsorted(offsets, at, "right") - 1] = True
                at = data.find(content, at + 1)
        return out

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts laid end to end, number of ids of each text) from UTF-8 bytes and byte offsets."""
        data = raw.tobytes()
        whole = self._holding(data, offsets)
        if not whole.any():
            return self._pieces(raw, offsets)
        sizes = np.diff(offsets)
        ids, counts = self._pieces(raw[np.repeat(~whole, sizes)], np.concatenate([[0], np.cumsum(sizes * ~whole)]))
        found = self.tokenizer.encode_batch_fast([data[offsets[i]:offsets[i + 1]].decode() for i in np.flatnonzero(whole)], add_special_tokens=False)
        counts[whole] = [len(e) for e in found]
        out, own = np.zeros(int(counts.sum()), np.uint32), np.repeat(whole, counts)
        out[~own] = ids
        out[own] = np.concatenate([np.array(e.ids, np.uint32) for e in found])
        return out, counts

    def _pieces(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``encode`` for texts without added tokens."""
        n = len(offsets) - 1
        if not len(raw):
            return np.zeros(0, np.uint32), np.zeros(n, np.int64)
        if self.used > POOL:
            self._clear()
        text = raw.tobytes().decode()
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        heads = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        ends = heads[offsets]
        starts = piece_starts(points, ends, self.classes)
        stops = np.append(starts[1:], len(points))
        lengths = stops - starts
        place = np.arange(len(points), dtype=np.int32) - np.repeat(starts.astype(np.int32), lengths)
        hashes = tb.mix(np.add.reduceat(_values()[points] * tb.places(int(lengths.max()))[place], starts) + lengths.astype(np.uint64), 91)
        slot = (hashes >> np.uint64(64 - SLOTS_BITS)).astype(np.int64)
        known = self.keys[slot] == hashes
        begin, count = self.begin[slot], self.count[slot]
        lost = np.flatnonzero(~known)
        if len(lost):
            new, where, back = np.unique(hashes[lost], return_index=True, return_inverse=True)
            found = self.tokenizer.encode_batch_fast([text[starts[i]:stops[i]] for i in lost[where]], add_special_tokens=False)
            sizes = np.array([len(e) for e in found], np.int64)
            at = self._store(np.fromiter((i for e in found for i in e.ids), np.uint32, int(sizes.sum()))) + np.cumsum(sizes) - sizes
            begin[lost], count[lost] = at[back], sizes[back]
            spot = slot[lost[where]]
            self.keys[spot], self.begin[spot], self.count[spot] = new, at, sizes
            kept = self.keys[spot] == new               # of two new pieces for a slot one stays
            self.begin[spot[kept]], self.count[spot[kept]] = at[kept], sizes[kept]
        total = np.cumsum(count)
        index = np.arange(int(total[-1])) + np.repeat(begin - (total - count), count)
        row = np.searchsorted(ends, starts, "right") - 1
        per_text = np.bincount(row, count, n).astype(np.int64)
        return self.pool[index], per_text


_LOADED: dict[tuple[str, bool], PieceMemo] = {}


def load(path: str, classes: np.ndarray, special: bool = False) -> PieceMemo:
    """One for each worker process; it runs on one thread, Spark runs the tasks."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if (path, special) not in _LOADED:
        _LOADED[path, special] = PieceMemo(path, classes, special)
    return _LOADED[path, special]
