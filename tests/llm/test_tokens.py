import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from riskloom.llm import byte_bpe, piece_memo, textbytes, token_shards
from riskloom.llm.store import Scratch, ship

from . import edge

RANKS, FILE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
BPE = byte_bpe.load(RANKS, public_tokenizers.PATTERN)
REFERENCE = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=BPE.ranks, special_tokens={})
LIBRARY = Tokenizer.from_file(FILE)
LIBRARY.encode_special_tokens = True
MEMO = piece_memo.PieceMemo(FILE, piece_memo.classes(LIBRARY))
TEXTS = st.text(st.sampled_from("aabeé's'tre ve'll  \n\t\r\x85\xa0 ñ日本🎉123-_!?Ⅷ½ª​́"), max_size=60) | st.text(max_size=40)


@settings(max_examples=400, deadline=None)
@given(TEXTS)
def test_backtracking_equals_merging(text):
    n, ids, data = BPE.text(text)
    want = REFERENCE.encode_ordinary(text)
    assert (ids, n, data) == (",".join(map(str, want)), len(want), text.encode())


def test_long_runs_take_linear_time():
    for text in ("a" * 30_000, " " * 20_000 + "ab" * 20_000, "é" * 9_999):
        assert BPE.text(text)[1] == ",".join(map(str, REFERENCE.encode_ordinary(text)))


def test_a_vocabulary_that_needs_steps_back():
    ranks = {bytes([b]): i for i, b in enumerate(b"abcd")} | {b"ab": 4, b"cd": 5, b"bc": 6, b"abc": 7, b"bcd": 8, b"abab": 9}
    bpe = byte_bpe.ByteBpe(ranks, ".+")
    reference = tiktoken.Encoding("small", pat_str=".+", mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    for _ in range(2000):
        text = "".join(rng.choice("abcd") for _ in range(rng.randrange(1, 12)))
        assert bpe.encode_piece(text.encode()) == reference.encode_ordinary(text), text


def test_encode_and_decode(spark):
    ship(spark)
    docs = edge.frame(spark)
    out = byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN, with_ids=True)
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out.collect()}
    want = set()
    for row in edge.rows():
        ids = REFERENCE.encode_ordinary(row[1] or "")
        want.add((row[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((row[1] or "").encode()).hexdigest()))
    assert got == want and out.count() == len(edge.rows())
    back = byte_bpe.decode(out, RANKS, public_tokenizers.PATTERN)
    assert sorted((str(r.doc_id), r.text) for r in back.collect()) == sorted((str(r[0]), r[1] or "") for r in edge.rows())
    assert byte_bpe.encode(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def memo_ids(texts):
    out = []
    for _, raw, offsets in textbytes.text_slices(pa.array(texts, pa.string()), 1000):
        ids, n = MEMO.encode(raw, offsets)
        ends = np.cumsum(n)
        out += [ids[b - k:b].tolist() for b, k in zip(ends, n, strict=True)]
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXTS, max_size=6))
def test_piece_memory_equals_the_library(texts):
    assert memo_ids(texts) == [e.ids for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]


@given(st.lists(st.integers(-2**63, 2**63 - 1), unique=True, max_size=300))
def test_perfect_hash(keys):
    keys = np.array(keys, np.int64).view(np.uint64)
    index, read = token_shards.PerfectHash.from_bytes(token_shards.PerfectHash.build(keys).to_bytes())
    assert sorted(index.places(keys).tolist()) == list(range(len(keys)))


def shard_rows():
    rows = sorted(((r[0], r[1] or "") for r in edge.rows()), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    ids = [np.array([*e.ids, 2], "<u4") for e in LIBRARY.encode_batch([t for _, t in rows], add_special_tokens=False)]
    starts = np.cumsum([0, *map(len, ids)])
    return [(d, int(s), len(x), zlib.crc32(x.tobytes()), x.tolist()) for (d, _), s, x in zip(rows, starts, ids)]


@pytest.mark.parametrize("size", [1 << 30, 2_000])
def test_shards_read_back(spark, size):
    ship(spark)
    docs = edge.frame(spark)
    folder = Scratch(spark, "t").path("shards")
    token_shards.write_shards(docs, folder, FILE, shard_bytes=size)
    want = shard_rows()
    got = sorted(map(tuple, token_shards.digests(spark, folder).collect()), key=lambda r: r[1])
    assert got == [w[:4] for w in want]
    asked = spark.createDataFrame([(1,), (3,), (3,), (13,), (99,), (-5,), (None,)], "doc_id long")
    found = sorted((r.doc_id, r.occurrence, r.ids) for r in token_shards.fetch(spark, folder, asked).collect())
    turn, expected = {}, []
    for d, _, _, _, ids in want:
        if d in (1, 3, 13):
            expected.append((d, turn.get(d, 0), ids))
            turn[d] = turn.get(d, 0) + 1
    assert found == expected


def test_empty_table_of_shards(spark):
    ship(spark)
    assert token_shards.written_digests(edge.frame(spark).limit(0), FILE).count() == 0


def test_special_tokens_in_texts_equal_the_unaltered_library(spark):
    ship(spark)
    library, memo = Tokenizer.from_file(FILE), piece_memo.PieceMemo(FILE, piece_memo.classes(LIBRARY), special=True)
    texts = ["a <|endoftext|> b", "", "plain don't", "<|endoftext|>", "<|endof", "text|> x", "é<|endoftext|><|endoftext|>\n\n日本", "<|endoftext|", ">"]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert want[0] == [64, 220, 50256, 275]
    (_, raw, offsets), = textbytes.text_slices(pa.array(texts, pa.string()))
    ids, n = memo.encode(raw, offsets)
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == want
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    crc = [zlib.crc32(np.array([*x, 2], "<u4").tobytes()) for x in want]
    starts = np.cumsum([0, *(len(x) + 1 for x in want)]).tolist()
    got = sorted(map(tuple, token_shards.written_digests(docs, FILE).collect()))
    assert got == [(i, starts[i], len(x) + 1, crc[i]) for i, x in enumerate(want)]


def test_a_cut_shard_is_refused():
    data = token_shards.pack(3, np.array([5, 6]), np.array([0, 0]), np.array([1, 2]), np.array([2, 7, 2], "<u2")) + b"\n"
    shard = token_shards.Shard(data)
    assert shard.find(np.array([6, 7]), np.array([0, 0]))[0].tolist() == [True, False]
    with pytest.raises(ValueError):
        token_shards.Shard(data[:-2])
