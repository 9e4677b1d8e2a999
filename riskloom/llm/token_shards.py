"""Token-id shards with a minimal perfect hash index.

A folder holds one binary file for each range of doc_id, in ascending order, all numbers little-endian:

    magic 8 bytes, then int64: shard, documents, ids, id width in bytes, smallest and largest doc_id, bytes of the index
    ids of all documents, end id included, at the id width
    keys: doc_id (int64) and occurrence (int64; bit 62 marks a null doc_id) of every document, in file order
    index: levels of a minimal perfect hash of the keys, then for every place a fingerprint, first id and number of ids
    one byte 0x0A (the end of the only record of Spark's writer)

A key's place is found by trying the levels' bit maps, about 1.6 on average, and counting bits before it; the stored
fingerprint rejects keys that are not there (a strange key passes with a chance of 2^-32).  So a document's ids are
reached in constant time, without its neighbours.  Spark's own writer commits the files: a retried task leaves no part.
"""
from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textbytes as tb
from .piece_memo import classes, load
from .store import Scratch, plain

MAGIC, HEADER = b"TOKSHRD1", "<8s7q"
HEAD_BYTES = struct.calcsize(HEADER)
SHARD_BYTES = 12 << 20         # UTF-8 bytes of text aimed at in a shard
NULL_KEY = 1 << 62             # in the occurrence of documents without doc_id
ENTRY = np.dtype([("fingerprint", "<u4"), ("count", "<u4"), ("start", "<u8")])


class PerfectHash:
    """Places 0 .. n-1 for n distinct 64-bit keys: on each level the keys alone at their bit stay, the others go on."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.before = [np.concatenate([[0], np.cumsum(x)]) for x in levels]
        self.base = np.cumsum([0] + [int(b[-1]) for b in self.before])

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, left = [], keys
        while len(left):
            size = 2 * len(left)
            at = cls._bit(left, len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            left = left[~alone[at]]
        return cls(levels)

    @staticmethod
    def _bit(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (tb.mix(keys, 200 + level) % np.uint64(size)).astype(np.int64)

    def places(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 where no level has its bit."""
        out, todo = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, bits in enumerate(self.levels):
            if not len(todo):
                break
            at = self._bit(keys[todo], level, len(bits))
            hit = bits[at]
            out[todo[hit]] = self.base[level] + self.before[level][at[hit]]
            todo = todo[~hit]
        return out

    def to_bytes(self) -> bytes:
        sizes = np.array([len(self.levels), *map(len, self.levels)], "<i8")
        return sizes.tobytes() + b"".join(np.packbits(x).tobytes() for x in self.levels)

    @classmethod
    def from_bytes(cls, data: bytes) -> tuple[PerfectHash, int]:
        """(index, bytes read)."""
        count = int(np.frombuffer(data, "<i8", 1)[0])
        sizes, at, levels = np.frombuffer(data, "<i8", count, 8), 8 * (count + 1), []
        for size in sizes:
            n = -(-int(size) // 8)
            levels.append(np.unpackbits(np.frombuffer(data, np.uint8, n, at))[:size].astype(bool))
            at += n
        return cls(levels), at


def _hashes(ids: np.ndarray, turns: np.ndarray) -> np.ndarray:
    return tb.mix(ids.astype(np.int64).view(np.uint64) ^ tb.mix(turns.astype(np.uint64), 210) * (turns != 0), 211)


def _fingerprints(hashes: np.ndarray) -> np.ndarray:
    return (tb.mix(hashes, 212) >> np.uint64(32)).astype("<u4")


def pack(shard: int, ids: np.ndarray, turns: np.ndarray, counts: np.ndarray, payload: np.ndarray) -> bytes:
    """The bytes of a shard, without the last one."""
    keys = _hashes(ids, turns)
    index = PerfectHash.build(keys)
    entries = np.zeros(len(keys), ENTRY)
    place = index.places(keys)
    entries["fingerprint"][place], entries["count"][place], entries["start"][place] = _fingerprints(keys), counts, np.cumsum(counts) - counts
    table = index.to_bytes() + entries.tobytes()
    real = ids[turns < NULL_KEY]
    low, high = (int(real.min()), int(real.max())) if len(real) else (0, -1)
    head = struct.pack(HEADER, MAGIC, shard, len(ids), len(payload), payload.dtype.itemsize, low, high, len(table))
    return head + payload.tobytes() + ids.astype("<i8").tobytes() + turns.astype("<i8").tobytes() + table


class Shard:
    """A shard's bytes, read by key."""

    def __init__(self, data: bytes):
        magic, self.number, self.documents, self.n_ids, width, self.low, self.high, index = struct.unpack_from(HEADER, data)
        if magic != MAGIC or len(data) != HEAD_BYTES + self.n_ids * width + 16 * self.documents + index + 1:
            raise ValueError("not a whole token shard")
        self.payload = np.frombuffer(data, f"<u{width}", self.n_ids, HEAD_BYTES)
        at = HEAD_BYTES + self.n_ids * width
        self.ids = np.frombuffer(data, "<i8", self.documents, at)
        self.turns = np.frombuffer(data, "<i8", self.documents, at + 8 * self.documents)
        at += 16 * self.documents
        self.index, read = PerfectHash.from_bytes(data[at:])
        self.entries = np.frombuffer(data, ENTRY, self.documents, at + read)

    def find(self, ids: np.ndarray, turns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(found, first id, number of ids) of each key."""
        keys = _hashes(np.asarray(ids, np.int64), np.asarray(turns, np.int64))
        place = self.index.places(keys)
        found = place >= 0
        found[found] = self.entries["fingerprint"][place[found]] == _fingerprints(keys[found])
        place = np.where(found, place, 0)
        if not self.documents:
            return found, np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        return found, self.entries["start"][place].astype(np.int64), self.entries["count"][place].astype(np.int64)


def _turns(ids: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """0, 1, ... for the documents of one doc_id, which stand together."""
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (valid[1:] != valid[:-1])
    start = np.flatnonzero(new)
    at = np.arange(len(ids))
    return at - np.repeat(start, np.diff(np.append(start, len(ids)))) + np.where(valid, 0, NULL_KEY)


def write_shards(documents: DataFrame, folder: str, tokenizer_path: str, end_id: int = 2, shard_bytes: int = SHARD_BYTES, special: bool = False) -> None:
    """Encode ``documents(doc_id, text)`` and write the shards to ``folder`` (any path that Spark can write).

    A null text counts as empty: its only id is the end id.  Documents of one doc_id are kept, in the order of their
    texts; those without doc_id come first.  Other columns are ignored; an empty table leaves no shard.
    With ``special`` the strings of special tokens in a text become those tokens; without, they are ordinary text.
    """
    spark = documents.sparkSession
    rows = plain(documents, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parted = rows.repartitionByRange(max(1, -(-size // shard_bytes)), "doc_id").sortWithinPartitions("doc_id", "text")
    from tokenizers import Tokenizer

    kinds = spark.sparkContext.broadcast(classes(Tokenizer.from_file(tokenizer_path)))     # one byte a code point: 1.1 MB

    def encode(batches):
        tb.begin("token_shards")
        memo = load(tokenizer_path, kinds.value, special)
        width = np.dtype("<u2" if max(memo.size, end_id + 1) <= 1 << 16 else "<u4")
        ids, valid, counts, payload = [], [], [], []
        for batch in batches:
            keys = batch.column(0)
            ids.append(keys.fill_null(0).to_numpy(zero_copy_only=False))
            valid.append(keys.is_valid().to_numpy(zero_copy_only=False))
            for _, raw, offsets in tb.text_slices(batch.column(1)):
                found, n = memo.encode(raw, offsets)
                ends = np.cumsum(n)
                payload.append(np.insert(found, ends, end_id).astype(width))
                counts.append(n + 1)
        if ids and sum(map(len, ids)):
            key, ok = np.concatenate(ids), np.concatenate(valid)
            data = pack(TaskContext.get().partitionId(), key, _turns(key, ok), np.concatenate(counts), np.concatenate(payload))
            yield pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], ["shard"])

    parted.mapInArrow(encode, "shard binary").select(F.col("shard").cast("string")).write.mode("error").text(folder)


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).where("length > 0").select("content")


def shard_table(spark: SparkSession, folder: str) -> DataFrame:
    """(shard, documents, ids, low, high, base) of every shard, from the files' heads; base: ids of all shards before.
    One short row a shard, that is for some ten MB of text, is summed in order."""
    def heads(batches):
        for batch in batches:
            rows = [struct.unpack(HEADER, x) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in (1, 2, 3, 5, 6)], ["shard", "documents", "ids", "low", "high"])

    found = _files(spark, folder).select(F.substring("content", 1, HEAD_BYTES)).mapInArrow(heads, "shard long, documents long, ids long, low long, high long")
    return found.withColumn("base", F.sum("ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))).fillna(0, ["base"])


def _shards(batch: pa.RecordBatch, name: str) -> Iterator[Shard]:
    for cell in batch.column(name):
        yield Shard(cell.as_py())


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, each reached by its key through its shard's index."""
    def run(batches):
        for batch in batches:
            for shard in _shards(batch, "content"):
                found, start, count = shard.find(shard.ids, shard.turns)
                if not found.all():
                    raise ValueError("a key of the shard is not in its index")
                crc = [zlib.crc32(shard.payload[a:a + n].astype("<u4").tobytes()) for a, n in zip(start.tolist(), count.tolist(), strict=True)]
                ids = pa.array(shard.ids, mask=shard.turns >= NULL_KEY)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(start), shard.number)), ids, pa.array(start), pa.array(count), pa.array(crc, pa.int64())], ["shard", "doc_id", "start", "n_tokens", "ids_crc32"])

    rows = _files(spark, folder).mapInArrow(run, "shard long, doc_id long, start long, n_tokens long, ids_crc32 long")
    return rows.join(shard_table(spark, folder).select("shard", "base"), "shard").select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")


def fetch(spark: SparkSession, folder: str, keys: DataFrame) -> DataFrame:
    """(doc_id, occurrence, ids) of the documents with the doc_ids in ``keys(doc_id)``; unknown ids give no row.

    A key goes to the shard whose range holds it, and is looked up there.  Keys of a shard are handed to it as one list,
    no longer than its range of ids."""
    asked = plain(keys, "doc_id").select(F.col("doc_id").cast("long").alias("id")).where("id IS NOT NULL").distinct()
    ranges = shard_table(spark, folder).where("low <= high").select("shard", "low", "high")
    lists = asked.join(ranges, (F.col("id") >= F.col("low")) & (F.col("id") <= F.col("high"))).groupBy("shard").agg(F.sort_array(F.collect_list("id")).alias("asked"))
    number = F.conv(F.hex(F.reverse(F.substring("content", 9, 8))), 16, 10).cast("long")

    def run(batches):
        for batch in batches:
            for shard, ids in zip(_shards(batch, "content"), batch.column("asked").to_pylist(), strict=True):
                todo, turn = np.array(ids, np.int64), 0
                while len(todo):                       # an id may stand for several documents
                    found, start, count = shard.find(todo, np.full(len(todo), turn))
                    todo, start, count = todo[found], start[found], count[found]
                    if len(todo):
                        values = [shard.payload[a:a + n].astype(np.int64) for a, n in zip(start, count, strict=True)]
                        yield pa.RecordBatch.from_arrays([pa.array(todo), pa.array(np.full(len(todo), turn)), pa.array(values, pa.list_(pa.int64()))], ["doc_id", "occurrence", "ids"])
                    turn += 1

    files = _files(spark, folder).withColumn("shard", number)
    return files.join(lists, "shard").select("content", "asked").mapInArrow(run, "doc_id long, occurrence long, ids array<long>")


def written_digests(documents: DataFrame, tokenizer_path: str, end_id: int = 2, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write the shards of ``documents`` to a folder of this run, read them back, and give their digests.  The ids are
    those of the library's ``encode(text, add_special_tokens=False)``."""
    folder = Scratch(documents.sparkSession, "tokens").path("shards")
    write_shards(documents, folder, tokenizer_path, end_id, shard_bytes, special=True)
    return digests(documents.sparkSession, folder)
