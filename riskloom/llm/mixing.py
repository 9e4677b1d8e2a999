"""Mixing sources to target weights.

The words of each source, its documents in a pseudorandom order, are packed into blocks of a fixed number of words,
shorter in a source whose target is less than ``FINE`` blocks, so that whole blocks come near it.
For every output shard the number of blocks of each source is drawn from a multinomial over what the sources still
have to give, so that the shards' sums are the sources' quotas.  The slots of a source run through pseudorandom
permutations of its block indices, one permutation an epoch, and blocks are joined to slots by index.  A source's
quota is at most three epochs, so no block, and no document, is taken more than three times.

Sources stay in a table: they are numbered by ranges, their targets take a few sums over them, and counts are drawn
for ``RANGE`` sources at a time, each range giving every shard its part.
"""
from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textbytes as tb
from .store import Scratch

# Fixed values of the mix.
WEIGHTS = (5, 2, 1)
MOST = 3                       # times that a source's words may be taken

BLOCK_WORDS, SHARDS, SEED = 128, 32, 11
FINE = 40                      # blocks that a source's target holds at least, down to blocks of one word
RANGE = 4096                   # sources whose counts are drawn together
CHUNK = 1 << 14                # slots that one row of the draw table stands for
WORD = r"[^\x20\x09-\x0D]+"


def targets(sources: DataFrame, most: int = MOST) -> DataFrame:
    """``sources(size, weight, ...)`` with ``target``: shares of the sum of sizes by weight, none above ``most`` times its
    size; the excess goes to the others.  A round is one sum over the table; the share of a weight only grows."""
    def sums(where: Column):
        closed = F.when(where, F.lit(most) * F.col("size")).otherwise(0)
        return sources.agg(F.sum("size") - F.sum(closed), F.sum(F.when(~where, F.col("weight")).otherwise(0))).first()

    full = F.lit(False)
    left, total = sums(full)
    while total:
        again = F.lit(left).cast("long") * F.col("weight") / F.lit(total) > most * F.col("size")      # int times int overflows
        now = sums(again)
        if tuple(now) == (left, total):
            full = again
            break
        left, total = now
    share = F.lit(left or 0).cast("long") * F.col("weight") / F.lit(total or 1)
    return sources.withColumn("target", F.when(full, most * F.col("size")).otherwise(share).cast("double"))


def draw(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """(shard, source) counts: a multinomial for each shard over the quotas left; the columns sum to the quotas."""
    rng, left = np.random.default_rng(seed), quotas.astype(np.int64).copy()
    counts = np.zeros((shards, len(quotas)), np.int64)
    for s in range(shards):
        need = int(left.sum()) // (shards - s)
        while need:
            got = np.minimum(rng.multinomial(need, left / left.sum()), left)
            counts[s] += got
            left -= got
            need -= int(got.sum())
    return counts


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Feistel permutations of range(size), one for each (size, key); walked until inside the range."""
    a = np.ceil(np.sqrt(size.astype(np.float64))).astype(np.uint64)
    a += a * a < size
    out, todo = index.astype(np.uint64).copy(), np.arange(len(index))
    size, key = size.astype(np.uint64), key.astype(np.uint64)
    while len(todo):
        left, right, b, k = out[todo] // a[todo], out[todo] % a[todo], a[todo], key[todo]
        for turn in range(0, 6, 2):
            left = (left + tb.mix(right ^ k, 30 + turn) % b) % b
            right = (right + tb.mix(left ^ k, 31 + turn) % b) % b
        out[todo] = left * b + right
        todo = todo[out[todo] >= size[todo]]
    return out.astype(np.int64)


@dataclass
class Mixture:
    """``sized``: row, doc_id, sid, size, begin (its first word in its source); ``sources``: for each sid its name,
    size, target, words of a block, blocks and quota; ``slots``: shard, position, sid, epoch, block; ``pieces``: row, sid, block,
    first (word in the document) and words."""

    sized: DataFrame
    sources: DataFrame
    slots: DataFrame
    pieces: DataFrame

    def used(self) -> DataFrame:
        """(row, sid, block, first, words, uses): pieces with the number of slots that take them."""
        uses = self.slots.groupBy("sid", "block").agg(F.count("*").alias("uses"))
        return self.pieces.join(uses.hint("merge"), ["sid", "block"])      # Spark takes the slots for as few as their draws


def drawn_counts(sources: DataFrame, shards: int, seed: int) -> DataFrame:
    """(shard, sid, start, n, at, total, blocks): how many slots of a shard a source gets, from which of the source's
    slots and which place of the shard on, and how many slots the shard has."""
    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                sids, quotas, blocks = (np.array([s[c] for s in r["own"]], np.int64) for c in ("sid", "quota", "blocks"))
                start = np.zeros(len(sids), np.int64)
                for shard, own in enumerate(draw(quotas, shards, seed + r["range"])):
                    some = np.flatnonzero(own)
                    columns = [np.full(len(some), shard), np.full(len(some), r["range"]), sids[some], start[some], own[some], (np.cumsum(own) - own)[some], blocks[some]]
                    yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["shard", "range", "sid", "start", "n", "inside", "blocks"])
                    start += own

    ranges = sources.where("quota > 0").groupBy(F.floor(F.col("sid") / RANGE).alias("range")).agg(F.sort_array(F.collect_list(F.struct("sid", "quota", "blocks"))).alias("own"))
    drawn = ranges.mapInArrow(run, "shard long, range long, sid long, start long, n long, inside long, blocks long")
    sums = drawn.groupBy("shard", "range").agg(F.sum("n").alias("own"))                     # few rows a shard
    shard = Window.partitionBy("shard")
    sums = sums.select("shard", "range", (F.sum("own").over(shard.orderBy("range")) - F.col("own")).alias("before"), F.sum("own").over(shard).alias("total"))
    return drawn.join(sums, ["shard", "range"]).select("shard", "sid", "start", "n", (F.col("before") + F.col("inside")).alias("at"), "total", "blocks")


def _slots(drawn: DataFrame, seed: int) -> DataFrame:
    step = F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(CHUNK).cast("long"))
    chunks = drawn.withColumn("skip", F.explode(step)).select("shard", "sid", (F.col("start") + F.col("skip")).alias("start"), F.least(F.lit(CHUNK), F.col("n") - F.col("skip")).alias("n"), (F.col("at") + F.col("skip")).alias("at"), "total", "blocks")
    chunks = chunks.repartition("shard", "sid", "start")

    def expand(batches):
        tb.begin("mixing")
        for batch in batches:
            for r in batch.to_pylist():
                index = np.arange(r["start"], r["start"] + r["n"])
                one = np.full(len(index), 1, np.int64)
                epoch = index // r["blocks"]
                key = tb.mix((one * (seed * 1_000_003 + r["sid"])).astype(np.uint64) ^ tb.mix(epoch.astype(np.uint64), 40), 41)
                block = permuted(index % r["blocks"], one * r["blocks"], key)
                place = permuted(np.arange(r["at"], r["at"] + r["n"]), one * r["total"], tb.mix((one * (seed * 1_000_003 + r["shard"])).astype(np.uint64), 42))
                yield pa.RecordBatch.from_arrays([pa.array((one * r["shard"]).astype(np.int32)), pa.array(place), pa.array(one * r["sid"]), pa.array(epoch.astype(np.int32)), pa.array(block)], ["shard", "position", "sid", "epoch", "block"])

    return chunks.mapInArrow(expand, "shard int, position long, sid long, epoch int, block long")


def mix(documents: DataFrame, block_words: int = BLOCK_WORDS, shards: int = SHARDS, seed: int = SEED, whole: bool = False) -> tuple[Mixture, DataFrame]:
    """The mixture of ``documents(doc_id, text, source)``, and the rows with their number ``row``: with ``whole`` all
    columns, under ``doc``.

    Sources are ordered by code point, null last, and weigh 5, 2, 1, repeating.  A null or blank text has no words and
    is never taken; repeated rows are documents of their own; an empty table gives an empty mixture.  Other columns
    do not matter.  A source's taken words come within a twentieth of its target, or within one word.
    """
    scratch = Scratch(documents.sparkSession, "mix")
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    order = F.xxhash64(F.col("doc_id"), F.xxhash64("text"), F.lit(seed))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), order.alias("order"), *([F.struct("*").alias("doc")] * whole))
    rows = scratch.save(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    sources = scratch.save(targets(scratch.save(_numbered(rows, scratch), "numbered")), "targets")
    length = F.least(F.lit(block_words), F.greatest(F.lit(1), F.floor(F.col("target") / FINE))).cast("long")
    sources = sources.withColumn("length", length).withColumn("blocks", F.ceil(F.col("size") / F.col("length")).cast("long"))
    quota = F.least(MOST * F.col("blocks"), F.round(F.col("target") * F.col("blocks") / F.col("size")).cast("long"))
    sources = scratch.save(sources.select("sid", "source", F.col("size").alias("source_size"), "target", "length", "blocks", F.when(F.col("size") > 0, quota).otherwise(0).alias("quota")), "sources")
    slots = _slots(scratch.save(drawn_counts(sources, shards, seed), "drawn"), seed)

    names = sources.select("sid", F.col("source").alias("name"), "length")
    named = rows.join(names, F.col("source").eqNullSafe(F.col("name"))).select("row", "doc_id", "sid", "size", "order", "length")
    parts = max(512, rows.count() // 20_000)                 # a hot source is summed in that many parts
    named = named.withColumn("part", F.pmod("order", F.lit(parts)))
    totals = named.groupBy("sid", "part").agg(F.sum("size").alias("own"))
    base = totals.select("sid", "part", (F.sum("own").over(Window.partitionBy("sid").orderBy("part")) - F.col("own")).alias("base"))
    inside = Window.partitionBy("sid", "part").orderBy("order", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, 0)
    sized = named.withColumn("upto", F.sum("size").over(inside)).join(base, ["sid", "part"])
    sized = scratch.save(sized.select("row", "doc_id", "sid", "size", "length", (F.col("base") + F.col("upto") - F.col("size")).alias("begin")), "sized")

    b = F.col("length")
    end = F.col("begin") + F.col("size")
    spread = sized.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("begin") / b), F.floor((end - 1) / b))))
    low, high = F.greatest("begin", F.col("block") * b), F.least(end, (F.col("block") + 1) * b)
    pieces = spread.select("row", "sid", "block", (low - F.col("begin")).alias("first"), (high - low).alias("words"))
    return Mixture(sized.drop("length"), sources, slots, pieces), rows


def _numbered(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(sid, source, size, weight) of every source, numbered by code point, null last."""
    found = rows.groupBy("source").agg(F.sum("size").alias("size")).withColumn("last", F.col("source").isNull())
    dealt = found.repartitionByRange("last", "source").sortWithinPartitions("last", "source").withColumn("at", F.monotonically_increasing_id())
    dealt = scratch.save(dealt.withColumn("part", F.shiftright("at", 33)), "dealt")
    counts = dealt.groupBy("part").agg(F.min("at").alias("first"), F.count("*").alias("c"))      # a row a partition
    before = F.coalesce(F.sum("c").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sid = (F.col("at") - F.col("first") + F.col("before")).cast("long")
    numbered = dealt.join(counts.select("part", "first", before.alias("before")), "part").select(sid.alias("sid"), "source", "size")
    return numbered.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("sid") % len(WEIGHTS) + 1).cast("int")))


def taken(documents: DataFrame, block_words: int = BLOCK_WORDS, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for every row: how many words the mix takes of it."""
    mixture, _ = mix(documents, block_words, shards, seed)
    used = mixture.used().groupBy("row").agg(F.sum(F.col("words") * F.col("uses")).alias("taken"))
    out = mixture.sized.join(used.hint("merge"), "row", "left").join(mixture.sources.select("sid", "source", "source_size", "target"), "sid")
    return out.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(documents: DataFrame, block_words: int, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """The mix as rows of ``documents``: one row for each use of a document's piece of a block, text cut at words (white
    space stays with the word before it, so that the pieces of a document join to it).  ``n_chars`` is set anew if it is there."""
    mixture, rows = mix(documents, block_words, shards, seed, whole=True)
    cuts = mixture.used().groupBy("row").agg(F.sort_array(F.collect_list(F.struct("first", "words", "uses"))).alias("cuts"))   # of one document

    @F.udf("array<string>")
    def cut(text, cuts):
        starts = [m.start() for m in re.finditer(WORD, text)] + [len(text)]
        starts[0] = 0
        return [text[starts[c.first]:starts[c.first + c.words]] for c in cuts for _ in range(c.uses)]

    out = rows.join(cuts.hint("merge"), "row").select("doc", F.explode(cut(F.col("doc.text").cast("string"), "cuts")).alias("piece"))
    changed = {"text": F.col("piece"), "n_chars": F.length("piece").cast("long")}
    return out.select(*(changed.get(c, F.col(f"doc.`{c}`")).alias(c) for c in documents.columns))
