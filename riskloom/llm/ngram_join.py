"""N-gram Jaccard join (grouped prefix join): documents whose word shingle sets reach a Jaccard similarity.

Rules, exact for every input up to 64-bit shingle hashes (two shingles that meet by chance need about 2^-64):

1. A fixed-size count sketch of all shingles gives one global order, common shingles last; any order is right,
   this one keeps shared passages out of prefixes.  A document's prefix is its first ``n - ceil(t n) + 1``
   shingles: documents that link share a prefix shingle.
2. Documents with the same prefix and size collapse into one *group*, and equal sets into one *class* of a group.
   Only groups are dealt out by prefix shingle.
3. Group pairs pass the size and position filters and are expanded to classes.  Each document has a parity bit map of
   its set, one or two bits a shingle: bits that differ are shingles that differ, so a pair with too many of them is
   dropped without its sets (``_likely``).  The sets of the other pairs are fetched and intersected.
   Pairs are asked for in two steps so that a large group of near copies is not paired with itself: first each
   group against the first group of each shingle; then, over shingles whose groups are not yet in one component,
   every remaining pair that joins two components.  Pairs inside one component need no check, since the result
   is components; no link between components is lost.

A shingle so common that its groups would fill a task is dealt out in several parts (``fan``) in the first step, and to
the cells of a grid (``_grid``) in the second.
"""
from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from . import textbytes as tb
from .graph import components
from .store import FLAT_PARTS, Scratch, plain, tree_sum

WIDTH, PERCENT = 5, 80
SKETCH_BITS = 22          # 2^22 counters of 4 bytes: 16 MB, whatever the input
FILTER_BITS = 23          # bits of the filter of documents to fetch: 1 MB, whatever the input
DEAL = 20_000             # groups of one shingle that are dealt to one task
SPLITS = 8                # splits of the input that one task counts, so that fewer sketches are handed on
_NO_ID = 1 << 62          # rows without doc_id carry a key from here on; doc_ids are below


def _rows(batch: pa.RecordBatch, width: int) -> Iterator[tuple]:
    """(doc keys, sorted distinct (row, hash), n a row) for slices of a batch of (key, text)."""
    for at, raw, offsets in tb.text_slices(batch.column(1)):
        n = len(offsets) - 1
        starts, ends, rows = tb.words(raw, offsets)
        yield batch.column(0).slice(at, n), n, tb.shingles(tb.word_hashes(raw, starts, ends), rows, n, width)


def sketch(texts: DataFrame, width: int = WIDTH, bits: int = SKETCH_BITS) -> np.ndarray:
    """Counts of shingles by the first ``bits`` bits of their hash, over all texts."""
    def count(batches):
        tb.begin("ngram_join")
        total = np.zeros(1 << bits, np.uint32)
        for batch in batches:
            for _, _, (hashes, _, _) in _rows(batch, width):
                cells, times = np.unique((hashes >> np.uint64(64 - bits)).astype(np.uint32), return_counts=True)
                total[cells] += times.astype(np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], ["counts"])

    def add(x, y):
        return x + np.minimum(y, ~x)  # stays at the largest count instead of overflowing

    texts = texts.coalesce(max(FLAT_PARTS, texts.rdd.getNumPartitions() // SPLITS))
    got = tree_sum(texts.mapInArrow(count, "counts binary"), "counts", np.uint32, add)
    return np.zeros(1 << bits, np.uint32) if got is None else got


def _unique(hashes, rows, count=None):
    """Sorted by row, then count, then hash, repeats of a row dropped."""
    key = rows.astype(np.int64) << np.int64(32)
    order = np.lexsort((hashes, key if count is None else key | count.astype(np.int64)))
    hashes, rows = hashes[order], rows[order]
    keep = np.ones(len(hashes), bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
    return hashes[keep], rows[keep], None if count is None else count[order][keep]


def _lists(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def _parity(hashes: np.ndarray, rows: np.ndarray, n: np.ndarray) -> pa.Array:
    """A bit map a row with the parity of its hashes by their last bits: a power of two of n bits or more, 64 at least."""
    size = np.where(n > 0, np.int64(1) << np.maximum(6, np.ceil(np.log2(np.maximum(n, 1)))).astype(np.int64), 0)
    begin = np.cumsum(size) - size
    at = begin[rows] + (hashes & (size[rows] - 1).astype(np.uint64)).astype(np.int64)
    odd = (np.bincount(at, minlength=int(size.sum())) & 1).astype(np.uint8)
    offsets = np.concatenate([[0], np.cumsum(size // 8)]).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(np.packbits(odd, bitorder="little"))])


def _differing(one: pa.Array, two: pa.Array) -> np.ndarray:
    """How many bits differ in each pair of bit maps; the longer one is folded to the length of the shorter."""
    def maps(column):
        offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
        return np.frombuffer(column.buffers()[2] or b"", np.uint8), offsets[:-1], np.diff(offsets)

    (x, at_x, len_x), (y, at_y, len_y) = maps(one), maps(two)
    out = np.zeros(len(one), np.int64)
    for a, b in np.unique(np.stack([len_x, len_y], 1), axis=0):
        rows = np.flatnonzero((len_x == a) & (len_y == b))
        step = max(1, (4 << 20) // max(a, b, 1))          # so many maps at a time
        for part in (rows[i:i + step] for i in range(0, len(rows), step)):
            both = [data[at[part][:, None] + np.arange(size)] for data, at, size in ((x, at_x, a), (y, at_y, b))]
            short = min(a, b)
            both = [np.bitwise_xor.reduce(m.reshape(len(part), -1, short), axis=1) if short else m[:, :0] for m in both]
            out[part] = np.bitwise_count(both[0] ^ both[1]).sum(axis=1, dtype=np.int64)
    return out


def signatures(texts: DataFrame, counts, width: int = WIDTH, percent: int = PERCENT, deal: int = DEAL) -> DataFrame:
    """A row for each document: key, n, set hash (h1, h2), prefix hash g, prefix shingles, their fan, parity bit map."""
    bits = int(np.log2(len(counts.value)))

    def sign(batches):
        tb.begin("ngram_join")
        for batch in batches:
            for keys, n_rows, (hashes, rows, _) in _rows(batch, width):
                seen = counts.value[(hashes >> np.uint64(64 - bits)).astype(np.int64)]
                hashes, rows, seen = _unique(hashes, rows, np.minimum(seen, 2**31 - 1))
                n = np.bincount(rows, minlength=n_rows)
                begin = np.cumsum(n) - n
                keep = np.where(n > 0, n - (percent * n + 99) // 100 + 1, 0)
                head = np.arange(len(rows)) - begin[rows] < keep[rows]
                h1, h2, g = (np.zeros(n_rows, np.uint64) for _ in range(3))
                full = np.flatnonzero(n)
                if len(full):
                    h1[full] = np.add.reduceat(tb.mix(hashes, 50), begin[full])
                    h2[full] = np.add.reduceat(tb.mix(hashes, 51), begin[full])
                    first = np.cumsum(keep) - keep
                    g[full] = np.add.reduceat(tb.mix(hashes[head], 52), first[full])
                fan = 1 + seen[head] // deal
                yield pa.RecordBatch.from_arrays([
                    keys, pa.array(n, pa.int64()), *(pa.array(x.view(np.int64)) for x in (h1, h2, g)),
                    _lists(hashes[head].view(np.int64), keep, pa.int64()), _lists(fan.astype(np.int32), keep, pa.int32()), _parity(hashes, rows, n)],
                    ["doc", "n", "h1", "h2", "g", "prefix", "fan", "odd"])

    return texts.mapInArrow(sign, "doc long, n long, h1 long, h2 long, g long, prefix array<long>, fan array<int>, odd binary")


def _bit(keys: np.ndarray, bits: int) -> np.ndarray:
    return (tb.mix(keys.astype(np.int64).view(np.uint64), 70) >> np.uint64(64 - bits)).astype(np.int64)


def _wanted(ids: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """A bit map of fixed size that holds every id (and some others)."""
    def mark(batches):
        found = np.zeros(1 << bits, bool)
        for batch in batches:
            found[_bit(batch.column(0).to_numpy(zero_copy_only=False), bits)] = True
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(np.packbits(found).tobytes(), 1)], pa.binary())], ["bits"])

    got = tree_sum(ids.mapInArrow(mark, "bits binary"), "bits", np.uint8, np.bitwise_or)
    return np.zeros((1 << bits) // 8, np.uint8) if got is None else got


def _among(ids: DataFrame, bits: int = FILTER_BITS):
    """A condition on a long column that holds for every id (and some others)."""
    wanted = ids.sparkSession.sparkContext.broadcast(_wanted(ids, bits))

    @F.arrow_udf("boolean")
    def among(keys: pa.Array) -> pa.Array:
        at = _bit(keys.to_numpy(zero_copy_only=False), bits)
        return pa.array((wanted.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool))

    return among


def _likely(pairs: DataFrame, signed: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose bit maps leave room for the similarity: every pair that reaches it, and few others."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id"))
    maps = signed.where("n > 0").where(_among(ids)("doc")).select("doc", "n", "odd").distinct()
    one, two = (maps.select(F.col("doc").alias(c), F.col("n").alias(f"n{c}"), F.col("odd").alias(f"odd{c}")) for c in "ab")

    def keep(batches):
        for batch in batches:
            na, nb = (batch.column(c).to_numpy() for c in ("na", "nb"))
            common = np.minimum((na + nb - _differing(batch.column("odda"), batch.column("oddb"))) // 2, np.minimum(na, nb))
            yield batch.select(["a", "b"]).filter(pa.array((100 + percent) * common >= percent * (na + nb)))

    return pairs.join(one, "a").join(two, "b").select("a", "b", "na", "nb", "odda", "oddb").mapInArrow(keep, "a long, b long").distinct()


def _sets(texts: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(doc, set) of the documents in ``ids``; a bit map keeps most others from being dealt out."""
    spark, bits = texts.sparkSession, FILTER_BITS
    wanted = spark.sparkContext.broadcast(_wanted(ids, bits))

    def fetch(batches):
        tb.begin("ngram_join")
        bitmap = np.unpackbits(wanted.value).astype(bool)
        for batch in batches:
            keep = bitmap[_bit(batch.column(0).to_numpy(zero_copy_only=False), bits)]
            for keys, n_rows, (hashes, rows, _) in _rows(batch.filter(pa.array(keep)), width):
                hashes, rows, _ = _unique(hashes, rows)
                yield pa.RecordBatch.from_arrays([keys, _lists(hashes.view(np.int64), np.bincount(rows, minlength=n_rows), pa.int64())], ["doc", "set"])

    sets = texts.mapInArrow(fetch, "doc long, set array<long>")
    return sets.join(ids.select(F.col("id").alias("doc")).distinct(), "doc", "left_semi")


def _verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the similarity."""
    sets = _sets(texts, pairs.select(F.explode(F.array("a", "b")).alias("id")), width)
    one, two = sets.select(F.col("doc").alias("a"), F.col("set").alias("sa")), sets.select(F.col("doc").alias("b"), F.col("set").alias("sb"))
    both = pairs.join(one, "a").join(two, "b").withColumn("common", F.size(F.array_intersect("sa", "sb")))
    return both.where(100 * F.col("common") >= percent * (F.size("sa") + F.size("sb") - F.col("common"))).select("a", "b")


def _close(n1, p1, n2, p2, percent: int):
    """Size filter, and the position filter: what follows the first common shingle must suffice."""
    rest = F.least(n1 - p1, n2 - p2)
    sizes = 100 * F.least(n1, n2) >= percent * F.greatest(n1, n2)
    return sizes & ((100 + percent) * rest >= percent * (n1 + n2))


def _groups(filled: DataFrame, gids: DataFrame) -> DataFrame:
    """(gid, n, prefix, fan) of each group.  Only rows whose group may have several (by a bit map) are grouped, so that
    other prefixes are not moved."""
    key = F.xxhash64("g", "n")
    several = _among(gids.where("copies > 1").select(key.alias("id")))(key)
    alone = filled.where(~several).select(F.col("doc").alias("gid"), "n", "prefix", "fan")
    more = filled.where(several).groupBy("g", "n").agg(F.min("doc").alias("gid"), F.any_value("prefix").alias("prefix"), F.any_value("fan").alias("fan"))
    return alone.unionByName(more.select("gid", "n", "prefix", "fan"))


def _shared(groups: DataFrame, percent: int) -> DataFrame:
    """(token, part, gid, n, pos, hub) of the groups that may link with another one at a prefix shingle.

    Each prefix shingle is moved once, as four longs with size and position in one.  Part 0 holds a whole shingle, parts
    from 1 on those of a common one, whose groups may meet groups of other parts.  A group of a whole shingle stays only
    if size and position filters leave room for another group: of two groups, for each other; of more, for the smallest
    size there that could link."""
    dealt = groups.select("gid", "n", F.posexplode(F.arrays_zip("prefix", "fan")).alias("pos", "at"))
    part = F.when(F.col("at.fan") > 1, 1 + F.pmod(F.xxhash64("gid"), F.col("at.fan"))).otherwise(0).cast("long")
    dealt = dealt.select(part.alias("part"), F.col("at.prefix").alias("token"), (F.shiftleft("n", 32) + F.col("pos")).alias("place"), "gid")
    same = Window.partitionBy("token", "part")
    me = F.struct("gid", "place")
    met = dealt.withColumns({"hub": F.min(me).over(same), "last": F.max(me).over(same), "least": F.min("place").over(same), "groups": F.count("*").over(same)})
    n, pos = (lambda c: F.shiftright(c, 32)), (lambda c: F.col(c).bitwiseAND(0xFFFFFFFF).cast("int"))
    close = _close(n("hub.place"), pos("hub.place"), n("last.place"), pos("last.place"), percent)
    room = (100 + percent) * 100 * (n("place") - pos("place")) >= percent * (100 * n("place") + F.greatest(100 * n("least"), percent * n("place")))
    met = met.where((F.col("part") > 0) | (F.col("hub.gid") != F.col("last.gid")) & F.when(F.col("groups") == 2, close).otherwise(room))
    hub = F.struct(F.col("hub.gid").alias("gid"), n("hub.place").alias("n"), pos("hub.place").alias("pos"))
    return met.select("token", "part", "gid", n("place").alias("n"), pos("place").alias("pos"), hub.alias("hub"))


def _grid(one: DataFrame, two: DataFrame, percent: int):
    """(one, two, keys): both sides of the second step dealt to cells of about ``deal`` rows a side.

    A token of ``lines`` > 1 or ``columns`` > 1 is cut by size and by a grid.  Sizes that can link lie in the same or
    neighbouring bins of a logarithmic scale: the left side goes to three bins, the right side to its own.  Left rows
    are dealt to lines and copied to all columns, right rows the other way round, so that each pair meets in one cell.
    Every other token stays one cell, without copies."""
    step = math.log(100 / percent) + 0.01     # a little wider than the size filter, so that rounding loses no pair
    cut = ((F.col("lines") > 1) | (F.col("columns") > 1)) & (F.col("kind") == 0)
    scale = lambda c: F.floor(F.log(F.col(c)) / step).cast("int")
    near = F.when(cut, F.array(*(scale("n1") + d for d in (-1, 0, 1)))).otherwise(F.array(F.lit(0)))
    one, two = one.withColumn("bin", F.explode(near)), two.withColumn("bin", F.when(cut, scale("n2")).otherwise(0))
    deals = lambda side, n: F.pmod(F.xxhash64(f"gid{side}", f"label{side}"), F.col(n)).cast("int")
    copies = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = one.withColumn("line", deals(1, "lines")).withColumn("column", copies("columns"))
    two = two.withColumn("column", deals(2, "columns")).withColumn("line", copies("lines"))
    return one.drop("lines", "columns"), two.drop("lines", "columns"), ["kind", "token", "bin", "line", "column"]


def jaccard_components(documents: DataFrame, width: int = WIDTH, percent: int = PERCENT, deal: int = DEAL) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``documents(doc_id, text)``.

    Words are runs of bytes other than white space, A-Z lower-cased.  A null, empty or blank text has an empty set
    and links with nothing: n_shingles 0, component_id its doc_id.  Fewer than ``width`` words are one shingle.
    Repeated rows are copies of each other; rows that share a doc_id but not a text count as one linked document.
    A row without doc_id takes part through its text, and a component of such rows only has component_id null.
    An empty table gives an empty result; other columns are ignored.
    """
    spark: SparkSession = documents.sparkSession
    scratch = Scratch(spark, "jaccard")
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID) + F.pmod(F.xxhash64("text"), F.lit(1 << 61)))
    texts = plain(documents, "doc_id", "text").select(key.alias("doc"), F.col("text").cast("string").alias("text"))

    counts = spark.sparkContext.broadcast(sketch(texts, width))
    signed = scratch.save(signatures(texts, counts, width, percent, deal), "signed")
    filled = signed.where("n > 0")
    classes = filled.groupBy("h1", "h2").agg(F.min("doc").alias("id"), F.min("n").alias("n"), F.min("g").alias("g"))
    classes = scratch.save(classes, "classes")
    gids = scratch.save(filled.groupBy("g", "n").agg(F.min("doc").alias("gid"), F.count("*").alias("copies")), "gids")
    shared = scratch.save(_shared(_groups(filled, gids), percent), "shared")

    hubs = shared.groupBy("token").agg(F.min("hub").alias("top"), F.max("part").alias("parts")).where("parts > 0")
    first = shared.where("gid <> hub.gid").select("gid", "n", "pos", "hub")
    over = shared.select("token", "hub").distinct().join(hubs, "token").where("hub.gid <> top.gid")
    first = first.unionByName(over.select("hub.gid", "hub.n", "hub.pos", F.col("top").alias("hub")))
    first = first.where(_close(F.col("n"), F.col("pos"), F.col("hub.n"), F.col("hub.pos"), percent))
    first = first.select(F.col("hub.gid").alias("a"), "gid").distinct()
    members = scratch.save(classes.join(gids, ["g", "n"]).select("gid", "id"), "members")
    pairs = first.join(members, "gid").select("a", F.col("id").alias("b"))
    pairs = pairs.unionByName(members.where("gid <> id").select(F.col("gid").alias("a"), F.col("id").alias("b"))).distinct()
    pairs = scratch.save(_likely(scratch.save(pairs, "pairs1"), signed, percent), "likely1")
    links = scratch.save(_verified(pairs, texts, width, percent), "links1")
    labels = components(links, scratch, "first")

    members = members.join(labels.withColumnRenamed("node", "id"), "id", "left").select("gid", "id", F.coalesce("label", "id").alias("label"))
    members = scratch.save(members, "labelled")
    parts = members.groupBy("gid", "label").agg(F.count("*").alias("size"))
    by_token = shared.join(parts, "gid").select("token", "gid", "label", "n", "pos")
    in_group = parts.select(F.col("gid").alias("token"), "gid", "label", F.lit(0).cast("long").alias("n"), F.lit(0).alias("pos"))
    rest = scratch.save(reduce(DataFrame.unionByName, [by_token.withColumn("kind", F.lit(0)), in_group.withColumn("kind", F.lit(1))]), "rest")
    per = rest.groupBy("kind", "token", "label").agg(F.count("*").alias("c"))
    main = per.groupBy("kind", "token").agg(F.max(F.struct("c", "label")).alias("m"), F.min("label").alias("lo"), F.max("label").alias("hi"), F.sum("c").alias("all"))
    parts_of = lambda rows, name: (1 + F.floor(rows / deal)).cast("int").alias(name)
    main = main.where("lo <> hi").select("kind", "token", F.col("m.label").alias("main"), parts_of(F.col("all") - F.col("m.c"), "lines"), parts_of(F.col("all"), "columns"))
    rest = scratch.save(rest.join(main, ["kind", "token"]), "open")
    one = rest.where("label <> main").select("kind", "token", "lines", "columns", *(F.col(c).alias(f"{c}1") for c in ("gid", "label", "n", "pos")))
    two = rest.select("kind", "token", "lines", "columns", "main", *(F.col(c).alias(f"{c}2") for c in ("gid", "label", "n", "pos")))
    cond = (F.col("label1") != F.col("label2")) & ((F.col("label2") == F.col("main")) | (F.col("label1") < F.col("label2")))
    cond &= (F.col("kind") == 1) | _close(F.col("n1"), F.col("pos1"), F.col("n2"), F.col("pos2"), percent)
    one, two, keys = _grid(one, two, percent)
    left = one.join(two, keys).where(cond).select("gid1", "label1", "gid2", "label2").distinct()
    m1 = members.select(F.col("gid").alias("gid1"), F.col("label").alias("label1"), F.col("id").alias("a"))
    m2 = members.select(F.col("gid").alias("gid2"), F.col("label").alias("label2"), F.col("id").alias("b"))
    pairs = left.join(m1, ["gid1", "label1"]).join(m2, ["gid2", "label2"])
    pairs = scratch.save(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs2")
    pairs = scratch.save(_likely(pairs, signed, percent), "likely2")
    links = links.unionByName(scratch.save(_verified(pairs, texts, width, percent), "links2"))
    labels = components(links, scratch, "last")

    found = classes.join(labels.withColumnRenamed("node", "id"), "id", "left").select("h1", "h2", F.coalesce("label", "id").alias("component"))
    out = signed.select("doc", "n", F.when(F.col("n") > 0, F.col("h1")).otherwise(F.xxhash64("doc")).alias("h1"), F.when(F.col("n") > 0, F.col("h2")).alias("h2"))
    out = out.join(found, ["h1", "h2"], "left").select("doc", "n", F.coalesce("component", "doc").alias("component"))
    known = lambda c: F.when(F.col(c) < _NO_ID, F.col(c))
    return out.select(known("doc").alias("doc_id"), F.col("n").alias("n_shingles"), known("component").alias("component_id"))


def first_of_each(documents: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The rows of ``documents`` that stay when one document of each component is kept: the one whose doc_id is the
    component's id, of rows that share a doc_id the one with the smallest text.  Documents without words, or without
    doc_id, stay unless they repeat a doc_id.  All columns are kept."""
    found = jaccard_components(documents, width, percent).select("doc_id", "component_id")
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    kept = documents.join(gone, documents["doc_id"] == gone["_gone"], "left_anti")
    again = found.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_again"))
    again = Scratch(documents.sparkSession, "again").save(again, "ids")
    if again.isEmpty():
        return kept
    many = kept["doc_id"] == again["_again"]
    one = kept.join(again, many, "left_semi").withColumn("_turn", F.row_number().over(Window.partitionBy("doc_id").orderBy("text")))
    return kept.join(again, many, "left_anti").unionByName(one.where("_turn = 1").drop("_turn"))


#: DuckDB SQL of the query, from all pairs that share a shingle; links are followed by recursion.
SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[\x20\x09-\x0D]+'), lambda v: v <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS shingle FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (shingle) WHERE a.doc_id < b.doc_id GROUP BY x, y),
links AS (SELECT x, y FROM pairs JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
ways AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, w.y FROM reach r JOIN ways w ON w.x = r.b)
SELECT d.doc_id, coalesce(n.n, 0)::bigint AS n_shingles, r.component_id FROM d LEFT JOIN n USING (doc_id)
JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) r USING (doc_id)
"""
