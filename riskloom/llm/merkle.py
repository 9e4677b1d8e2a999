"""Merkle manifest of a dataset: a content-addressed DAG of digests, and proofs by descent from the root.

Leaves are dealt to trees and numbered in a tree's order; every ``ARITY`` consecutive nodes of a level become the
digest of their concatenated digests, a last run of fewer, even of one, too, until one node remains.  The trees' roots,
in the trees' order, likewise give the root.  The DAG is stored as digest-to-children records, ``LEVELS`` levels of a
subtree to a *page* under the digest of the subtree's top.

A request for a leaf descends from the root: its rank's digits choose a child at each record, and the children not
chosen are collected.  Requests that share a page share the way to it, so that each page is read once and no page,
not the root's either, meets more than ``ARITY ** LEVELS`` requests.  What a descent collected, reversed, is the proof
from the leaf to the root.
"""
from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import Scratch, plain

ARITY, LEVELS = 2, 8
SPAN = ARITY**LEVELS           # nodes below a page, and requests that one page meets
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<before:string,after:string>>"


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


@dataclass
class Manifest:
    """``leaves(tree, idx, n, digest, row)``, ``pages`` by height, lowest first, and ``roots(tree, digest)``."""
    leaves: DataFrame
    pages: list[DataFrame]
    roots: DataFrame


def numbered(nodes: DataFrame, scratch: Scratch, tag: str) -> DataFrame:
    """``nodes(tree, key, digest, row)`` with ``idx``, the position among the nodes of the tree by (key, digest), and
    ``n``, the number of the tree's nodes.  A hot tree is cut into ranges like any other stretch of the order."""
    at = F.col("at")
    dealt = nodes.repartitionByRange("tree", "key", "digest").sortWithinPartitions("tree", "key", "digest")
    dealt = scratch.save(dealt.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright(at, 33)), f"{tag}-dealt")
    counts = dealt.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count("*").alias("c"))
    before = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("tree", "part", (F.coalesce(F.sum("c").over(before), F.lit(0)) - F.col("first")).alias("shift"), F.sum("c").over(Window.partitionBy("tree")).alias("n"))
    return dealt.join(starts, ["tree", "part"]).select("tree", (at + F.col("shift")).alias("idx"), "n", "digest", "row")


def _bundle(nodes: DataFrame) -> DataFrame:
    """The pages over one level of nodes: tree, idx, n (of the level above the page), digest, height and records."""
    def build(batches):
        kind = pa.list_(pa.struct([("digest", pa.string()), ("children", pa.list_(pa.string()))]))
        for batch in batches:
            widths, tops, heights, pages = [], [], [], []
            for width, run in zip(batch.column("n").to_pylist(), batch.column("digests").to_pylist(), strict=True):
                height, page = 0, {}
                while height < LEVELS and width > 1:
                    runs = [run[i:i + ARITY] for i in range(0, len(run), ARITY)]
                    run = [digest(*r) for r in runs]
                    page.update(zip(run, runs, strict=True))
                    width, height = -(-width // ARITY), height + 1
                widths.append(width)
                tops.append(run[0])
                heights.append(height)
                pages.append([{"digest": d, "children": c} for d, c in page.items()])
            yield pa.RecordBatch.from_arrays([batch.column("tree"), batch.column("idx"), pa.array(widths, pa.int64()), pa.array(tops, pa.string()), pa.array(heights, pa.int32()), pa.array(pages, kind)],
                                             ["tree", "idx", "n", "digest", "height", "records"])

    page = F.floor(F.col("idx") / SPAN).cast("long")
    grouped = nodes.groupBy("tree", "n", page.alias("idx")).agg(F.sort_array(F.collect_list(F.struct("idx", "digest"))).alias("m"))
    return grouped.select("tree", "idx", "n", F.col("m.digest").alias("digests")).mapInArrow(build, "tree string, idx long, n long, digest string, height int, records array<struct<digest:string,children:array<string>>>")


def build(nodes: DataFrame, scratch: Scratch, tag: str) -> Manifest:
    """The manifest of ``nodes(tree, key, digest, row)``.  Rounds grow with the logarithm to the base ``SPAN``."""
    leaves = scratch.save(numbered(nodes, scratch, tag), f"{tag}-leaves")
    pages, open_nodes = [], leaves
    while not pages or not open_nodes.isEmpty():
        pages.append(scratch.save(_bundle(open_nodes), f"{tag}-pages{len(pages)}"))
        open_nodes = pages[-1].where("n > 1")
    roots = pages[0].where("n = 1")
    for more in pages[1:]:
        roots = roots.unionByName(more.where("n = 1"))
    return Manifest(leaves, pages, scratch.save(roots.select("tree", "digest"), f"{tag}-roots"))


def _descend(frontier: DataFrame, pages: DataFrame, wanted: DataFrame) -> DataFrame:
    """One page further down: a row for each of ``wanted(tree, idx, row)`` below a page of ``frontier(tree, idx, digest,
    path)``, with the digest that the records lead to and the path, still from the top."""
    def walk(batches):
        side = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))
        for batch in batches:
            found, paths, trees, places = [], [], [], []
            records = zip(*(batch.column(c).to_pylist() for c in ("tree", "digest", "height", "records", "path", "places")), strict=True)
            for tree, top, height, page, path, asked in records:
                children = {r["digest"]: r["children"] for r in page}
                for d, c in children.items():
                    if digest(*c) != d:
                        raise ValueError(f"a record of page {top} does not have its digest")
                for place in asked:
                    node, way = top, list(path)
                    for level in range(height - 1, -1, -1):
                        run, digit = children[node], place % SPAN // ARITY**level % ARITY
                        way.append({"before": "".join(run[:digit]), "after": "".join(run[digit + 1:])})
                        node = run[digit]
                    found.append(node)
                    paths.append(way)
                trees += [tree] * len(asked)
                places += asked
            row = batch.column("row").flatten()
            yield pa.RecordBatch.from_arrays([pa.array(trees, pa.string()), pa.array(places, pa.int64()), pa.array(found, pa.string()), pa.array(paths, side), row], ["tree", "idx", "digest", "path", "row"])

    page = F.floor(F.col("idx") / SPAN).cast("long").alias("idx")
    asked = wanted.groupBy("tree", page).agg(F.collect_list(F.struct(F.col("idx").alias("place"), "row")).alias("asked"))
    store = pages.dropDuplicates(["digest"]).select("digest", "height", "records")
    met = frontier.join(asked, ["tree", "idx"]).join(store, "digest")
    met = met.select("tree", "digest", "height", "records", "path", F.col("asked.place").alias("places"), F.col("asked.row").alias("row"))
    kind = wanted.schema["row"].dataType.simpleString()
    return met.mapInArrow(walk, f"tree string, idx long, digest string, path {PATH}, row {kind}")


def proofs(manifest: Manifest, wanted: DataFrame, starts: DataFrame, scratch: Scratch, tag: str) -> DataFrame:
    """(tree, idx, digest, path, row) for each of ``wanted``, rows of the manifest's leaves.  ``starts(tree, path)`` has
    what lies above a tree's root, from the top; the paths returned go from the leaf to the top."""
    frontier = None
    for height in range(len(manifest.pages) - 1, -1, -1):
        pages = manifest.pages[height]
        tops = pages.where("n = 1").select("tree", "idx", "digest").join(starts, "tree").select("tree", "idx", "digest", "path")
        frontier = tops if frontier is None else frontier.select("tree", "idx", "digest", "path").unionByName(tops)
        below = wanted
        if height:
            below = wanted.select("tree", F.floor(F.col("idx") / SPAN**height).cast("long").alias("idx")).distinct().withColumn("row", F.lit(0))
        frontier = scratch.save(_descend(frontier, pages, below), f"{tag}-way{height}")
    return frontier.withColumn("path", F.reverse("path"))


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf's digest and its proof lead to."""
    return F.aggregate(path, start, lambda node, step: F.sha2(F.concat(step["before"], node, step["after"]), 256))


def verified_manifest(documents: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for every row of ``documents``.

    Trees are the languages, null first, then by bytes; leaves ascend by doc_id, null first, and rows that share a
    doc_id by digest, so that repeated rows have a position each.  A row is tampered with if 7 divides the crc32 of its
    doc_id in decimals and n_chars is not null; a null doc_id has no crc32.  An empty text is ``0:``.  An empty table
    gives an empty result; other columns, whatever their names, are ignored.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "merkle")
    docs = plain(documents, *FIELDS).select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", F.col("n_chars").cast("long").alias("n_chars"), "text")
    values = {c: F.col(c) for c in FIELDS}
    changed = values | {"n_chars": F.col("n_chars").cast("decimal(20,0)") + 1}
    aimed = (F.crc32(F.col("doc_id").cast("string")) % 7 == 0) & F.col("n_chars").isNotNull()
    row = F.struct("doc_id", F.when(aimed, leaf(*changed.values())).alias("tampered"))
    tree = F.coalesce(F.concat(F.lit("v"), F.col("lang")), F.lit("n"))       # "n" comes before all values
    nodes = docs.select(tree.alias("tree"), F.col("doc_id").alias("key"), leaf(*values.values()).alias("digest"), row.alias("row"))
    manifest = build(nodes, scratch, "rows")
    above = manifest.roots.select(F.lit("").alias("tree"), F.col("tree").alias("key"), "digest", F.struct("tree").alias("row"))
    top = build(above, scratch, "trees")
    nothing = F.lit(None).cast(PATH)
    begin = top.roots.select("tree", F.coalesce(nothing, F.array().cast(PATH)).alias("path"))
    ways = proofs(top, top.leaves, begin, scratch, "above")
    starts = ways.select(F.col("row.tree").alias("tree"), F.reverse("path").alias("path"))
    proven = proofs(manifest, manifest.leaves, scratch.save(starts, "starts"), scratch, "below")
    proven = proven.join(manifest.roots.withColumnRenamed("digest", "subroot"), "tree").withColumn("root", top.roots.select("digest").scalar())
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["before"], s["after"])), "")
    out = proven.select(F.col("row.doc_id").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"),
                        fold(F.coalesce("row.tampered", "digest"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


#: DuckDB SQL of the query.  crc32 goes bit by bit over the decimal digits of doc_id.
SQL = r"""
WITH RECURSIVE crc AS (SELECT DISTINCT doc_id, list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(doc_id::VARCHAR, '.'), lambda c: ascii(c)::BIGINT)),
  lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)::BIGINT[]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))) AS c FROM documents WHERE doc_id IS NOT NULL),
e AS (SELECT d.doc_id, lang, coalesce(strlen(d.doc_id::VARCHAR) || ':' || d.doc_id::VARCHAR, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
  coalesce(strlen(text) || ':' || text, '-') AS tail, n_chars::HUGEINT AS m, coalesce(xor(c, 4294967295) % 7 = 0, false) AS aimed FROM documents d LEFT JOIN crc ON crc.doc_id = d.doc_id),
h AS (SELECT doc_id, lang, sha256(head || coalesce(strlen(m::VARCHAR) || ':' || m::VARCHAR, '-') || tail) AS leaf,
  sha256(head || coalesce(strlen((m + aimed::INT)::VARCHAR) || ':' || (m + aimed::INT)::VARCHAR, '-') || tail) AS seen FROM e),
p AS (SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n FROM h),
low AS (SELECT tree, 0 AS level, idx, leaf AS d, n FROM p
  UNION ALL SELECT tree, level + 1, idx // 2, sha256(string_agg(d, '' ORDER BY idx)), (n + 1) // 2 FROM low WHERE n > 1 GROUP BY tree, level, idx // 2, n),
sub AS (SELECT tree, d AS subroot, level AS height FROM low WHERE n = 1),
high AS (SELECT 0 AS level, tree AS idx, subroot AS d, (SELECT count(*) FROM sub) AS n FROM sub
  UNION ALL SELECT level + 1, idx // 2, sha256(string_agg(d, '' ORDER BY idx)), (n + 1) // 2 FROM high WHERE n > 1 GROUP BY level, idx // 2, n),
top AS (SELECT d AS root FROM high WHERE n = 1),
ways AS (SELECT p.tree, p.idx, s.level, s.idx > p.idx // (1 << s.level) AS after, s.d FROM p JOIN low s ON s.tree = p.tree AND s.n > 1 AND s.idx = xor(p.idx // (1 << s.level), 1)
  UNION ALL SELECT p.tree, p.idx, sub.height + s.level, s.idx > p.tree // (1 << s.level), s.d FROM p JOIN sub USING (tree) JOIN high s ON s.n > 1 AND s.idx = xor(p.tree // (1 << s.level), 1)),
proof AS (SELECT tree, idx, string_agg(d, '' ORDER BY level) AS s FROM ways GROUP BY tree, idx),
steps AS (SELECT max(level) AS levels FROM high),
folded AS (SELECT p.tree, p.idx, 0 AS level, seen AS d, sub.height + (SELECT levels FROM steps) AS last FROM p JOIN sub USING (tree)
  UNION ALL SELECT f.tree, f.idx, f.level + 1, sha256(CASE WHEN w.after THEN f.d || w.d ELSE coalesce(w.d, '') || f.d END), f.last
  FROM folded f LEFT JOIN ways w ON w.tree = f.tree AND w.idx = f.idx AND w.level = f.level WHERE f.level < f.last)
SELECT p.doc_id, p.leaf, sub.subroot, top.root, sha256(coalesce(proof.s, '')) AS proof_sha256, f.d AS folded_root, f.d = top.root AS verified
FROM p JOIN sub USING (tree) CROSS JOIN top LEFT JOIN proof ON proof.tree = p.tree AND proof.idx = p.idx JOIN folded f ON f.tree = p.tree AND f.idx = p.idx AND f.level = f.last
"""
