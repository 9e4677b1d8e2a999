"""Operators 11 to 13 against plain computations."""
from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from riskloom.llm import merkle, multiprobe, whitening

from . import edge

VECTORS = "vec_id long, embedding array<float>, id long, mark string, n long, packed string, score string, entry string, row string"
CLASH = (7, "x", 9, "x", "x", "x", "x")


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], *CLASH) for i, v in rows], VECTORS)


# ---------------------------------------------------------------- 11

def plain_whitening(rows, k=8):
    left = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    size = max(len(v) for _, v in left)
    c = np.array([np.pad(np.array(v, np.float32).astype(np.float64), (0, size - len(v))) for _, v in left])
    x = np.floor(1024 * c).astype(np.int64) + 100_000
    n, d = len(x), len(x) * x - x.sum(axis=0)
    y = d / n
    v = y.T @ y / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return [i for i, _ in left], n, (d * d).sum(axis=1), y @ u / np.sqrt(np.maximum(e, 1e-300)), e / np.trace(v)


def test_whitening_equals_a_dense_eigensolver(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((300, 60)) * np.linspace(1, 0.7, 60) * 0.1
    rows = [(i, v) for i, v in enumerate(base)] + [(1000 + i, base[5]) for i in range(150)] + [(5, base[5]), (None, base[6])]
    rows += [(2000, None), (2001, [None] * 60), (2002, [float("nan")] * 60), (2003, [float("inf")] * 60), (2004, [0.5] * 10), (2005, [])]
    got = whitening.whiten(vectors(spark, rows)).toPandas()
    ids, n, deviation, white, explained = plain_whitening(rows)
    assert list(got.columns) == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert len(got) == 8 * n and set(got["n"]) == {n} and got["identity_error"].max() < 1e-9
    mine = got.pivot_table(index=got.groupby("component").cumcount(), columns="component", values="whitened")
    dev = got[got["component"] == 1]["deviation"].to_numpy()
    order, other = np.lexsort((mine[1].abs().round(6), dev)), np.lexsort((np.abs(white[:, 0]).round(6), deviation))
    assert (dev[order] == deviation[other]).all()
    assert np.allclose(np.abs(mine.to_numpy()[order]), np.abs(white[other]), atol=1e-8)
    assert np.allclose(got.groupby("component")["explained"].first(), explained, rtol=1e-9)
    signs = np.sign(mine.to_numpy()[order] * white[other])
    assert all(len({s for s in col if s}) == 1 for col in signs[np.abs(white[other]).min(axis=1) > 1e-6].T)   # one sign for all rows


@pytest.mark.parametrize("rows, rows_out", [([], 0), ([(1, None)], 0), ([(1, [0.5, 0.25])], 0), ([(1, [0.5, 0.25])] * 5, 0), ([(1, [])], 0),
                                            ([(i, [i / 7, 1.0, 1.0]) for i in range(5)], 5), ([(i, [i / 7, (i * i) % 3, 1.0]) for i in range(9)], 18)])
def test_whitening_of_few_rows_and_low_ranks(spark, rows, rows_out):
    assert whitening.whiten(vectors(spark, rows)).count() == rows_out


def test_whitening_of_huge_numbers(spark):
    frame = spark.createDataFrame([(i, [float(i) * 1e18, 1e300 if i == 3 else 0.0]) for i in range(6)], "vec_id long, embedding array<double>")
    got = whitening.whiten(frame, components=1).toPandas()
    assert len(got) == 6 and got["deviation"].isna().all() and abs(got["whitened"].pow(2).mean() - 1) < 1e-9


def test_leading_eigenpairs_stand_equal_and_zero_eigenvalues():
    rng = np.random.default_rng(0)
    q, _ = np.linalg.qr(rng.standard_normal((120, 120)))
    for values in ([5.0] * 20 + [1.0] * 100, [3.0, 2.0, 1.0] + [0.0] * 117, list(np.linspace(1, 0.9, 120))):
        v = q @ np.diag(values) @ q.T
        e, u = whitening.leading_eigenpairs(lambda m, v=v: v @ m, 120, 8)
        want = [x for x in values[:8] if x]
        assert np.allclose(e, want, atol=1e-12) and np.abs(v @ u - u * e).max() < 1e-10 and np.allclose(u.T @ u, np.eye(len(want)), atol=1e-12)


# ---------------------------------------------------------------- 12

def plain_nearest(rows, k=20, every=20):
    left = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    size = max(len(v) for _, v in left)
    x = np.array([np.pad(v, (0, size - len(v))) for _, v in left])
    ids = np.array([i for i, _ in left])
    out = []
    for at in np.flatnonzero(ids % every == 0):
        score = (x * x[at]).sum(axis=1)
        order = [j for j in np.lexsort((ids, -score)) if j != at][:k]
        out += [(int(ids[at]), r + 1, int(ids[j]), float(score[j])) for r, j in enumerate(order)]
    return sorted(out)


def test_multiprobe_recall_and_scores(spark):
    rng = np.random.default_rng(5)
    points = rng.standard_normal((4000, 24))
    points *= (0.5 + rng.random(4000) / 2)[:, None]
    rows = [(i, p.astype(np.float32)) for i, p in enumerate(points)]
    got = multiprobe.nearest(spark.createDataFrame([(i, p.tolist()) for i, p in rows], "vec_id long, embedding array<float>")).collect()
    want = plain_nearest(rows)
    near = {(q, v): s for q, _, v, s in want}
    found = [(r["query_id"], r["vec_id"]) for r in got]
    assert len(found) == len(want) and len(set(found)) == len(found)
    assert sum(f in near for f in found) >= 0.9 * len(want)
    assert all(r["score"] == near[(r["query_id"], r["vec_id"])] for r in got if (r["query_id"], r["vec_id"]) in near)
    by = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        by.setdefault(r["query_id"], []).append((-r["score"], r["vec_id"]))
    assert all(v == sorted(v) and len(v) == 20 for v in by.values())


def test_multiprobe_copies_repeats_and_odd_rows(spark):
    rng = np.random.default_rng(6)
    base = rng.standard_normal((30, 6)).astype(np.float32)
    rows = [(i, v) for i, v in enumerate(base)]
    rows += [(100 + i, base[0]) for i in range(60)]                       # copies of a query, some of them queries
    rows += [(20, base[20]), (20, base[3]), (7, base[7])]                 # repeated rows and ids
    rows += [(200, None), (220, []), (240, [0.0] * 6), (260, [None, 1, 1, 1, 1, 1]), (280, [float("nan")] * 6), (None, base[1]), (300, base[2][:3])]
    got = sorted(tuple(r) for r in multiprobe.nearest(vectors(spark, rows), recall=1.0).collect())
    want = plain_nearest(rows)
    full = {q for q, *_ in want}
    assert {q for q, *_ in got} == full
    near = pd.DataFrame(want).groupby(0).size()
    assert (pd.DataFrame(got).groupby(0).size() == near).all()
    hot = [r for r in got if r[0] in (100, 120, 140)]
    assert hot == [r for r in want if r[0] in (100, 120, 140)]            # only copies, smallest ids, never the own row
    assert (Counter(got) & Counter(want)).total() >= 0.9 * len(want)


def test_multiprobe_of_few_rows(spark):
    assert multiprobe.nearest(vectors(spark, [])).count() == 0
    assert multiprobe.nearest(vectors(spark, [(20, [1.0, 0.0])])).count() == 0
    assert multiprobe.nearest(vectors(spark, [(21, [1.0, 0.0])])).count() == 0
    got = multiprobe.nearest(vectors(spark, [(20, [1.0, 0.0]), (1, [0.5, 0.5]), (20, [1.0, 0.0])])).collect()
    assert sorted(tuple(r) for r in got) == [(20, 1, 20, 1.0), (20, 1, 20, 1.0), (20, 2, 1, 0.5), (20, 2, 1, 0.5)]


def test_perturbations_come_by_cost_and_never_cross_both_walls():
    sets = multiprobe.perturbations(4, 40)
    assert not sets[0].any() and len({tuple(s) for s in sets.tolist()}) == len(sets)
    assert not (sets & sets[:, ::-1]).any()
    m = 4
    cost = np.array([j * (j + 1) / (4 * (m + 1) * (m + 2)) for j in range(1, m + 1)] + [1 - i / (m + 1) + i * (i + 1) / (4 * (m + 1) * (m + 2)) for i in range(m, 0, -1)])
    totals = sets @ cost
    assert (np.diff(totals) > -1e-12).all()
    every = sorted(sum(cost[j] for j in range(8) if (a >> j) & 1) for a in range(256) if not any((a >> j) & 1 and (a >> (7 - j)) & 1 for j in range(4)))
    assert np.allclose(totals, every[:len(totals)])


def test_a_query_visits_buckets_in_the_order_of_its_own_distances():
    tables = multiprobe.Tables(5, 1.0, 3, 2.0, 60, 1)
    q = np.random.default_rng(1).standard_normal((4, 5))
    table, block, bucket = tables.sequence(q)
    places = tables.places(tables.queries(q))
    for at in range(4):
        costs = []
        for t, b in zip(table[at], bucket[at], strict=True):
            cells, down = np.floor(places[t, at]).astype(np.int64), places[t, at] - np.floor(places[t, at])
            ways = [(sum([0, down[i] ** 2, (1 - down[i]) ** 2][d[i]] for i in range(3)), int(((cells + np.array([[0, -1, 1][x] for x in d])) * tables.factors[t]).sum())) for d in np.ndindex(3, 3, 3)]
            costs.append(next(c for c, key in ways if key == b))
        assert (np.diff(costs) > -1e-9).all() and costs[0] == 0


# ---------------------------------------------------------------- 13

def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(r):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))


def plain_tree(leaves):
    """Root, and for each leaf its (before, after) from below."""
    level, ways, at = list(leaves), [[] for _ in leaves], list(range(len(leaves)))
    while len(level) > 1:
        runs = [level[i:i + 2] for i in range(0, len(level), 2)]
        for k, place in enumerate(at):
            run, digit = runs[place // 2], place % 2
            ways[k].append(("".join(run[:digit]), "".join(run[digit + 1:])))
            at[k] = place // 2
        level = [h(*r) for r in runs]
    return level[0], ways


def plain_manifest(rows):
    """rows of (doc_id, source, lang, n_chars, text)."""
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: sorted([((r[0] is not None, r[0] or 0), plain_leaf(r), r) for r in rows if r[2] == x], key=lambda t: t[:2]) for x in langs}
    low = {x: plain_tree([leaf for _, leaf, _ in t]) for x, t in trees.items()}
    root, above = plain_tree([low[x][0] for x in langs])
    out = []
    for x, up in zip(langs, above, strict=True):
        for (_, leaf, r), way in zip(trees[x], low[x][1], strict=True):
            path = way + up
            node = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None:
                node = plain_leaf((*r[:3], r[3] + 1, r[4]))
            for before, after in path:
                node = h(before, node, after)
            out.append((r[0], leaf, low[x][0], root, h(*(b + a for b, a in path)), node, node == root))
    return sorted(out, key=str)


def documents():
    rng = random.Random(2)
    rows = [(r[0], r[3], r[2], r[4], r[1]) for r in edge.rows()]
    rows += [(i, "web", "en", i, f"text {rng.random()} ü") for i in range(100, 1000)]             # several pages of one tree
    rows += [(i, None, "de", None, "") for i in range(2000, 2257)]                                # one more than a page
    rows += [(3000, "s", "", 2**63 - 1, "x"), (7, "s", "v", -5, "x"), (14, "s", "é", 0, "x")]
    return rows + [(4000, "s", "rep", 1, "x")] * 600                                              # pages of equal records


def test_merkle_manifest_equals_plain_trees_and_sql(spark):
    rows = documents()
    frame = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, tree string, digest string, idx long")
    got = sorted((tuple(r) for r in merkle.verified_manifest(frame).collect()), key=str)
    want = plain_manifest(rows)
    assert got == want and {r[-1] for r in got} == {True, False}
    con = duckdb.connect()
    con.register("documents", pa.table({c: pa.array(v, pa.int64() if c in ("doc_id", "n_chars") else pa.string()) for c, v in zip(("doc_id", "source", "lang", "n_chars", "text"), zip(*rows, strict=True), strict=True)}))
    assert sorted(con.sql(merkle.SQL).fetchall(), key=str) == want


@pytest.mark.parametrize("rows", [[], [(1, "s", "en", 3, "abc")], [(1, "s", None, None, None)], [(i, "s", x, 3, "abc") for i, x in enumerate(["a", None, "b"])]])
def test_merkle_manifest_of_few_rows(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    got = sorted((tuple(r) for r in merkle.verified_manifest(frame).collect()), key=str)
    assert got == (plain_manifest(rows) if rows else [])


def test_a_changed_record_is_noticed(spark):
    from riskloom.llm.store import Scratch

    scratch = Scratch(spark, "test")
    nodes = spark.createDataFrame([("t", i, h(str(i)), (i,)) for i in range(20)], "tree string, key long, digest string, row struct<i:long>")
    made = merkle.build(nodes, scratch, "a")
    begin = made.roots.selectExpr("tree", f"cast(array() as {merkle.PATH}) as path")
    assert merkle.proofs(made, made.leaves.where("idx in (3, 19)"), begin, scratch, "b").count() == 2
    broken = made.pages[0].selectExpr("tree", "idx", "n", "digest", "height", "transform(records, (r, i) -> if(i = 2, struct(r.digest, reverse(r.children) as children), r)) as records")
    with pytest.raises(Exception, match="does not have its digest"):
        merkle.proofs(merkle.Manifest(made.leaves, [broken], made.roots), made.leaves, begin, scratch, "c").count()


def test_passes_of_whitening_take_few_tasks_however_finely_the_input_is_dealt(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, v) for i, v in enumerate(rng.standard_normal((128, 12)))]
    parts, real = [], whitening.sum_over
    monkeypatch.setattr(whitening, "sum_over", lambda df, part, shape: parts.append(df.rdd.getNumPartitions()) or real(df, part, shape))
    conf = {"spark.sql.files.openCostInBytes": "64k", "spark.sql.files.maxPartitionBytes": "64k"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        got = whitening.whiten(vectors(spark, rows).repartition(32)).toPandas()
    finally:
        for k in conf:
            spark.conf.unset(k)
    assert len(got) == 8 * 128 and got["identity_error"].max() < 1e-9
    assert max(parts[1:]) <= 2 * spark.sparkContext.defaultParallelism          # the first one reads the rows as they came
