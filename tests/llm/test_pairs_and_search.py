import math
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import graph, ngram_join, topk
from riskloom.llm.store import Scratch, ship

from . import edge


def components_by_hand(rows, width=5, percent=80):
    """(doc_id, n, component) from all pairs of sets; rows of one doc_id count as linked."""
    sets, parent = [], list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        sets.append({tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            same = sets[i] and sets[j] and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common)
            if same or sets[i] and sets[j] and rows[i][0] is not None and rows[i][0] == rows[j][0]:
                parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        groups[find(i)].append(doc)
    least = {k: min((d for d in v if d is not None), default=None) for k, v in groups.items()}
    return sorted(((d, len(sets[i]), least[find(i)] if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def near_copies(seed):
    rng = random.Random(seed)
    shared = edge.words(rng, 12, "s")
    texts = []
    for g in range(6):
        base = edge.words(rng, rng.choice([6, 40, 90]), f"g{g}x")
        for _ in range(rng.choice([1, 4, 12])):
            w = base.split()
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = f"new{rng.randrange(9999)}"
            texts.append(" ".join(w + ([shared] if rng.random() < 0.3 else [])))
    texts += [shared] * 5 + [edge.words(rng, 50, "solo") for _ in range(5)]
    rng.shuffle(texts)
    return list(enumerate(texts, 100))


@pytest.mark.parametrize("seed,percent,deal", [(1, 80, 20_000), (2, 80, 3), (3, 50, 2)])
def test_components_equal_all_pairs(spark, seed, percent, deal):
    ship(spark)
    rows = near_copies(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, ngram_join.jaccard_components(docs, percent=percent, deal=deal).collect()), key=str)
    assert got == components_by_hand(rows, percent=percent)


def test_many_groups_of_one_template_below_the_limit(spark):
    """Documents off one template that mostly do not link: their groups stay apart until the second step."""
    ship(spark)
    rng, base = random.Random(8), [f"t{i}" for i in range(60)]
    rows = []
    for i in range(120):                                  # 1 to 3 changed words: some pairs link, most do not
        w = list(base)
        for at in rng.sample(range(60), rng.choice([1, 2, 3])):
            w[at] = f"u{rng.randrange(30)}"
        rows.append((i, " ".join(w[: rng.choice([48, 54, 60])])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    expected = components_by_hand(rows)
    assert len({r[2] for r in expected}) > 5
    assert sorted(map(tuple, ngram_join.jaccard_components(docs, deal=4).collect()), key=str) == expected


def test_grid_cells_are_bounded_and_hold_each_pair_once(spark):
    rng = random.Random(9)
    rows = [(rng.randrange(2), rng.choice([5, 5, 5, 6]), gid, gid % 9, rng.randrange(1, 400), 0) for gid in range(300)]
    frame = spark.createDataFrame(rows, "kind int, token long, gid long, label long, n long, pos int")
    cells = frame.withColumns({"lines": F.when(F.col("token") == 5, 9).otherwise(1), "columns": F.when(F.col("token") == 5, 12).otherwise(1)})
    one, two = (cells.select("kind", "token", "lines", "columns", *(F.col(c).alias(f"{c}{s}") for c in ("gid", "label", "n", "pos"))) for s in (1, 2))
    one, two, keys = ngram_join._grid(one, two, 80)
    for side in (one, two):
        assert max(r["count"] for r in side.where("token = 5").groupBy(*keys).count().collect()) <= 40
    met = [(r.gid1, r.gid2) for r in one.join(two, keys).where("kind = 1 OR 100 * least(n1, n2) >= 80 * greatest(n1, n2)").collect()]
    want = {(a[2], b[2]) for a in rows for b in rows if a[:2] == b[:2] and (a[0] == 1 or 100 * min(a[4], b[4]) >= 80 * max(a[4], b[4]))}
    assert len(met) == len(want) and set(met) == want


def test_a_group_alone_in_its_part_meets_the_other_parts(spark):
    ship(spark)
    rng, rows = random.Random(5), []
    for k in range(16):                                   # a text of 5 copies and one near copy: every shingle has fan 2
        text = edge.words(rng, 60, f"k{k}x")
        rows += [(100 * k + i, text) for i in range(5)] + [(100 * k + 50 + k, text + " tail")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, ngram_join.jaccard_components(docs, deal=4).collect()), key=str)
    assert got == components_by_hand(rows)


def test_differing_bits_never_exceed_differing_shingles():
    rng = np.random.default_rng(7)
    sizes = [0, 1, 2, 63, 64, 65, 130, 500, 3000, 400, 410]
    base = rng.integers(0, 2**64, 3000, dtype=np.uint64)
    sets = [np.unique(np.where(rng.random(n) < share, rng.integers(0, 2**64, n, dtype=np.uint64), base[:n])) for n in sizes for share in (0, 0.1, 1)]
    maps = ngram_join._parity(np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.array([len(s) for s in sets]))
    assert all(len(m.as_py()) == (max(64, 1 << (len(s) - 1).bit_length()) // 8 if len(s) else 0) for m, s in zip(maps, sets))
    a, b = (x.ravel() for x in np.meshgrid(*[np.arange(len(sets))] * 2))
    found = ngram_join._differing(maps.take(a), maps.take(b))
    apart = np.array([len(np.setxor1d(sets[i], sets[j])) for i, j in zip(a, b)])
    assert (found <= apart).all() and (found[apart == 0] == 0).all()
    large = [(len(sets[i]), len(sets[j])) == (500, 500) for i, j in zip(a, b)]
    assert (found[(apart > 900) & large] > 0.111 * 1000).all()             # unrelated sets are told apart
    part = maps.take(a).slice(5, 200)
    assert (ngram_join._differing(part, maps.take(b).slice(5, 200)) == found[5:205]).all()


def test_sets_are_fetched_for_likely_pairs_only(spark, monkeypatch):
    """Texts of two blocks, each block in nine texts: they share prefix shingles, yet none reaches the similarity."""
    ship(spark)
    rng, asked, verified = random.Random(6), [], ngram_join._verified
    blocks = [edge.words(rng, 40, f"b{i}x") for i in range(10)]
    rows = [(10 * i + j, f"{blocks[i]} {blocks[j]}") for i in range(10) for j in range(i + 1, 10)]
    near = edge.words(rng, 90, "near")
    rows += [(1000 + i, f"{near} tail{i}") for i in range(6)]

    def spy(pairs, *rest):
        asked.extend(map(tuple, pairs.collect()))
        return verified(pairs, *rest)

    monkeypatch.setattr(ngram_join, "_verified", spy)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, ngram_join.jaccard_components(docs).collect()), key=str)
    assert got == components_by_hand(rows)
    assert len(asked) >= 5 and min(min(p) for p in asked) >= 1000


def test_groups_without_a_possible_partner_are_left_out(spark):
    rng, percent = random.Random(12), 80
    groups = [(gid, n, [t for t in rng.sample(range(400), 400) if t % 40 == gid % 40 or rng.random() < 0.02][:n // 5 + 1]) for gid, n in ((g, rng.choice([20, 60, 70, 300])) for g in range(150))]
    groups = [(gid, n, prefix, [2 if t % 50 == 0 else 1 for t in prefix]) for gid, n, prefix in groups]
    frame = spark.createDataFrame(groups, "gid long, n long, prefix array<long>, fan array<int>")
    got = {(r.token, r.gid): r for r in ngram_join._shared(frame, percent).collect()}
    by = defaultdict(list)
    for gid, n, prefix, _ in groups:
        for pos, token in enumerate(prefix):
            by[token].append((gid, n, pos))

    def close(x, y):
        rest = min(x[1] - x[2], y[1] - y[2])
        return 100 * min(x[1], y[1]) >= percent * max(x[1], y[1]) and (100 + percent) * rest >= percent * (x[1] + y[1])

    needed = {(t, x[0]) for t, rows in by.items() for x in rows if t % 50 == 0 or any(x != y and close(x, y) for y in rows)}
    paired = {(t, x[0]) for t, rows in by.items() if len(rows) == 2 and t % 50 for x in rows}
    assert needed <= set(got) and len(got) < sum(map(len, by.values()))
    assert paired & set(got) == paired & needed
    for (token, gid), r in got.items():
        assert (gid, r.n, r.pos) in by[token] and (r.part > 0) == (token % 50 == 0)
        assert r.part > 0 or tuple(r.hub) == min(by[token])


def test_groups_of_copies_are_one(spark):
    ship(spark)
    rows = [(i, i % 5 if i < 40 else i, 7 if i % 3 else 9, [i % 5 if i < 40 else i], [1]) for i in range(60)]
    filled = spark.createDataFrame(rows, "doc long, g long, n long, prefix array<long>, fan array<int>")
    gids = filled.groupBy("g", "n").agg(F.min("doc").alias("gid"), F.count("*").alias("copies"))
    first = {}
    for doc, g, n, prefix, fan in rows:
        first.setdefault((g, n), (doc, n, prefix, fan))
    assert sorted(map(tuple, ngram_join._groups(filled, gids).collect())) == sorted(first.values())


def test_components_of_odd_rows(spark):
    ship(spark)
    docs = edge.frame(spark)
    out = ngram_join.jaccard_components(docs)
    assert out.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, out.collect()), key=str) == components_by_hand([(r[0], r[1]) for r in edge.rows()])
    assert ngram_join.jaccard_components(docs.limit(0)).count() == 0
    kept = ngram_join.first_of_each(docs)
    assert kept.columns == docs.columns
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert ids == [1, 4, 5, 6, 7, 9, 10, 11, 12, 13]


def test_graph_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(60)] + [(200 + rng.randrange(40), 200 + rng.randrange(40)) for _ in range(25)] + [(7, 7), (None, 3), (900, 901), (901, 900)]
    got = dict(map(tuple, graph.components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t"), "x").collect()))
    parent = {}

    def find(i):
        parent.setdefault(i, i)
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        if a is not None and a != b:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    assert got == {i: find(i) for i in parent}


def top_by_hand(rows, k, every):
    data = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (q, w) in enumerate(data):
        if q % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(w, v)), i) for j, (i, v) in enumerate(data) if j != at and len(v) == len(w))
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


def test_top_products(spark, monkeypatch):
    ship(spark)
    rng = np.random.default_rng(3)
    monkeypatch.setattr(topk, "BLOCK_NUMBERS", 200)
    monkeypatch.setattr(topk, "QUERY_NUMBERS", 40)
    rows = [(i, (rng.normal(size=6) * rng.choice([0.1, 1, 30])).tolist()) for i in range(300)]
    rows += [(i, (np.array(rows[3][1]) + rng.normal(size=6) * 0.01).tolist()) for i in range(300, 360)]       # a tight cluster
    rows += [(1000, [0.0] * 6), (1001, [0.0] * 6), (1050, rows[9][1]), (1051, rows[9][1]), (1051, rows[9][1])]  # ties, repeats
    rows += [(1100, None), (1101, [1.0, None] * 3), (1102, [float("nan")] * 6), (1103, [float("inf")] + [0.0] * 5), (None, [1.0] * 6), (1150, [1.0, 2.0]), (1151, []), (1200, [])]
    data = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<float>, id string")
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert sorted(map(tuple, topk.top_products(data, 5, 10).collect())) == top_by_hand(rows, 5, 10)
    assert topk.top_products(data.limit(0), 5, 10).count() == 0


def test_products_never_wrap():
    assert topk.products(np.array([[2.0**40, 1]]), np.array([2.0**10, 3])).tolist() == [2**50 + 3]
    assert topk.products(np.array([[2.0**31, 1]]), np.array([2.0**30, 3])).tolist() == [2**61 + 3]
    with pytest.raises(OverflowError):
        topk.products(np.array([[2.0**60, 1]]), np.array([2.0**10, 3]))


def test_rows_count_each_for_itself_in_operator_and_sql(spark):
    import duckdb
    import pyarrow as pa

    ship(spark)
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(120)]
    rows += [rows[7], rows[7], rows[50], (50, rows[3][1]), (100, rows[50][1])]        # a vector three times, a query twice, an id twice
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    got = sorted(map(tuple, topk.top_products(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()))
    con = duckdb.connect()
    con.register("embeddings", pa.table({"vec_id": [i for i, _ in rows], "embedding": pa.array([v for _, v in rows], pa.list_(pa.float32()))}))
    assert got == sorted(con.sql(topk.SQL).fetchall()) == top_by_hand(rows, 5, 50)


def test_products_of_two_blocks_at_once(monkeypatch):
    rng = np.random.default_rng(3)
    rows = rng.integers(-20, 20, (300, 6)).astype(float)
    rows[50:60] = rows[40]                                     # ties
    norms = np.sqrt(np.square(rows).sum(axis=1))
    order = np.argsort(-norms, kind="stable")
    rows, norms, ids, numbers = rows[order], norms[order], rng.permutation(300)[order], order
    unit = rows / np.where(norms > 0, norms, 1)[:, None]
    queries = np.array([*range(0, 300, 7), 1000])              # the last one is of another block
    place = {int(n): i for i, n in enumerate(numbers)}
    q = np.array([rows[place[n]] if n in place else rng.integers(-20, 20, 6).astype(float) for n in queries.tolist()])
    monkeypatch.setattr(topk, "PRODUCTS", 3000)
    for bounds in ([None] * len(q), [900] * len(q), [None if i % 3 else (-50 if i % 2 else 1500) for i in range(len(q))]):
        want = [(i, s, v) for i, (n, x, b) in enumerate(zip(queries.tolist(), q, bounds, strict=True))
                for s, v in topk.hits(n, x, float(np.sqrt(x @ x)), b, ids, numbers, norms, rows, unit, 5)]
        assert want and sorted(topk.block_hits(queries, q, bounds, ids, numbers, norms, rows, 5)) == sorted(want)
