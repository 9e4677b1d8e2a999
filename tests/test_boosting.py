"""The leaf-wise booster against a plain one, its Shapley values against all coalitions."""
from __future__ import annotations

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import boosting as B


def plain_booster(x, y, w, bounds, p):
    """Best-first growth with every histogram from scratch, one leaf at a time."""
    bins = np.stack([np.searchsorted(b, x[:, f], "left") for f, b in enumerate(bounds)], axis=1)
    base = math.log((y * w).sum() / ((1 - y) * w).sum())
    margin, trees = np.full(len(y), base), []
    soft = lambda g: math.copysign(max(abs(g) - p.reg_alpha, 0), g)
    score = lambda g, h: soft(g) ** 2 / (h + p.reg_lambda)
    for _ in range(p.n_estimators):
        prob = 1 / (1 + np.exp(-margin))
        g, h = w * (prob - y), w * prob * (1 - prob)

        def split(rows):
            best = (0.0, None)
            for f, b in enumerate(bounds):
                for cut in range(len(b)):
                    left = rows & (bins[:, f] <= cut)
                    right = rows & ~left
                    if min(left.sum(), right.sum()) < p.min_child_samples or min(h[left].sum(), h[right].sum()) < B.LEAST_HESSIAN:
                        continue
                    gain = score(g[left].sum(), h[left].sum()) + score(g[right].sum(), h[right].sum()) - score(g[rows].sum(), h[rows].sum())
                    if gain > best[0] + 1e-9:
                        best = (gain, (f, cut, left, right))
            return best

        leaves = [(np.ones(len(y), bool), split(np.ones(len(y), bool)))]
        cuts = []
        while len(leaves) < p.num_leaves:
            at = max(range(len(leaves)), key=lambda i: leaves[i][1][0])
            gain, found = leaves[at][1]
            if found is None:
                break
            cuts.append(found[:2])
            leaves.pop(at)
            leaves += [(side, split(side)) for side in found[2:]]
        trees.append(cuts)
        for rows, _ in leaves:
            margin[rows] += -soft(g[rows].sum()) / (h[rows].sum() + p.reg_lambda) * p.learning_rate
    return base, trees, margin


def data(n=500, seed=4):
    rng = np.random.default_rng(seed)
    x = np.stack([rng.standard_normal(n), rng.integers(0, 12, n).astype(float), rng.random(n), rng.integers(0, 2, n).astype(float)], axis=1)
    logit = 1.5 * x[:, 0] + np.where(x[:, 1] > 6, 1.0, -0.5) * (1 + x[:, 3]) + 0.3 * rng.standard_normal(n)
    return x, (rng.random(n) < 1 / (1 + np.exp(-logit))).astype(float)


def frame(spark, x, y, parts=5):
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    return spark.createDataFrame([(r.tolist(), float(a), float(b), i) for i, (r, a, b) in enumerate(zip(x, y, w))], "x array<double>, y double, w double, id int").repartition(parts), w


PARAMS = B.BoostParams(n_estimators=25, num_leaves=9, min_child_samples=15, max_bins=20)


@pytest.fixture(scope="module")
def fitted(spark):
    x, y = data()
    df, w = frame(spark, x, y)
    return x, y, w, df, B.fit(df, "x", "y", "w", 4, PARAMS)


def test_trees_equal_a_plain_booster(fitted):
    x, y, w, _, booster = fitted
    base, trees, margin = plain_booster(x, y, w, booster.bounds, PARAMS)
    assert len(booster.trees) == 25 and abs(booster.base - base) < 1e-12
    for tree, cuts in zip(booster.trees, trees, strict=True):
        mine = sorted((int(f), int(c)) for f, c in zip(tree.feature, tree.cut) if f >= 0)
        assert mine == sorted(cuts)
        assert (tree.feature < 0).sum() <= 9 and tree.count[0] == 500
        assert tree.count[tree.feature < 0].min() >= 15 and tree.count[tree.feature < 0].sum() == 500
    assert np.abs(booster.margin(booster.bins(x)) - margin).max() < 1e-9


def test_the_partitioning_does_not_matter(spark, fitted):
    x, y, _, _, booster = fitted
    df, _ = frame(spark, x, y, 1)
    again = B.fit(df, "x", "y", "w", 4, PARAMS)
    assert np.abs(again.margin(again.bins(x)) - booster.margin(booster.bins(x))).max() < 1e-9


def test_one_leaf_a_pass_gives_the_same_tree(spark, fitted, monkeypatch):
    x, y, _, df, booster = fitted
    monkeypatch.setattr(B, "LEAVES_A_PASS", 1)
    one = B.fit(df, "x", "y", "w", 4, B.BoostParams(n_estimators=3, num_leaves=9, min_child_samples=15, max_bins=20))
    for a, b in zip(one.trees, booster.trees[:3], strict=True):
        assert (a.feature == b.feature).all() and (a.cut == b.cut).all()


def test_margins_and_bounds(spark, fitted):
    x, _, _, df, booster = fitted
    assert all(len(b) <= 19 for b in booster.bounds) and booster.bounds[3].tolist() == [0.5] and len(booster.bounds[1]) == 11
    got = {r["id"]: r["m"] for r in B.with_margin(df, booster, "x", "m").collect()}
    want = booster.margin(booster.bins(x))
    assert max(abs(got[i] - want[i]) for i in range(len(x))) < 1e-12
    again = B.Booster.from_dict(booster.to_dict())
    assert (again.margin(again.bins(x)) == want).all()
    assert booster.split_counts().sum() == sum((t.feature >= 0).sum() for t in booster.trees)
    assert B.with_margin(df.limit(1).withColumn("x", F.lit(None).cast("array<double>")), booster, "x", "m").first()["m"] is None


def test_tables_without_rows_or_with_one_class(spark):
    x, y = data(60)
    df, _ = frame(spark, x, y)
    assert not B.fit(df.where("id < 0"), "x", "y", "w", 4, PARAMS).trees
    assert not B.fit(df.withColumn("y", F.lit(1.0)), "x", "y", "w", 4, PARAMS).trees
    assert not B.fit(df.withColumn("x", F.array(*[F.lit(1.0)] * 4)), "x", "y", "w", 4, PARAMS).trees
    assert not B.fit(df.withColumn("y", F.lit(None).cast("double")), "x", "y", "w", 4, PARAMS).trees


def coalition_value(tree, bins, inside):
    """Mean of the tree over the rows it was trained on, for a row that is known only on the features inside."""
    def walk(node):
        f = tree.feature[node]
        if f < 0:
            return tree.value[node]
        sides = tree.left[node], tree.right[node]
        if f in inside:
            return walk(sides[0] if bins[f] <= tree.cut[node] else sides[1])
        return sum(tree.count[c] * walk(c) for c in sides) / tree.count[node]
    return walk(0)


def test_shapley_values_equal_all_coalitions(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((400, 6))
    y = (x[:, 0] * x[:, 1] + x[:, 2] > 0.3 * x[:, 3]).astype(float)
    df, _ = frame(spark, x, y)
    booster = B.fit(df, "x", "y", "w", 6, B.BoostParams(n_estimators=4, num_leaves=20, min_child_samples=5, max_bins=30))
    bins = booster.bins(x)
    got = B.shapley(booster, bins)
    assert np.abs(got.sum(axis=1) + B.expected_margin(booster) - booster.margin(bins)).max() < 1e-12
    for row in range(0, 400, 40):
        for f in range(6):
            others = [i for i in range(6) if i != f]
            want = 0.0
            for size in range(6):
                weight = math.factorial(size) * math.factorial(5 - size) / math.factorial(6)
                for inside in itertools.combinations(others, size):
                    want += weight * sum(coalition_value(t, bins[row], {*inside, f}) - coalition_value(t, bins[row], set(inside)) for t in booster.trees)
            assert abs(got[row, f] - want) < 1e-12
    spread = {r["id"]: r["phi"] for r in B.with_shapley(df, booster, "x", "phi").collect()}
    assert all(np.allclose(spread[i], got[i], atol=1e-14) for i in range(400))


def test_one_task_grows_the_trees_of_many(fitted, monkeypatch):
    _, _, _, df, booster = fitted
    monkeypatch.setattr(B, "TASK_ROWS", 0)
    params = B.BoostParams(n_estimators=B.REFRESH + 2, num_leaves=9, min_child_samples=15, max_bins=20)
    many = B.fit(df, "x", "y", "w", 4, params)
    assert len(many.trees) == B.REFRESH + 2
    for a, b in zip(many.trees, booster.trees, strict=False):
        assert (a.feature == b.feature).all() and (a.cut == b.cut).all() and np.allclose(a.value, b.value, atol=1e-12)


def test_a_small_table_takes_few_jobs(spark, fitted):
    df = fitted[3]
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("one-task trees", "")
    B.fit(df, "x", "y", "w", 4, PARAMS)
    jobs = tracker.getJobIdsForGroup("one-task trees")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < len(jobs) < 25                                  # 25 trees took a job for every few leaves
