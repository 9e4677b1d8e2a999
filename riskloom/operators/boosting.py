"""Gradient boosting with leaf-wise trees on histograms of binned features.

Every feature is cut into at most ``max_bins`` bins once.  A tree grows best-first: of all leaves the one with the
largest gain is split, until there are ``num_leaves``.  One pass over the rows sums gradients, hessians and row counts
by leaf, feature and bin, a partition at a time and then in a tree; the larger of two siblings is the parent less the
smaller.  A pass serves all leaves that best-first growth may ask for next, so that a tree takes about as many passes
as it has levels, not as many as it has leaves, and is the same tree.

Rows stay on the executors as blocks of binned features with their margin after every ``REFRESH`` trees; the driver
holds histograms of ``LEAVES_A_PASS`` leaves and the trees, whatever the number of rows.  Up to ``TASK_ROWS`` rows one
task holds them all and grows every tree by itself, without a Spark job a pass; the trees are the same.
"""
from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REFRESH = 5                    # trees between two updates of the stored margins
LEAVES_A_PASS = 32             # leaves whose histograms one pass sums
BLOCK_ROWS = 1 << 15
TASK_ROWS = 1 << 18            # rows up to which one task grows all trees: some 20 MB of bins
FEW_ROWS = 1 << 12             # rows up to which all features are summed at once
LEAST_HESSIAN = 1e-3           # a child's hessians sum to this at least


@dataclass(frozen=True)
class BoostParams:
    n_estimators: int = 600
    learning_rate: float = 0.05
    num_leaves: int = 63
    min_child_samples: int = 50
    reg_alpha: float = 0.1
    reg_lambda: float = 0.1
    max_bins: int = 255


@dataclass
class Tree:
    """Nodes in arrays, the root first; ``feature`` is -1 in a leaf, rows with ``bin <= cut`` go left."""
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    count: np.ndarray

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        """The node where each row of binned features ends."""
        node = np.zeros(len(bins), np.int32)
        waiting = [(0, np.arange(len(bins)))]
        while waiting:
            at, rows = waiting.pop()
            if self.feature[at] < 0:
                node[rows] = at
            elif len(rows):
                down = bins[rows, self.feature[at]] <= self.cut[at]
                waiting += [(int(self.left[at]), rows[down]), (int(self.right[at]), rows[~down])]
        return node


@dataclass
class Booster:
    """Bounds of the bins of each feature (the last bin has none), trees, and the margin they start from."""
    bounds: list[np.ndarray]
    trees: list[Tree] = field(default_factory=list)
    base: float = 0.0

    def bins(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(x.shape, np.uint8, order="F")              # a feature's bins lie together
        for f, b in enumerate(self.bounds):
            out[:, f] = np.searchsorted(b, x[:, f], "left")
        return out

    def margin(self, bins: np.ndarray, first: int = 0) -> np.ndarray:
        """Sum of the trees from ``first`` on; with the base if that is the first."""
        total = np.full(len(bins), 0.0 if first else self.base)
        for tree in self.trees[first:]:
            total += tree.value[tree.leaves(bins)]
        return total

    def split_counts(self) -> np.ndarray:
        used = np.zeros(len(self.bounds), np.int64)
        for tree in self.trees:
            np.add.at(used, tree.feature[tree.feature >= 0], 1)
        return used

    def to_dict(self) -> dict:
        return {"base": self.base, "bounds": [b.tolist() for b in self.bounds],
                "trees": [{k: v.tolist() for k, v in vars(t).items()} for t in self.trees]}

    @staticmethod
    def from_dict(d: dict) -> "Booster":
        kinds = {"feature": np.int32, "cut": np.int32, "left": np.int32, "right": np.int32, "value": np.float64, "count": np.int64}
        return Booster([np.array(b, np.float64) for b in d["bounds"]], [Tree(**{k: np.array(t[k], kind) for k, kind in kinds.items()}) for t in d["trees"]], d["base"])


def bin_bounds(df: DataFrame, features: str, n: int, max_bins: int = 255) -> list[np.ndarray]:
    """Upper bounds of the bins of each element of an array column of length ``n``: between the values where there are
    at most ``max_bins``, else at quantiles (of relative error 1e-4).  Two aggregates over the rows, of bounded size."""
    if not n:
        return []
    x = [F.nullif(F.col(features)[i], F.lit(float("nan"))) for i in range(n)]
    shares = [k / max_bins for k in range(1, max_bins)]
    distinct = df.agg(*[F.approx_count_distinct(c, 0.02).alias(f"d{i}") for i, c in enumerate(x)]).first()
    short = [distinct[f"d{i}"] <= 2 * max_bins for i in range(n)]        # the estimate is some percent off
    found = df.agg(*[(F.array_sort(F.collect_set(c)) if short[i] else F.percentile_approx(c, shares, 10_000)).alias(f"q{i}") for i, c in enumerate(x)]).first()
    out = []
    for i in range(n):
        values = np.unique(np.array(found[f"q{i}"] or [], np.float64))
        if short[i] and len(values) > max_bins:
            values = values[np.unique(np.linspace(0, len(values) - 1, max_bins).astype(int))]
        out.append((values[:-1] + values[1:]) / 2 if short[i] else values)
    return out


def _blocks(features: str, label: str, weight: str, booster: Booster) -> Callable[[Iterator], Iterator]:
    def make(rows):
        part: list = []
        for row in rows:
            part.append(row)
            if len(part) == BLOCK_ROWS:
                yield pack(part)
                part = []
        if part:
            yield pack(part)

    def pack(part):
        x = np.array([r[0] for r in part], np.float64).reshape(len(part), -1)
        return booster.bins(x), np.array([r[1] for r in part], np.float64), np.array([r[2] for r in part], np.float64), np.full(len(part), booster.base)

    return make


def histogram(bins: np.ndarray, node: np.ndarray, wanted: list[int], gradient: np.ndarray, hessian: np.ndarray, width: int) -> np.ndarray:
    """(wanted node, 3, bin, feature): sums of gradients, hessians and rows."""
    place = np.full(int(max(node.max(initial=0), max(wanted))) + 1, -1, np.int64)
    place[wanted] = np.arange(len(wanted))
    slot = place[node]
    rows = np.flatnonzero(slot >= 0)
    return _sums(bins, rows, slot[rows], len(wanted), gradient, hessian, width)


def _sums(bins: np.ndarray, rows: np.ndarray, slot: np.ndarray, nodes: int, gradient: np.ndarray, hessian: np.ndarray, width: int) -> np.ndarray:
    """``histogram`` of some rows; ``slot`` numbers a row's node."""
    g, h, m = gradient[rows], hessian[rows], bins.shape[1]
    if len(rows) <= FEW_ROWS:                                   # one sum over all features
        at = ((slot[:, None] * width + bins[rows]) * m + np.arange(m)).ravel()
        each = [np.bincount(at, w if w is None else np.repeat(w, m), nodes * width * m) for w in (g, h, None)]
        return np.stack([s.reshape(nodes, width, m) for s in each], axis=1, dtype=np.float64)
    out = np.empty((nodes, 3, width, m))
    slot = slot * width
    for f in range(m):
        at = slot + bins[rows, f]
        for i, w in enumerate((g, h, None)):
            out[:, i, :, f] = np.bincount(at, w, nodes * width).reshape(nodes, width)
    return out


def _shrunk(g, alpha: float):
    return np.sign(g) * np.maximum(np.abs(g) - alpha, 0.0)


def best_split(hist: np.ndarray, p: BoostParams) -> tuple[float, int, int]:
    """(gain, feature, cut) of the best split of a leaf; of equal gains the first feature and cut."""
    left = np.cumsum(hist, axis=1)
    total = left[:, -1:, :1]
    if total[2, 0, 0] < 2 * max(p.min_child_samples, 1):
        return -math.inf, 0, 0
    right = total - left
    score = lambda s: np.maximum(np.abs(s[0]) - p.reg_alpha, 0.0) ** 2 / (s[1] + (p.reg_lambda + 1e-300))
    fits = (np.minimum(left[2], right[2]) >= max(p.min_child_samples, 1)) & (np.minimum(left[1], right[1]) >= LEAST_HESSIAN)
    gain = np.where(fits, score(left) + score(right) - score(total), -np.inf)
    best = gain.max()
    feature, cut = min((int(f), int(c)) for c, f in zip(*np.nonzero(gain == best), strict=True)) if best > -math.inf else (0, 0)
    return float(best), feature, cut


def grow_tree(histograms: Callable[[Tree, list[int]], np.ndarray], p: BoostParams, at_once: int) -> Tree:
    """Best-first growth.  ``histograms(tree, nodes)`` sums the rows that end in each of ``nodes`` of a tree, of
    ``at_once`` nodes at most."""
    sums, splits, children, parent_hist = [], [], [], {}

    def add(hist: np.ndarray) -> int:
        sums.append(hist[:, :, 0].sum(axis=1))
        splits.append(best_split(hist, p))
        children.append(None)
        parent_hist[len(sums) - 1] = hist
        return len(sums) - 1

    def tree(split: set[int]) -> Tree:
        """The nodes so far as a tree in which only ``split`` have children."""
        at, numbers, order = 0, {0: 0}, [0]
        while at < len(order):
            if order[at] in split:
                for c in children[order[at]]:
                    numbers[c] = len(order)
                    order.append(c)
            at += 1
        inner = [i in split for i in order]
        pick = lambda f, kind: np.array([f(i) if s else -1 for i, s in zip(order, inner, strict=True)], kind)
        g, h, c = np.array([sums[i] for i in order]).T
        value = np.where(inner, 0.0, -_shrunk(g, p.reg_alpha) / (h + p.reg_lambda) * p.learning_rate)
        grown = Tree(pick(lambda i: splits[i][1], np.int32), pick(lambda i: splits[i][2], np.int32), pick(lambda i: numbers[children[i][0]], np.int32),
                     pick(lambda i: numbers[children[i][1]], np.int32), value, np.rint(c).astype(np.int64))
        grown_numbers.clear()
        grown_numbers.update(numbers)
        return grown

    grown_numbers: dict[int, int] = {}
    stub = Tree(*(np.array([-1], np.int32) for _ in range(4)), np.zeros(1), np.zeros(1, np.int64))
    add(histograms(stub, [0])[0])
    while True:
        heap, chosen = [(-splits[0][0], 0)], set()
        while heap and len(chosen) < p.num_leaves - 1 and heap[0][0] < 0 and children[heap[0][1]]:
            _, node = heapq.heappop(heap)
            chosen.add(node)
            for c in children[node]:
                heapq.heappush(heap, (-splits[c][0], c))
        room = p.num_leaves - 1 - len(chosen)
        if not room or not heap or heap[0][0] >= 0:
            return tree(chosen)
        next_up = [i for gain, i in heapq.nsmallest(min(room, at_once), heap) if gain < 0 and not children[i]]
        small = []
        for i in next_up:                                       # children without sums yet; the smaller one is asked for
            left = parent_hist[i][2, :splits[i][2] + 1, splits[i][1]].sum()
            small.append(0 if 2 * left <= sums[i][2] else 1)
            children[i] = (len(sums), len(sums) + 1)
            sums += [np.zeros(3), np.zeros(3)]
            splits += [(-math.inf, 0, 0)] * 2
            children += [None, None]
        partial = tree({i for i, c in enumerate(children) if c})
        got = histograms(partial, [grown_numbers[children[i][s]] for i, s in zip(next_up, small, strict=True)])
        for i, s, hist in zip(next_up, small, got, strict=True):
            whole = parent_hist.pop(i)
            for c, own in ((children[i][s], hist), (children[i][1 - s], whole - hist)):
                sums[c], splits[c], parent_hist[c] = own[:, :, 0].sum(axis=1), best_split(own, p), own


def fit(df: DataFrame, features: str, label: str, weight: str, n: int, params: BoostParams = BoostParams()) -> Booster:
    """Boosted trees for a 0 / 1 label.  ``features`` is an array column of ``n`` doubles without nulls; rows with a
    null label, weight or feature array are left out.  Without rows, or where no split gains, there are no trees."""
    rows = df.select(features, F.col(label).cast("double"), F.col(weight).cast("double")).dropna()
    booster = Booster(bin_bounds(rows, features, n, params.max_bins))
    width = max((len(b) for b in booster.bounds), default=0) + 1
    y, w = F.col(rows.columns[1]), F.col(rows.columns[2])
    count, positive, weights = rows.agg(F.count("*"), F.sum(y * w), F.sum(w)).first()
    if not count or not n or not 0 < positive < weights:
        return booster
    booster.base = math.log(positive / (weights - positive))
    if count <= TASK_ROWS:
        grown = rows.coalesce(1).rdd.mapPartitions(_blocks(features, label, weight, booster)).mapPartitions(lambda blocks: _all_trees(blocks, params, width))
        booster.trees = grown.collect()
        return booster
    parts = min(rows.rdd.getNumPartitions(), -(-count // BLOCK_ROWS))
    state = rows.coalesce(parts).rdd.mapPartitions(_blocks(features, label, weight, booster)).persist(StorageLevel.MEMORY_AND_DISK)
    depth = 1 if parts <= 16 else 2
    fresh = 0                                                   # trees in the stored margins

    def histograms(tree: Tree, nodes: list[int]) -> np.ndarray:
        late, first = Booster(booster.bounds, booster.trees[fresh:], 0.0), fresh

        def part(blocks):
            total = None
            for bins, label, weight, margin in blocks:
                p = 1 / (1 + np.exp(-(margin + late.margin(bins))))
                got = histogram(bins, tree.leaves(bins), nodes, weight * (p - label), weight * p * (1 - p), width)
                total = got if total is None else total + got
            return [] if total is None else [total]

        return state.mapPartitions(part).treeReduce(np.add, depth)

    while len(booster.trees) < params.n_estimators:
        tree = grow_tree(histograms, params, LEAVES_A_PASS)
        if len(tree.feature) == 1:
            break
        booster.trees.append(tree)
        if len(booster.trees) - fresh == REFRESH:
            late = Booster(booster.bounds, booster.trees[fresh:], 0.0)
            newer = state.map(lambda b, late=late: (b[0], b[1], b[2], b[3] + late.margin(b[0]))).persist(StorageLevel.MEMORY_AND_DISK)
            newer.count()
            state.unpersist()
            state, fresh = newer, len(booster.trees)
    state.unpersist()
    return booster


def _all_trees(blocks: Iterator, p: BoostParams, width: int) -> list[Tree]:
    """The trees over the rows of a few blocks, all held by this task."""
    parts = list(blocks)
    if not parts:
        return []
    bins = np.asfortranarray(np.concatenate([b[0] for b in parts]))
    label, weight, margin = (np.concatenate([b[i] for b in parts]) for i in (1, 2, 3))
    trees: list[Tree] = []
    while len(trees) < p.n_estimators:
        chance = 1 / (1 + np.exp(-margin))
        gradient, hessian = weight * (chance - label), weight * chance * (1 - chance)
        ends = {"": np.arange(len(bins))}                       # rows by their way from the root

        def sums(tree, nodes, ends=ends, g=gradient, h=hessian):
            ways = {0: ""}
            for i in np.flatnonzero(tree.feature >= 0).tolist():          # parents come first
                ways |= {int(tree.left[i]): ways[i] + "l", int(tree.right[i]): ways[i] + "r"}
                if ways[i] + "l" not in ends:
                    rows = ends[ways[i]]
                    down = bins[rows, tree.feature[i]] <= tree.cut[i]
                    ends[ways[i] + "l"], ends[ways[i] + "r"] = rows[down], rows[~down]
            own = [ends[ways[i]] for i in nodes]
            return _sums(bins, np.concatenate(own), np.repeat(np.arange(len(own)), [len(o) for o in own]), len(own), g, h, width)

        tree = grow_tree(sums, p, min(4, LEAVES_A_PASS))
        if len(tree.feature) == 1:
            break
        trees.append(tree)
        margin += tree.value[tree.leaves(bins)]
    return trees


def with_margin(df: DataFrame, booster: Booster, features: str, out: str) -> DataFrame:
    """Adds the margin (log odds) of every row's feature array; null for a null array."""
    shared = df.sparkSession.sparkContext.broadcast(booster)

    def margin(x: pd.Series) -> pd.Series:
        known = x.notna().to_numpy()
        total = np.full(len(x), np.nan)
        if known.any():
            model = shared.value
            total[known] = model.margin(model.bins(np.stack(x[known].to_numpy())))
        return pd.Series(total)

    value = F.pandas_udf(margin, "double")(F.col(features))
    return df.withColumn(out, F.nullif(value, F.lit(float("nan"))))


# ---------------------------------------------------------------- contributions (path-dependent Shapley values)

@dataclass
class _Path:
    """A leaf's path, one entry a feature: the bins that stay on it, and the share of rows that do."""
    features: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray
    value: float


def leaf_paths(tree: Tree) -> list[_Path]:
    out = []
    stack: list[tuple[int, dict]] = [(0, {})]
    while stack:
        node, seen = stack.pop()
        f = int(tree.feature[node])
        if f < 0:
            if seen:
                low, high, share = (np.array(v) for v in zip(*seen.values(), strict=True))
                out.append(_Path(np.array(list(seen)), low, high, share, float(tree.value[node])))
            continue
        low, high, share = seen.get(f, (0, 1 << 30, 1.0))
        cut = int(tree.cut[node])
        for child, a, b in ((tree.left[node], low, min(high, cut)), (tree.right[node], max(low, cut + 1), high)):
            stack.append((int(child), seen | {f: (a, b, share * tree.count[child] / tree.count[node])}))
    return out


def all_paths(booster: Booster) -> list[_Path]:
    return [path for tree in booster.trees for path in leaf_paths(tree)]


def expected_margin(booster: Booster) -> float:
    """What the contributions start from: each tree's mean over its own training rows, and the base."""
    return booster.base + sum(float((t.value * t.count)[t.feature < 0].sum() / t.count[0]) for t in booster.trees)


@cache
def _gauss(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Points and weights that integrate polynomials of degree below 2 * ``count`` over 0..1."""
    nodes, weights = np.polynomial.legendre.leggauss(count)
    return (nodes + 1) / 2, weights / 2


def shapley(booster: Booster, bins: np.ndarray, paths: list[_Path] | None = None) -> np.ndarray:
    """(row, feature): path-dependent Shapley values of the margin.

    On a leaf's path a feature of a coalition lets a row pass or not (``on``), one outside lets ``share`` of it pass.
    The Shapley weights of all coalitions are the integral over t in 0..1 of the product of ``share (1 - t) + on t``
    over the other features: a polynomial, which a few Gauss points integrate exactly, for all rows at once.
    """
    out = np.zeros((len(bins), len(booster.bounds)))
    for path in all_paths(booster) if paths is None else paths:
        x = bins[:, path.features]
        on = ((x >= path.low) & (x <= path.high)).astype(np.float64)
        t, weights = _gauss((len(path.features) + 1) // 2)
        sides = path.share[:, None] * (1 - t) + on[:, :, None] * t              # row, feature, point: never 0
        rest = sides.prod(axis=1, keepdims=True) / sides
        out[:, path.features] += path.value * (on - path.share) * (rest @ weights)
    return out


def with_shapley(df: DataFrame, booster: Booster, features: str, out: str) -> DataFrame:
    """Adds an array column of Shapley values, one for each element of the feature array."""
    shared = df.sparkSession.sparkContext.broadcast(booster)
    schema = df.withColumn(out, F.lit(None).cast("array<double>")).schema

    def run(batches):
        model = shared.value
        paths = all_paths(model)
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                part = batch.slice(low, 1024)
                column = part.column(part.schema.get_field_index(features))
                x = np.array(column.to_pylist(), np.float64).reshape(part.num_rows, -1)
                values = shapley(model, model.bins(x), paths)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(list(values), pa.list_(pa.float64()))], [*part.schema.names, out])

    return df.mapInArrow(run, schema)
