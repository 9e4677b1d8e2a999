"""Indicator screening: Pearson matrix and multicollinear pairs, Spearman with the target,
WoE / IV tables and ranking, key-indicator selection (A10, A11, H1-H4).

Every statistic over many features starts from one unpivot to (feature, value, target) and
groups by feature, so all features are screened in the same few jobs.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from ..functions.columns import truth
from . import ranks
from .cleaning import feature_columns


def numeric_candidates(df: DataFrame, target_col: str = config.TARGET_COL, exclude_leaky: bool = True) -> list[str]:
    """Numeric columns except the target (and, by default, leaky and technical ones)."""
    num, _ = feature_columns(df, exclude_leaky=exclude_leaky)
    return [c for c in num if c != target_col]


def pearson_matrix(df: DataFrame, features: list[str]) -> DataFrame:
    """A10: Pearson correlation of every unordered pair of ``features`` on pairwise-complete rows,
    as a long table (feature_a, feature_b, corr) with feature_a before feature_b in list order; NULL
    for a constant.  Every partition sums the moments of all pairs, centred at the columns' means,
    as a few matrix products, and the sums of a pair meet in one grouped aggregate."""
    if len(features) < 2:
        return df.sparkSession.createDataFrame([], "feature_a string, feature_b string, corr double")
    data = df.select(*[F.col(c).cast("double").alias(c) for c in features])
    centre = np.array([x if x is not None else 0.0 for x in data.agg(*[F.avg(c) for c in features]).first()], float)
    above, below = np.triu_indices(len(features), 1)

    def moments(batches):
        k = len(features)
        total = np.zeros((6, k, k))
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns], 1) if k else np.zeros((0, 0))
            known = np.isfinite(x)
            m, x = known.astype(float), np.where(known, x - centre, 0.0)
            sx, sxx = x.T @ m, (x * x).T @ m
            total += np.stack([m.T @ m, sx, sx.T, sxx, sxx.T, x.T @ x])
        sums = total[:, above, below]
        yield pa.RecordBatch.from_arrays([pa.array(above.astype(np.int32)), pa.array(below.astype(np.int32)), *map(pa.array, sums)],
                                         ["i", "j", "n", "sx", "sy", "sxx", "syy", "sxy"])

    parts = data.mapInArrow(moments, "i int, j int, n double, sx double, sy double, sxx double, syy double, sxy double")
    t = parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])
    names, middle = F.array(*map(F.lit, features)), F.array(*map(F.lit, centre.tolist()))
    vx = F.col("sxx") - F.try_divide(F.col("sx") * F.col("sx"), F.col("n"))
    vy = F.col("syy") - F.try_divide(F.col("sy") * F.col("sy"), F.col("n"))
    least = lambda at: F.col("n") * F.pow(F.abs(middle[F.col(at)]) * 1e-14, F.lit(2.0))  # noqa: E731  what rounding leaves of a constant
    varies = (vx > least("i")) & (vy > least("j"))
    corr = F.when(varies, (F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")) / F.sqrt(F.when(varies, vx * vy)))
    return t.select(names[F.col("i")].alias("feature_a"), names[F.col("j")].alias("feature_b"), corr.alias("corr"))


def multicollinear_pairs(df: DataFrame, features: list[str], threshold: float = 0.9) -> DataFrame:
    """Unordered pairs with |r| > threshold, strongest first."""
    return (pearson_matrix(df, features)
            .filter(truth(F.abs(F.col("corr")) > threshold))
            .select("feature_a", "feature_b", F.abs("corr").alias("abs_corr"))
            .orderBy(F.desc("abs_corr"), "feature_a", "feature_b"))


def target_histogram(df: DataFrame, features: list[str], target_col: str = config.TARGET_COL, stored: bool = False) -> DataFrame:
    """(feature, value) -> rows ``n``, target sums ``sy`` and ``syy`` over non-missing pairs, with running sums:
    what Spearman and IV need of the rows."""
    y = F.col(target_col).cast("double")
    return ranks.running_histogram(df.where(y.isNotNull()), features, {"sy": y, "syy": y * y}, stored=stored)


def target_correlation(df: DataFrame, features: list[str] | None = None, target_col: str = config.TARGET_COL,
                       exclude_leaky: bool = True, hist: DataFrame | None = None) -> DataFrame:
    """H1: Spearman correlation of each numeric feature with a 0/1 target on complete pairs,
    strongest first.

    For a two-valued target its ranks are an affine map of the target, so Spearman equals the
    Pearson correlation of the feature's average ranks with the target.  Everything is computed
    on the (feature, value) histogram (``hist``, if the caller has one): average ranks from its running
    counts, then cov / var sums per feature - rows are never joined back."""
    features = features or numeric_candidates(df, target_col, exclude_leaky)
    hist = target_histogram(df, features, target_col) if hist is None else hist.where(F.col("feature").isin(features))
    ranked = ranks.average_ranks(hist, ["feature"])
    tot = hist.groupBy("feature").agg(F.sum("n").alias("_tn"), F.sum("sy").alias("_tsy"), F.sum("syy").alias("_tsyy"))
    j = ranked.join(ranks.small_broadcast(tot, len(features)), "feature")
    mr = (F.col("_tn") + 1) / 2.0
    my = F.col("_tsy") / F.col("_tn")
    stats = j.groupBy("feature").agg(
        F.sum((F.col("avg_rank") - mr) * (F.col("sy") - F.col("n") * my)).alias("cov"),
        F.sum(F.col("n") * (F.col("avg_rank") - mr) * (F.col("avg_rank") - mr)).alias("vr"),
        F.first(F.col("_tsyy") - F.col("_tsy") * my).alias("vy"))
    corr = F.when((F.col("vr") > 0) & (F.col("vy") > 0), F.col("cov") / F.sqrt(F.col("vr") * F.col("vy")))
    return (stats.select("feature", corr.alias("corr"))
            .withColumn("abs_corr", F.abs("corr"))
            .orderBy(F.desc_nulls_last("abs_corr"), "feature"))


def _strength(iv):
    e1, e2, e3, e4 = config.IV_STRENGTH_EDGES
    l1, l2, l3, l4, l5 = config.IV_STRENGTH_LABELS
    return (F.when(iv <= e1, F.lit(l1)).when(iv <= e2, F.lit(l2)).when(iv <= e3, F.lit(l3))
            .when(iv <= e4, F.lit(l4)).when(iv > e4, F.lit(l5)))


def _woe_from_counts(counts: DataFrame) -> DataFrame:
    """counts(feature, bin..., bad, total) -> WoE table with per-feature totals: grouped sums, one
    row a feature, joined back, so that a feature with very many values fills no task."""
    g = counts.withColumn("good", F.col("total") - F.col("bad"))
    sums = g.groupBy("feature").agg(F.sum("good").alias("_good"), F.sum("bad").alias("_bad"))
    g = (g.join(sums, "feature").withColumn("dist_good", F.col("good") / (F.col("_good") + 1e-9))
         .withColumn("dist_bad", F.col("bad") / (F.col("_bad") + 1e-9)).drop("_good", "_bad"))
    g = g.withColumn("woe", F.ln((F.col("dist_good") + 1e-9) / (F.col("dist_bad") + 1e-9)))
    g = g.withColumn("iv_part", (F.col("dist_good") - F.col("dist_bad")) * F.col("woe"))
    return g.join(g.groupBy("feature").agg(F.sum("iv_part").alias("iv")), "feature")


def numeric_bins(df: DataFrame, features: list[str], target_col: str, bins: int = 10,
                 hist: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Decile bins per feature: edges are the distinct exact quantiles at numpy's
    linspace(0, 1, bins + 1); bin k holds (edge[k-1], edge[k]], the lowest edge included.

    Everything comes from one (feature, value) histogram with row and target counts (``hist``, if the
    caller has one), written once to the checkpoint folder.  Returns (per-bin bad / total counts, edges per feature)."""
    hist = target_histogram(df, features, target_col) if hist is None else hist.where(F.col("feature").isin(features))
    q = ranks.quantiles_from_histogram(hist, ["feature"], ranks.numpy_linspace(bins), n_groups_bound=len(features))
    edges = q.select("feature", F.array_distinct("quantiles").alias("edges"))
    counts = (hist.join(ranks.small_broadcast(edges, len(features)), "feature")
              .filter(F.size("edges") >= 2)
              .withColumn("bin", F.greatest(F.lit(1), F.size(F.filter("edges", lambda e: e < F.col("value"))))))
    counts = counts.groupBy("feature", "bin").agg(F.sum("sy").alias("bad"), F.sum("n").alias("total"))
    return counts, edges


def woe_iv(df: DataFrame, features: list[str], target_col: str = config.TARGET_COL, bins: int = 10,
           hist: DataFrame | None = None) -> DataFrame:
    """H2 for numeric features: per (feature, bin) bad, total, good, distributions, WoE, IV
    part and the feature's IV; empty bins are kept with zero counts.  Features with fewer than
    two distinct edges (constant) have no bins."""
    counts, edges = numeric_bins(df, features, target_col, bins, hist)
    all_bins = (edges.filter(F.size("edges") >= 2)
                .select("feature", "edges", F.explode(F.sequence(F.lit(1), F.size("edges") - 1)).alias("bin")))
    full = (all_bins.join(counts, ["feature", "bin"], "left")
            .select("feature", "bin",
                    F.col("edges")[F.col("bin") - 1].alias("bin_low"), F.col("edges")[F.col("bin")].alias("bin_high"),
                    F.coalesce("bad", F.lit(0.0)).alias("bad"), F.coalesce("total", F.lit(0)).alias("total")))
    return _woe_from_counts(full)


def woe_iv_categorical(df: DataFrame, features: list[str], target_col: str = config.TARGET_COL) -> DataFrame:
    """H2 for categorical features: one bin per value (rows with a missing value dropped)."""
    long = (df.select(F.col(target_col).cast("double").alias("y"),
                      F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("v"))
                                          for c in features])).alias("kv"))
            .select("kv.feature", F.col("kv.v").alias("bin"), "y")
            .filter(F.col("bin").isNotNull() & F.col("y").isNotNull()))
    counts = long.groupBy("feature", "bin").agg(F.sum("y").alias("bad"), F.count(F.lit(1)).alias("total"))
    return _woe_from_counts(counts)


def iv_ranking(df: DataFrame, numeric: list[str], categorical: list[str] | None = None,
               target_col: str = config.TARGET_COL, bins: int = 10, hist: DataFrame | None = None) -> DataFrame:
    """H3: IV per feature (numeric by deciles, categorical by value), highest first, with its
    strength class; features without usable bins are left out."""
    parts = []
    if numeric:
        parts.append(woe_iv(df, numeric, target_col, bins, hist).select("feature", "iv"))
    if categorical:
        parts.append(woe_iv_categorical(df, categorical, target_col).select("feature", "iv"))
    if not parts:
        return df.sparkSession.createDataFrame([], "feature string, iv double, strength string")
    allp = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return (allp.groupBy("feature").agg(F.first("iv").alias("iv"))
            .filter(F.col("iv").isNotNull() & ~F.isnan("iv"))
            .withColumn("strength", _strength(F.col("iv")))
            .orderBy(F.desc("iv"), "feature"))


def key_indicators(df: DataFrame, features: list[str], target_col: str = config.TARGET_COL, top_k: int = 15,
                   corr_threshold: float = 0.85) -> list[str]:
    """H4: order features by (average rank of IV) + (average rank of |Spearman|), then pick greedily
    up to ``top_k``, each pick suppressing the features correlated with it above the threshold.

    Statistics, ranks and the pairs that suppress each other come from Spark tables with a row a
    feature or a row a pair of features; the driver walks down the ranked list once."""
    from ..session import materialize
    # the rows are read three times, the histogram serves both statistics
    df = materialize(df.select(*[F.col(c).cast("double").alias(c) for c in features], F.col(target_col).cast("double").alias(target_col)))
    hist = target_histogram(df, features, target_col, stored=True)
    place = F.array_position(F.array(*map(F.lit, features)), F.col("feature"))
    both = (iv_ranking(df, features, None, target_col, hist=hist).select("feature", "iv")
            .join(target_correlation(df, features, target_col, hist=hist).where("abs_corr IS NOT NULL"), "feature"))

    def shared_rank(column):
        of = Window.partitionBy(F.lit(0)).orderBy(column)                 # at most a row a feature
        return F.rank().over(of) + (F.count("*").over(Window.partitionBy(F.lit(0), column)) - 1) / 2.0

    ranked = both.select("feature", (shared_rank("iv") + shared_rank("abs_corr")).alias("score"), place.alias("place"))
    order = [r["feature"] for r in ranked.orderBy(F.desc("score"), "place").collect()]
    close = {frozenset(r[:2]) for r in multicollinear_pairs(df, features, corr_threshold).collect()}
    chosen: list[str] = []
    while order and len(chosen) < top_k:
        chosen.append(order[0])
        order = [f for f in order[1:] if frozenset((chosen[-1], f)) not in close]
    return chosen


def shortlist(df: DataFrame, features: list[str], target_col: str = config.TARGET_COL, n_corr: int = 30,
              n_iv: int = 25) -> DataFrame:
    """L4: the ``n_corr`` features most correlated (|Spearman|) with the target, then the
    ``n_iv`` of those with the highest IV."""
    hist = target_histogram(df, features, target_col)
    top = [r["feature"] for r in target_correlation(df, features, target_col, hist=hist).limit(n_corr).collect()]
    return iv_ranking(df, top, None, target_col, hist=hist).limit(n_iv)
